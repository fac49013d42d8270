"""A knowledge file as tables: its integrity against a shape and the corpus, and who cites a source.

Content is held as three tables, so that a file of any size is checked by joins:

* ``sections`` (section): the sections that the file has;
* ``entries`` (section, position, id, sources): the items of each section in file order, from 0, with the sources they name;
* ``citations`` (section, position, field, fields, passage, quote): one row per citation; ``field`` is the list of the item that holds it,
  ``fields`` are the names that the citation itself has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.ordering import global_rank
from ravelin.operators.search import citation_problems, resolve_refs


@dataclass(frozen=True)
class Shape:
    """What a knowledge file must look like: rule lists of fixed, small size."""

    sections: tuple[str, ...]
    #: Lists that must hold a citation, per section.
    cited: dict[str, tuple[str, ...]]
    #: Names that a citation has, no more and no less.
    fields: tuple[str, ...]
    max_quote: int = 320


def _problems(df: DataFrame, rule: str, where, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), where.alias("where"), detail.cast("string").alias("detail"))


def _place(*more):
    return F.concat_ws(".", "section", F.col("position").cast("string"), *more)


def section_problems(sections: DataFrame, shape: Shape) -> DataFrame:
    """Required sections that the file lacks, and sections it should not have."""
    required = sections.sparkSession.createDataFrame([(s,) for s in shape.sections], "section string")
    held = sections.select("section").distinct()
    missing = F.broadcast(required).join(held, "section", "left_anti")
    return _problems(missing, "missing section", F.col("section"), F.lit(None)).unionByName(
        _problems(held.where(~F.col("section").isin(*shape.sections)), "unexpected section", F.col("section"), F.lit(None))
    )


def order_problems(entries: DataFrame, expected: DataFrame) -> DataFrame:
    """Positions whose id is not the expected one; an item too many or too few is a position that one side lacks.

    ``expected`` (section, position, id) lists the sections whose ids are prescribed; others are left alone.
    """
    checked = entries.join(expected.select("section").distinct(), "section", "left_semi")
    found = checked.select("section", "position", F.col("id").alias("found"), F.lit(1).alias("_has"))
    both = expected.select("section", "position", F.col("id").alias("wanted"), F.lit(1).alias("_wants")).join(found, ["section", "position"], "full")
    wrong = both.where(F.col("_has").isNull() | F.col("_wants").isNull() | ~F.col("wanted").eqNullSafe(F.col("found")))
    show = lambda c: F.coalesce(c, F.lit("-"))
    return _problems(wrong, "id out of order", _place(), F.concat(show("wanted"), F.lit(" / "), show("found")))


def coverage_problems(entries: DataFrame, citations: DataFrame, shape: Shape) -> DataFrame:
    """Items without a citation in a list that must hold one."""
    rules = [(s, f) for s, fields in shape.cited.items() for f in fields]
    demanded = entries.sparkSession.createDataFrame(rules, "section string, field string")
    due = entries.select("section", "position").join(F.broadcast(demanded), "section")
    bare = due.join(citations.select("section", "position", "field"), ["section", "position", "field"], "left_anti")
    return _problems(bare, "no citation", _place("field"), F.lit(None))


def shape_problems(citations: DataFrame, shape: Shape) -> DataFrame:
    """Citations with other fields than those prescribed, in any order."""
    own = F.array_sort(F.coalesce("fields", F.array().cast("array<string>")))
    odd = citations.where(own != F.array(*[F.lit(f) for f in sorted(shape.fields)]))
    return _problems(odd, "citation shape", _place("field"), F.array_join(own, ","))


def source_problems(entries: DataFrame, described: DataFrame, known: DataFrame) -> DataFrame:
    """Descriptions of unknown sources, sources without description, and items that name unknown sources. Both tables: (source)."""
    described, known = described.select("source").distinct(), known.select("source").distinct()
    named = entries.select("section", "position", F.explode("sources").alias("source")).distinct()
    return _problems(described.join(known, "source", "left_anti"), "unknown source described", F.col("source"), F.lit(None)).unionByName(
        _problems(known.join(described, "source", "left_anti"), "source without description", F.col("source"), F.lit(None))
    ).unionByName(_problems(named.join(known, "source", "left_anti"), "unknown source named", _place(), F.col("source")))


def evidence_problems(citations: DataFrame, passages: DataFrame, shape: Shape) -> DataFrame:
    """Citations that their passage (id, text) does not prove."""
    cites = citations.select(_place("field").alias("where"), "passage", "quote")
    bad = citation_problems(cites, passages, shape.max_quote).where("problem IS NOT NULL")
    return _problems(bad, "evidence", F.col("where"), F.concat_ws(": ", F.coalesce(F.col("passage").cast("string"), F.lit("-")), "problem"))


def integrity(
    sections: DataFrame, entries: DataFrame, citations: DataFrame, expected: DataFrame, passages: DataFrame, described: DataFrame,
    known: DataFrame, shape: Shape,
) -> DataFrame:
    """(rule, where, detail) of every breach of a knowledge file; no row for a sound one.

    Only the rule lists of ``shape`` are broadcast. Texts are read by the evidence rule alone.
    """
    parts = [
        section_problems(sections, shape), order_problems(entries, expected), coverage_problems(entries, citations, shape),
        shape_problems(citations, shape), source_problems(entries, described, known), evidence_problems(citations, passages, shape),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cited_by(refs: DataFrame, passages: DataFrame) -> DataFrame:
    """Items that cite each source, with the first of their references that leads there.

    ``refs``: (kind, item, position, source, passage_id, quote, lines, words, locator), a reference per row, in the order of ``position``
    inside its item. A reference leads to the source it names, if the corpus has it; without a name, to the sources of the passages that it
    resolves to; references with equal targets are resolved once. Returns (source, kind, item, position, locator, n_passages, first_passage): of that first reference the passages inside
    the source, counted, as a hot locator may match any number.
    """
    target = ["passage_id", "source", "quote", "lines", "words"]
    named = refs.withColumn("ref", F.sha2(F.to_json(F.struct(*target)), 256))
    keys = named.select("kind", "item", "position", "ref", "locator", F.col("source").alias("named"))
    hits = resolve_refs(named.select("ref", *target).dropDuplicates(["ref"]), passages).select("ref", "id")
    places = passages.select("id", "source")
    found = hits.join(places, "id").groupBy("ref", "source").agg(F.count(F.lit(1)).alias("n_passages"), F.min("id").alias("first_passage"))
    by_name = keys.where("named IS NOT NULL").withColumn("source", F.col("named")).join(places.select("source").distinct(), "source", "left_semi")
    # a reference that names a source stays with it, whatever its passages are
    own = by_name.join(found, ["ref", "source"], "left").select("kind", "item", "position", "source", "locator", F.coalesce("n_passages", F.lit(0)).alias("n_passages"), "first_passage")
    free = keys.where("named IS NULL").join(found, "ref").select("kind", "item", "position", "source", "locator", "n_passages", "first_passage")
    firsts = own.unionByName(free).groupBy("source", "kind", "item").agg(
        F.min_by(F.struct("position", "locator", "n_passages", "first_passage"), "position").alias("_f")
    )
    return firsts.select("source", "kind", "item", "_f.*")


def condition_chains(conditions: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per condition and step, in order; a step whose action is not in the register keeps its place with a neutral tone.

    ``conditions`` (condition, action_ids), ``actions`` (action, label, tone).
    """
    steps = conditions.select("condition", F.posexplode("action_ids").alias("step", "action"))
    known = actions.select("action", "label", "tone", F.lit(True).alias("_known"))
    return steps.join(known, "action", "left").select(
        "condition", "step", "action", F.when(F.col("_known"), F.col("label")).otherwise("not documented").alias("label"),
        F.when(F.col("_known"), F.col("tone")).otherwise("neutral").alias("tone"),
    )


def condition_missing(missing: DataFrame, conditions: DataFrame) -> DataFrame:
    """Missing items whose subject is that of a condition."""
    return missing.join(conditions.select("subject"), "subject", "left_semi")


def leading_contradictions(contradictions: DataFrame, at_least: int, missing: DataFrame) -> DataFrame:
    """Contradictions that stand in a plan or register first, then file order: as many as there are missing items, but ``at_least`` so many.

    ``contradictions`` (id, position, in_plan). The number is known only after ``missing`` is counted, so rows are ranked, not limited.
    """
    lead = F.when(F.coalesce("in_plan", F.lit(False)), 2.0**52).otherwise(0.0)  # above every position, and exact beside it
    ranked = global_rank(contradictions.withColumn("_first", lead - F.col("position")), "_first", F.col("id"), "shown")
    rows = missing.agg(F.greatest(F.count(F.lit(1)), F.lit(at_least).cast("long")).alias("_rows"))
    return ranked.join(F.broadcast(rows), F.col("shown") <= F.col("_rows")).drop("_rows", "_first")
