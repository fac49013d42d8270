"""Queries on a knowledge file built from the tables: integrity, reverse citations, chains of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators import knowledge
from ravelin.plans.registry import query
from ravelin.plans.search import CMP_SQL
from ravelin.sources.tables import Tables

SHAPE = knowledge.Shape(
    sections=("answers", "facts", "contradictions", "glossary"),
    cited={"answers": ("evidence",), "facts": ("evidence",), "contradictions": ("version_a", "version_b")},
    fields=("passage", "citation"),
)


def _source(number: Column) -> Column:
    return F.concat(F.lit("src"), number.cast("string"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _entries(t: Tables) -> DataFrame:
    """Answers with two ids exchanged and one left out, facts that name sources, contradictions, and a section nobody asked for."""
    i, d = F.col("item_id"), F.col("doc_id")
    part = lambda df, section, position, name, sources: df.select(
        F.lit(section).alias("section"), position.cast("long").alias("position"), name.alias("id"), sources.alias("sources")
    )
    swapped = F.when(i == 7, 8).when(i == 8, 7).otherwise(i)
    answers = part(t.benchmark.where(i != 11), "answers", i, F.concat(F.lit("Q"), swapped.cast("string")), _none())
    sources = F.when(d % 43 == 0, F.array(_source(d % 20), F.lit("elsewhere"))).otherwise(F.array(_source(d % 20)))
    facts = part(t.labels, "facts", d, F.concat(F.lit("F"), d.cast("string")), sources)
    c = F.col("conv_id")
    disputes = part(t.conversations.where("turn = 1"), "contradictions", c, F.concat(F.lit("C"), c.cast("string")), _none())
    notes = part(t.supplier, "notes", F.col("s_suppkey"), F.concat(F.lit("N"), F.col("s_suppkey").cast("string")), _none())
    return answers.unionByName(facts).unionByName(disputes).unionByName(notes)


def _citations(t: Tables) -> DataFrame:
    """Citations of the first 30 characters of a document, some left out, of another shape, or not proved by their passage."""
    sound = F.array(F.lit("passage"), F.lit("citation"))
    part = lambda df, section, number, field, fields=sound: df.select(
        F.lit(section).alias("section"), number.cast("long").alias("position"), F.lit(field).alias("field"), fields.alias("fields"),
    )
    i, d, c = F.col("item_id"), F.col("doc_id"), F.col("conv_id")
    odd = F.when(d % 17 == 0, F.array(F.lit("passage"), F.lit("citation"), F.lit("page"))).otherwise(sound)
    disputes = t.conversations.where("turn = 1")
    cites = part(t.labels.where(d % 29 != 0), "facts", d, "evidence", odd).unionByName(
        part(t.benchmark.where(i % 10 != 4), "answers", i, "evidence")
    ).unionByName(part(disputes, "contradictions", c, "version_a")).unionByName(part(disputes.where(c % 3 != 1), "contradictions", c, "version_b"))
    n, fact = F.col("position"), F.col("section") == "facts"
    start = t.documents.select(d.alias("position"), F.substring(F.trim("text"), 1, 30).alias("start"))
    quote = F.when(fact & (n % 41 == 0), " ").when(fact & (n % 23 == 0), "§ absent §").otherwise(F.col("start"))
    return cites.join(start, "position").select(
        "section", "position", "field", "fields", F.when(fact & (n % 37 == 0), -1).otherwise(n).alias("passage"), quote.alias("quote")
    )


@query(
    "dq07_knowledge_file",
    f"""WITH d AS (SELECT doc_id, {CMP_SQL.format(c='text')} AS h, substr(trim(text), 1, 30) AS start FROM documents),
    e AS (SELECT 'answers' AS section, item_id AS position, 'Q' || CASE item_id WHEN 7 THEN 8 WHEN 8 THEN 7 ELSE item_id END AS id FROM benchmark WHERE item_id <> 11
      UNION ALL SELECT 'facts', doc_id, 'F' || doc_id FROM labels UNION ALL SELECT 'contradictions', conv_id, 'C' || conv_id FROM conversations WHERE turn = 1
      UNION ALL SELECT 'notes', s_suppkey, 'N' || s_suppkey FROM supplier),
    x AS (SELECT item_id AS position, 'Q' || item_id AS id FROM benchmark UNION ALL SELECT item_id + 1000, 'Q' || (item_id + 1000) FROM benchmark WHERE item_id % 20 = 0),
    c0 AS (SELECT 'facts' AS section, doc_id AS position, 'evidence' AS field, doc_id % 17 = 0 AS odd FROM labels WHERE doc_id % 29 <> 0
      UNION ALL SELECT 'answers', item_id, 'evidence', false FROM benchmark WHERE item_id % 10 <> 4
      UNION ALL SELECT 'contradictions', conv_id, 'version_a', false FROM conversations WHERE turn = 1
      UNION ALL SELECT 'contradictions', conv_id, 'version_b', false FROM conversations WHERE turn = 1 AND conv_id % 3 <> 1),
    c AS (SELECT c0.*, section || '.' || position || '.' || field AS place, h, CASE WHEN section = 'facts' AND position % 37 = 0 THEN -1 ELSE position END AS passage,
      CASE WHEN section = 'facts' AND position % 41 = 0 THEN ' ' WHEN section = 'facts' AND position % 23 = 0 THEN '§ absent §' ELSE start END AS quote FROM c0 JOIN d ON doc_id = position),
    p AS (SELECT *, CASE WHEN passage = -1 THEN 'unknown passage' WHEN trim(quote) = '' THEN 'empty quote' WHEN NOT contains(h, {CMP_SQL.format(c='quote')}) THEN 'quote not found' END AS problem FROM c),
    due AS (SELECT section, position, 'evidence' AS field FROM e WHERE section IN ('answers', 'facts')
      UNION ALL SELECT section, position, unnest(['version_a', 'version_b']) FROM e WHERE section = 'contradictions')
    SELECT 'missing section' AS rule, 'glossary' AS "where", NULL AS detail
    UNION ALL SELECT DISTINCT 'unexpected section', section, NULL FROM e WHERE section = 'notes'
    UNION ALL SELECT 'id out of order', 'answers.' || coalesce(x.position, a.position), coalesce(x.id, '-') || ' / ' || coalesce(a.id, '-') FROM x
      FULL JOIN (SELECT * FROM e WHERE section = 'answers') a USING (position) WHERE x.id IS DISTINCT FROM a.id
    UNION ALL SELECT 'no citation', section || '.' || position || '.' || field, NULL FROM due ANTI JOIN c USING (section, position, field)
    UNION ALL SELECT 'citation shape', place, 'citation,page,passage' FROM c WHERE odd
    UNION ALL SELECT 'unknown source described', 'ghost', NULL
    UNION ALL SELECT DISTINCT 'source without description', source, NULL FROM documents WHERE source = 'src3'
    UNION ALL SELECT 'unknown source named', 'facts.' || doc_id, s FROM (SELECT doc_id, 'src' || (doc_id % 20) AS s FROM labels UNION ALL SELECT doc_id, 'elsewhere' FROM labels WHERE doc_id % 43 = 0)
      WHERE s NOT IN (SELECT source FROM documents)
    UNION ALL SELECT 'evidence', place, passage || ': ' || problem FROM p WHERE problem IS NOT NULL""",
)
def knowledge_file(t: Tables) -> DataFrame:
    """Every breach of a file with one planted for each rule."""
    entries, i = _entries(t), F.col("item_id")
    wanted = lambda df, n: df.select(F.lit("answers").alias("section"), n.cast("long").alias("position"), F.concat(F.lit("Q"), n.cast("string")).alias("id"))
    expected = wanted(t.benchmark, i).unionByName(wanted(t.benchmark.where(i % 20 == 0), i + 1000))
    known = t.documents.select("source").distinct()
    described = known.where("source <> 'src3'").unionByName(t.region.limit(1).select(F.lit("ghost").alias("source")))
    passages = t.documents.select(F.col("doc_id").alias("id"), "text")
    return knowledge.integrity(entries.select("section"), entries, _citations(t), expected, passages, described, known, SHAPE)


@query(
    "joi36_cited_by",
    f"""WITH p AS (SELECT doc_id AS id, source, {CMP_SQL.format(c='text')} AS h, doc_id % 50 + 1 AS line, doc_id % 7 AS part FROM documents),
    r AS (SELECT 'answer' AS kind, item_id AS item, 0 AS position, NULL AS named, NULL AS locator, {CMP_SQL.format(c='text')} AS quote, NULL AS pid, NULL AS a, NULL AS b, NULL AS part FROM benchmark
      UNION ALL SELECT 'action', conv_id, 0, 'src' || (conv_id % 25), 'ligne ' || (conv_id % 50 + 1), NULL, NULL, conv_id % 50 + 1, conv_id % 50 + 1, NULL FROM conversations WHERE turn = 0
      UNION ALL SELECT 'action', conv_id, 1, 'src' || ((conv_id + 1) % 25), NULL, NULL, NULL, NULL, NULL, NULL FROM conversations WHERE turn = 0
      UNION ALL SELECT 'decision', doc_id, 0, NULL, NULL, NULL, doc_id, NULL, NULL, NULL FROM labels WHERE toxic = 1
      UNION ALL SELECT 'decision', doc_id, 1, 'src' || (doc_id % 20), 'partie' || (doc_id % 7), NULL, NULL, NULL, NULL, doc_id % 7 FROM labels WHERE toxic = 1
      UNION ALL SELECT 'event', event_id, 0, 'src' || (user_id % 20), 'lignes ' || (user_id % 50 + 1), NULL, NULL, user_id % 50 + 1, user_id % 50 + 2, NULL FROM events WHERE event_type = 'error'),
    t AS (SELECT DISTINCT named, quote, pid, a, b, part FROM r),
    hit AS (SELECT t.*, p.source, p.id FROM t JOIN p ON p.id = t.pid UNION ALL SELECT t.*, p.source, p.id FROM t JOIN p ON contains(p.h, t.quote) WHERE t.quote <> ''
      UNION ALL SELECT t.*, p.source, p.id FROM t JOIN p ON p.source = t.named AND p.line BETWEEN t.a AND t.b
      UNION ALL SELECT t.*, p.source, p.id FROM t JOIN p ON p.source = t.named AND p.part = t.part),
    f AS (SELECT named, quote, pid, a, b, part, source, count(*) AS n, min(id) AS first FROM hit GROUP BY ALL),
    l AS (SELECT coalesce(r.named, f.source) AS source, kind, item, position, locator, coalesce(n, 0) AS n_passages, first AS first_passage FROM r LEFT JOIN f ON r.named IS NOT DISTINCT FROM f.named
        AND r.quote IS NOT DISTINCT FROM f.quote AND r.pid IS NOT DISTINCT FROM f.pid AND r.a IS NOT DISTINCT FROM f.a AND r.b IS NOT DISTINCT FROM f.b AND r.part IS NOT DISTINCT FROM f.part
      WHERE coalesce(r.named, f.source) IN (SELECT source FROM documents))
    SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY source, kind, item ORDER BY position) = 1""",
)
def cited_by(t: Tables) -> DataFrame:
    """Answers by quote, actions and events by line, decisions by passage and by words of a locator."""
    line = lambda low, high: F.array(F.struct(low.cast("int").alias("first"), high.cast("int").alias("last")))
    no_lines, no_words = F.array().cast("array<struct<first:int,last:int>>"), _none()
    empty = F.lit(None).cast("string")

    def refs(df, kind, item, position, source=empty, locator=empty, passage=F.lit(None), quote=F.lit(""), lines=no_lines, words=no_words):
        return df.select(
            F.lit(kind).alias("kind"), item.cast("long").alias("item"), F.lit(position).alias("position"), source.alias("source"),
            locator.alias("locator"), passage.cast("long").alias("passage_id"), quote.alias("quote"), lines.alias("lines"), words.alias("words"),
        )

    i, c, d, u = F.col("item_id"), F.col("conv_id"), F.col("doc_id"), F.col("user_id")
    at = lambda n: (n % 50 + 1).cast("string")
    opened, toxic, errors = t.conversations.where("turn = 0"), t.labels.where("toxic = 1"), t.events.where("event_type = 'error'")
    word = F.concat(F.lit("partie"), (d % 7).cast("string"))
    parts = [
        refs(t.benchmark, "answer", i, 0, quote=F.col("text")),
        refs(opened, "action", c, 0, _source(c % 25), F.concat(F.lit("ligne "), at(c)), lines=line(c % 50 + 1, c % 50 + 1)),
        refs(opened, "action", c, 1, _source((c + 1) % 25)),
        refs(toxic, "decision", d, 0, passage=d),
        refs(toxic, "decision", d, 1, _source(d % 20), word, words=F.array(word)),
        refs(errors, "event", F.col("event_id"), 0, _source(u % 20), F.concat(F.lit("lignes "), at(u)), lines=line(u % 50 + 1, u % 50 + 2)),
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    locator = F.concat(F.lit("section partie"), (d % 7).cast("string"), F.lit(" "), F.col("lang"))
    return knowledge.cited_by(both, t.documents.select(d.alias("id"), "source", "text", (d % 50 + 1).alias("line"), locator.alias("locator")))


@query(
    "top14_condition_steps",
    """WITH s AS (SELECT o_orderkey AS condition, unnest([o_custkey, o_custkey + 1, o_orderkey]) AS action, unnest([0, 1, 2]) AS step FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT condition, step, action, CASE WHEN c_custkey IS NULL THEN 'not documented' ELSE c_name END AS label,
      CASE WHEN c_custkey IS NULL THEN 'neutral' WHEN c_acctbal < 0 THEN 'critical' ELSE 'positive' END AS tone
    FROM s LEFT JOIN customer ON c_custkey = action AND c_custkey % 7 <> 0""",
)
def condition_steps(t: Tables) -> DataFrame:
    """Steps of every urgent condition; the register of actions lacks some."""
    ids = F.array(F.col("o_custkey"), F.col("o_custkey") + 1, F.col("o_orderkey"))
    conditions = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("condition"), ids.alias("action_ids"))
    tone = F.when(F.col("c_acctbal") < 0, "critical").otherwise("positive")
    actions = t.customer.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("action"), F.col("c_name").alias("label"), tone.alias("tone"))
    return knowledge.condition_chains(conditions, actions)


@query(
    "top14_missing_and_contradictions",
    """WITH m AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)),
    c AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority <> '2-HIGH', o_orderkey) AS shown FROM orders WHERE o_orderstatus = 'F')
    SELECT 'missing' AS kind, o_orderkey AS id, NULL AS shown FROM m
    UNION ALL SELECT 'contradiction', o_orderkey, shown FROM c WHERE shown <= (SELECT greatest(4, count(*)) FROM m)""",
)
def missing_and_contradictions(t: Tables) -> DataFrame:
    """Missing items tied to a condition, and as many contradictions, those of the plan first."""
    conditions = t.orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000").select(F.col("o_custkey").alias("subject"))
    entries = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("id"))
    missing = knowledge.condition_missing(entries, conditions)
    disputes = t.orders.where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("position"), (F.col("o_orderpriority") == "2-HIGH").alias("in_plan")
    )
    shown = knowledge.leading_contradictions(disputes, 4, missing)
    return missing.select(F.lit("missing").alias("kind"), "id", F.lit(None).cast("long").alias("shown")).unionByName(
        shown.select(F.lit("contradiction").alias("kind"), "id", F.col("shown").cast("long").alias("shown"))
    )
