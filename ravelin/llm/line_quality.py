"""Quality rules with built-in functions only: counts inside each text, and lines that repeat across the documents of a host.

Cross-document lines: a line is normalised (A-Z lower-cased, blanks collapsed), hashed, and its distinct documents are counted per host;
equal texts are one document, so plain copies don't make their lines frequent. A line is over the limit of its host when more than
``MIN_DOCS`` documents and more than ``MAX_SHARE`` of the host's documents have it. Such lines are removed, and a document that loses more
than half of its words is depleted and rejected.

Counts inside a text stay in the row: windows of three words are hashed, the hashes sorted with their places in the low bits, and equal
neighbours compared in full. Across documents only (host, line hash, document hash) is shuffled; distinct counts are taken in two steps
and the frequent lines are joined on (host, line), so that neither a large host nor a line that all documents have is one task.

Defined results: null text counts as empty (0 words, fails); a null host is a host of its own; repeated rows count once as documents but
each gets its row; extra columns stay, columns named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.registry import query, table
from ravelin.llm.storage import written

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
MIN_DOCS, MAX_SHARE = 20, 0.005
MAX_REMOVED_PERCENT = 50
#: Bits of the place in a sorted value; a text of 2 GB has fewer words.
PLACE_BITS = 30


def repeated_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more; ``words``: array of word hashes.

    Values that share the leading hash bits lie side by side, ordered by place; up to two neighbours on either side are compared in full.
    """
    places, leading = F.lit((1 << PLACE_BITS) - 1).cast("long"), F.lit(-(1 << PLACE_BITS)).cast("long")
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def repeated(all_hashes: Column) -> Column:
        packed = F.sort_array(F.transform(all_hashes, lambda h, i: h.bitwiseAND(leading).bitwiseOR(i.cast("long"))))

        def pick(values: Column) -> Column:
            full = lambda v: F.get(all_hashes, v.bitwiseAND(places).cast("int"))

            def equal(v: Column, j: Column) -> Column:
                other = F.get(values, j)
                return F.coalesce((F.shiftright(v, PLACE_BITS) == F.shiftright(other, PLACE_BITS)) & (full(v) == full(other)), F.lit(False))

            hit = F.filter(values, lambda v, i: (
                ((i > 0) & equal(v, F.greatest(i - 1, F.lit(0)))) | equal(v, i + 1) | ((i > 1) & equal(v, F.greatest(i - 2, F.lit(0)))) | equal(v, i + 2)
            ))
            at = F.transform(hit, lambda v: v.bitwiseAND(places).cast("int"))
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

        return F.get(F.transform(F.array(packed), pick), 0)

    return F.coalesce(F.get(F.transform(F.array(hashes), repeated), 0), F.lit(0))


def base_counts(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and ``_lines`` (line, words)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.transform(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    out = docs.withColumns({"_words": words, "_raw": lines})
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
        "_lines": F.transform("_raw", lambda x: F.struct(normalised(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"))),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    return out.withColumn("base_failed", failed).drop("_words", "_raw")


def normalised(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), r"[\x20\x09-\x0D]+", " ")))


def frequent_lines(rows: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """host, line over the limit; ``rows``: host, doc (hash of the text), lines."""
    documents = rows.groupBy("host").agg(F.count_distinct("doc").alias("docs"))
    each = rows.select("host", "doc", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count_distinct("doc").alias("n")).where(F.col("n") > min_docs)
    return counts.join(documents, "host").where(F.col("n") > F.col("docs") * max_share).select("host", "line")


def judge_lines(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``docs`` without its text, with the counts, ``removed_words`` and ``kept``."""
    counted = base_counts(docs.withColumn("_doc", F.xxhash64(text)), text).drop(text)
    rows = written(counted.withColumns({"_row": F.monotonically_increasing_id(), "_host": F.coalesce(F.col(host).cast("string"), F.lit("\u0000"))}), "lines")
    bad = frequent_lines(rows.select(F.col("_host").alias("host"), F.col("_doc").alias("doc"), F.col("_lines").alias("lines")), min_docs, max_share)
    lines = rows.select("_row", F.col("_host").alias("host"), F.inline("_lines"))
    removed = lines.join(bad, ["host", "line"]).groupBy("_row").agg(F.sum("words").alias("removed_words"))
    out = rows.join(removed, "_row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    depleted = F.col("removed_words") * 100 > F.col("n_words") * MAX_REMOVED_PERCENT
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_row", "_host", "_doc", "_lines")


SQL = rf"""
    with d as (
        select row_number() over () as rid, doc_id, coalesce(text, '') as text, source is null as no_host, coalesce(source, '') as host from documents
    ), w as (
        select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d
    ), tri as (
        select rid, p, w[p] as a, w[p + 1] as b, w[p + 2] as c from w, unnest(range(1, greatest(1, len(w) - 1))) t(p)
    ), rep as (
        select rid, count(distinct p + q) as n from (select rid, p, count(*) over (partition by rid, a, b, c) as k from tri), unnest(range(0, 3)) u(q) where k > 1 group by rid
    ), raw as (
        select rid, no_host, host, text, unnest(string_split(text, chr(10))) as line from d
    ), lines as (
        select *, trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) as norm,
            len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from raw where regexp_matches(line, '[^\x20\x09-\x0D]')
    ), dup as (
        select rid, count(*) - count(distinct line) as n from lines group by rid
    ), hosts as (
        select no_host, host, count(distinct text) as docs from d group by all
    ), bad as (
        select no_host, host, norm from (select no_host, host, norm, count(distinct text) as n from lines group by all) join hosts using (no_host, host)
        where n > {MIN_DOCS} and n > docs * {MAX_SHARE}
    ), lost as (
        select rid, sum(n) as n from lines join bad using (no_host, host, norm) group by rid
    ), counted as (
        select doc_id, cast(len(w) as bigint) as n_words, length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as word_chars,
            length(text) - length(translate(text, '{SYMBOLS}', '')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
            cast(coalesce(lost.n, 0) as bigint) as removed_words
        from w left join dup using (rid) left join rep using (rid) left join lost using (rid)
    )
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * removed_words <= {MAX_REMOVED_PERCENT} * n_words as kept
    from counted
"""


@query("op2_line_frequency", SQL)
def op2_line_frequency(spark, sf_dir):
    found = judge_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")
