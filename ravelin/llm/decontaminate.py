"""Benchmark decontamination: which documents hold word windows of benchmark items, found by a prefix-filtered join.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one window). Every window is a small ordered set of shingles of
``TOKEN`` words. For exact containment the necessary prefix of a set is its first element in a global order; the order is by rarity in
the documents, so each window is looked up by its rarest shingle only:

1. a scan counts the item shingles over all documents (documents only report shingles that the items have);
2. each window keeps its rarest shingle as its prefix token, with the token's place in the window;
3. a scan reports, for every place where a document has a prefix token, the hashes of the words around it;
4. places join windows on the token. The length bound (a window must fit into the document) and the positional bound (it must start at
   or after the first word) come before the check that all words of the window stand there.

Texts stay in the scans. Documents report through a bit filter of fixed size; it only saves rows, the joins decide. A frequent token is
one key of many places; only the join sees it, which Spark can split.

Defined results: null or wordless texts have 0 words and no hits; items without words have no window; equal windows of several items
count for each; repeated rows of either table are separate rows, an item id that repeats counts once; null ids are kept in documents, and
null item ids are ignored. Columns of the documents named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm import wordhash as W
from ravelin.llm.bitmaps import bit_filter, passes
from ravelin.llm.registry import query, table
from ravelin.llm.storage import written

WINDOW = 10
TOKEN = 3


def _lists(flat: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), flat)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _text(df: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).alias("text")


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, words: the word hashes of each item in order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in W.text_slices(batch.column(1)):
                w = W.words_of(data, offsets, W.NON_WORD)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), _lists(_signed(w.hashes), w.counts())], names=["item_id", "words"])

    some = items.select(F.col(item_id).alias("item_id"), _text(items, text)).where("item_id is not null")
    return some.mapInArrow(scan, f"item_id {some.schema['item_id'].dataType.simpleString()}, words array<long>")


def item_windows(words: DataFrame, window: int) -> DataFrame:
    """item_id, window (list of word hashes): distinct windows of the items."""
    long = F.size("words") >= window
    starts = F.when(long, F.sequence(F.lit(1), F.size("words") - window + 1)).otherwise(F.array(F.lit(1)))
    rows = words.where(F.size("words") > 0).select("item_id", "words", F.explode(starts).alias("start"))
    return rows.select("item_id", F.slice("words", F.col("start"), window).alias("window")).distinct()


def window_tokens(windows: DataFrame) -> DataFrame:
    """One row per shingle of a window: item_id, window, place of the shingle, token (its word hashes)."""
    size = F.least(F.lit(TOKEN), F.size("window"))
    places = windows.select("item_id", "window", F.explode(F.sequence(F.lit(0), F.size("window") - size)).alias("place"))
    return places.select("item_id", "window", "place", F.slice("window", F.col("place") + 1, TOKEN).alias("token"))


def keyed(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``key``, the hash that the scans compute for the same words, and ``size``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(names.index("token"))
            ends = words.offsets.to_numpy().astype(np.int64)
            flat = words.values.to_numpy().view(np.uint64)
            sizes = np.diff(ends)
            total = np.zeros(len(sizes), W.U64)
            for i in range(TOKEN):
                has = sizes > i
                total[has] += flat[ends[:-1][has] + i] * W.STEPS[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, _signed(W.mix(total ^ sizes.astype(W.U64))), pa.array(sizes.astype(np.int32))], names=[*names, "key", "size"])

    names = tokens.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(scan, f"{kinds}, key long, size int")


def _found(words: W.Words, sizes: list[int], bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, word index) of the runs that the bit filter may hold, by size."""
    for size in sizes:
        keys, at = W.windows(words, size)
        hit = passes(bitmap, keys)
        yield keys[hit], at[hit]


def token_counts(docs: DataFrame, text: str, keys: DataFrame, sizes: list[int]) -> DataFrame:
    """key, total: how often each key of ``keys`` occurs in all documents."""
    bitmap = bit_filter(keys, "key")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in W.text_slices(batch.column(0)):
                words = W.words_of(data, offsets, W.NON_WORD)
                for found, _ in _found(words, sizes, bitmap.value):
                    key, count = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([_signed(key), pa.array(count.astype(np.int64))], names=["key", "n"])

    seen = docs.select(_text(docs, text)).mapInArrow(scan, "key long, n long").groupBy("key").agg(F.sum("n").alias("total"))
    return seen.join(keys, "key", "left_semi")


def places(docs: DataFrame, doc_id: str, text: str, keys: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """row, doc_id, n_words, found: list of (key, at, left, around) for each place of a key in the document.

    ``around``: hashes of the words from ``at - left`` to ``at + window - 1``, as far as the document goes; ``left`` < window.
    """
    bitmap = bit_filter(keys, "key")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in W.text_slices(batch.column(1)):
                words = W.words_of(data, offsets, W.NON_WORD)
                found = [np.concatenate(x) for x in zip(*_found(words, sizes, bitmap.value))]
                order = np.argsort(found[1], kind="stable")
                key, at = found[0][order], found[1][order]
                row = words.row[at]
                low = np.maximum(words.first[row], at - window + 1)
                high = np.minimum(words.first[row + 1], at + window)
                long = high - low
                ends = np.cumsum(long)
                flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - long), long)
                structs = pa.StructArray.from_arrays(
                    [_signed(key), pa.array(at - words.first[row]), pa.array((at - low).astype(np.int32)), _lists(_signed(words.hashes[flat]), long)],
                    names=["key", "at", "left", "around"],
                )
                each = np.bincount(row, minlength=stop - start)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(words.counts().astype(np.int64)), _lists(structs, each)], names=["doc_id", "n_words", "found"])

    some = docs.select(F.col(doc_id).alias("doc_id"), _text(docs, text))
    kind = some.schema["doc_id"].dataType.simpleString()
    rows = some.mapInArrow(scan, f"doc_id {kind}, n_words long, found array<struct<key:long,at:long,left:int,around:array<long>>>")
    return rows.withColumn("row", F.monotonically_increasing_id())


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (sorted list of item ids as text), spans (list of first word, word after the last)."""
    tokens = written(keyed(window_tokens(item_windows(item_words(items, item_id, item_text), window))), "tokens")
    sizes = [r["size"] for r in tokens.select("size").distinct().collect()] or [TOKEN]
    keys = tokens.select("key").distinct()
    totals = written(token_counts(docs, text, keys, sizes), "totals")
    rarity = F.struct(F.coalesce("total", F.lit(0)), "key", "place")
    best = tokens.join(totals, "key", "left").where("total > 0").groupBy("item_id", "window").agg(F.min(F.struct(rarity.alias("r"), F.col("place").alias("place"), F.col("key").alias("key"))).alias("b"))
    prefixes = written(best.select("item_id", "window", F.col("b.place").alias("place"), F.col("b.key").alias("key")), "prefixes")

    rows = written(places(docs, doc_id, text, prefixes.select("key").distinct(), sizes, window), "places")
    spots = rows.where(F.size("found") > 0).select("row", "n_words", F.inline("found"))
    size = F.size("window")
    start = F.col("at") - F.col("place")
    fits = (F.col("left") >= F.col("place")) & (start + size <= F.col("n_words"))
    same = F.slice("around", F.col("left") - F.col("place") + 1, size) == F.col("window")
    hits = spots.join(prefixes, "key").where(fits).where(same)
    per_row = hits.select("row", F.col("item_id").cast("string").alias("item"), start.alias("first"), (start + size).alias("after")).groupBy("row").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set(F.struct("first", "after"))).alias("found_spans")
    )
    # words inside any window: fold the sorted windows, each adds what lies beyond the furthest end so far
    covered = F.aggregate(
        "found_spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["after"] - F.greatest(acc["to"], x["first"]))).alias("n"), F.greatest(acc["to"], x["after"]).alias("to")),
        lambda acc: acc["n"],
    )
    hit = per_row.select("row", "items", F.col("found_spans").alias("spans"), covered.alias("n_hit"))
    out = rows.select("row", "doc_id", "n_words").join(hit, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", max_share: float = 0.0, **names) -> DataFrame:
    """``docs`` without the rows of which more than ``max_share`` of the words lie in benchmark windows."""
    keyed_docs = docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash")).alias("_key"), F.col(text).alias("_text"))
    found = contamination(keyed_docs, items, "_key", "_text", **names).where((F.col("n_hit") > 0) & (F.col("n_hit") > F.col("n_words") * max_share))
    bad = found.select(F.col("doc_id.id").alias("_id"), F.col("doc_id.hash").alias("_hash")).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left_anti")


SQL = r"""
    with w as (
        select 'd' as side, row_number() over () as rid, doc_id as id, coalesce(text, '') as text from documents
        union all select 'i', 0, item_id, coalesce(text, '') from benchmark where item_id is not null
    ), s as (
        select side, rid, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from w
    ), win as (
        select distinct id as item_id, least(len(w), 10) as n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') as k
        from s, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(p) where side = 'i' and len(w) > 0
    ), dwin as (
        select rid, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') as k
        from s cross join (select distinct n from win) l, unnest(range(1, greatest(1, len(w) - n + 2))) t(p) where side = 'd'
    ), hits as (
        select distinct rid, p, n, item_id from dwin join win using (n, k)
    ), words as (
        select rid, count(distinct p + i) as n_hit from hits, unnest(range(0, n)) t(i) group by rid
    ), found as (
        select rid, count(*) as n_items, string_agg(item, ',' order by item) as items
        from (select distinct rid, cast(item_id as varchar) as item from hits) group by rid
    )
    select id as doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
        sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from s left join words using (rid) left join found using (rid) where side = 'd'
"""


@query("op7_prefix_decontamination", SQL)
def op7_prefix_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
