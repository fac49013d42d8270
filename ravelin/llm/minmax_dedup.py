"""Near-duplicate documents by min-max hashing.

Every hash function is evaluated once per shingle and gives two signature values, the minimum and the maximum over the document, so a
signature of ``2 * HASHES`` values costs half the evaluations. Both halves are cut into bands; documents that share a band are candidates.

Steps, none of which moves texts between tasks:

1. one scan gives per row the number of distinct shingles, a fingerprint of the shingle set and the band keys;
2. rows of equal sets form a class (similarity 1); only classes go on;
3. every band bucket links each class to its hub, the class with the largest buckets in all (a star, never all pairs); links are confirmed on the full sets, which a
   second scan makes for the classes that are in such a link;
4. components of the confirmed links. A bucket that still holds several components may hide a link between classes that are both no star
   centre. For the classes of such buckets, pairs of different components are found by a join on the rarest shingles of their sets, under
   bounds that no real link fails. They are confirmed the same way, and the components made again.

A pair at the threshold itself is a candidate with probability 1 - (1 - 0.8**4)**24 = 0.999997; more similar pairs with a higher one.

Defined results: null or wordless text has 0 shingles and links with nothing, its own id is its component; fewer words than ``words`` give
one shingle of the whole sequence; repeated rows and ids are separate rows of one component. Ids that are null never name a component:
a component without any id has a null ``component_id`` and its rows are kept. Columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm import wordhash as W
from ravelin.llm.bitmaps import bit_filter, passes
from ravelin.llm.graphs import components
from ravelin.llm.registry import query, table
from ravelin.llm.storage import written

WORDS = 4
PERCENT = 80
#: 48 functions give 96 values: 12 bands of 4 minima and 12 bands of 4 maxima.
HASHES, ROWS_PER_BAND = 48, 4
_DRAWN = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 64, 2 * HASHES, dtype=np.uint64)
FLIPS, FACTORS = _DRAWN[:HASHES], _DRAWN[HASHES:] | np.uint64(1)


class Shingles:
    """Distinct shingle hashes of the rows of a slice, sorted within each row; ``first`` bounds the rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        words = W.words_of(data, offsets, W.BLANKS)
        counts = words.counts()
        hashes, at = W.windows(words, size)
        rows = words.row[at]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            extra = np.zeros(len(short), W.U64)
            for i in range(size - 1):
                has = counts[short] > i
                extra[has] += words.hashes[words.first[short[has]] + i] * W.STEPS[i]
            extra = W.mix(extra ^ counts[short].astype(W.U64))
            hashes, rows = np.concatenate([hashes, extra]), np.concatenate([rows, short])
            order = np.argsort(rows, kind="stable")
            hashes, rows = hashes[order], rows[order]
        first = np.searchsorted(rows, np.arange(len(counts) + 1))
        for s, e in zip(first[:-1], first[1:]):
            hashes[s:e].sort()
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        self.hashes, rows = hashes[keep], rows[keep]
        self.first = np.searchsorted(rows, np.arange(len(counts) + 1))
        self.counts = np.diff(self.first)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two order-free 64-bit sums per row; 0 for rows without shingles."""
        out = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            sums = np.zeros(len(self.hashes) + 1, W.U64)
            np.cumsum(W.mix(self.hashes ^ W.U64(salt)), out=sums[1:])
            out.append(sums[self.first[1:]] - sums[self.first[:-1]])
        return out[0], out[1]

    def bands(self) -> np.ndarray:
        """Band keys, one line per row that has shingles."""
        starts = self.first[:-1][self.counts > 0]
        values = np.empty((2, HASHES, len(starts)), W.U64)
        for k in range(HASHES):
            x = (self.hashes ^ FLIPS[k]) * FACTORS[k]
            x ^= x >> W.U64(32)
            x *= FACTORS[-k - 1]
            np.minimum.reduceat(x, starts, out=values[0, k])
            np.maximum.reduceat(x, starts, out=values[1, k])
        grouped = values.reshape(2 * HASHES // ROWS_PER_BAND, ROWS_PER_BAND, len(starts))
        keys = np.arange(len(grouped), dtype=W.U64)[:, None] + np.zeros(len(starts), W.U64)
        for i in range(ROWS_PER_BAND):
            keys = W.mix(keys * W.STEPS[i] + grouped[:, i])
        return keys.T


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values.reshape(-1).view(np.int64)))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def signatures(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """doc_id, text_hash, fp1, fp2, n, bands."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in W.text_slices(batch.column(1)):
                s = Shingles(data, offsets, size)
                fp1, fp2 = s.fingerprints()
                keys = s.bands()
                rows = batch.slice(start, stop - start)
                counts = np.where(s.counts > 0, keys.shape[1], 0)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), _signed(fp1), _signed(fp2), pa.array(s.counts.astype(np.int64)), _lists(np.ascontiguousarray(keys), counts)],
                    names=["doc_id", "text_hash", "fp1", "fp2", "n", "bands"],
                )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("text_hash"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(scan, f"doc_id {kind}, text_hash long, fp1 long, fp2 long, n long, bands array<long>")


def shingle_sets(docs: DataFrame, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """cls, n, shingles of the classes in ``wanted`` (text_hash, fp1, fp2, cls, n)."""
    bitmap = bit_filter(wanted, "text_hash")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            hashes = batch.column(1).to_numpy()
            hit = np.flatnonzero(passes(bitmap.value, hashes.view(np.uint64)))
            hit = [i for i in hit.tolist() if hashes[i] not in seen and not seen.add(hashes[i])]
            if not hit:
                continue
            some = batch.take(pa.array(hit))
            for start, stop, data, offsets in W.text_slices(some.column(0)):
                s = Shingles(data, offsets, size)
                fp1, fp2 = s.fingerprints()
                yield pa.RecordBatch.from_arrays(
                    [some.column(1).slice(start, stop - start), _signed(fp1), _signed(fp2), _lists(s.hashes, s.counts)],
                    names=["text_hash", "fp1", "fp2", "shingles"],
                )

    narrow = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("text_hash"))
    made = narrow.mapInArrow(scan, "text_hash long, fp1 long, fp2 long, shingles array<long>")
    return made.join(wanted, ["text_hash", "fp1", "fp2"]).select("cls", "n", "shingles").dropDuplicates(["cls"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets are similar enough."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(shared * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b")


def link_classes(docs: DataFrame, text: str, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root) over classes that have a confirmed link to another class."""
    similar_size = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    rows = classes.where("n > 0").select(F.explode("bands").alias("key"), "cls", "n")
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = written(rows.join(shared, "key"), "rows")
    # the centre of a family is in most of its buckets: the class with the largest buckets in all is the best hub
    weight = rows.groupBy("cls").agg(F.sum("size").alias("weight"))
    weighed = written(rows.join(weight, "cls").select("key", "cls", "n", "weight"), "weighed")
    best = F.max(F.struct("weight", (-F.col("cls")).alias("cls"), "n"))
    hubs = weighed.groupBy("key").agg(best.alias("h")).select("key", (-F.col("h.cls")).alias("hub"), F.col("h.n").alias("hub_n"))
    buckets = written(weighed.join(hubs, "key").select("key", "cls", "n", "hub", "hub_n"), "buckets")
    # one row per key in hubs, many in rows: the pairs are as many as the bucket rows
    star = buckets.where((F.col("cls") != F.col("hub")) & similar_size(F.col("n"), F.col("hub_n")))
    star = written(star.select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), "star")
    named = buckets.select("cls").distinct()
    wanted = classes.join(named, "cls", "left_semi").select("text_hash", "fp1", "fp2", "cls", "n")
    sets = written(shingle_sets(docs, text, size, wanted), "sets")
    links = written(_confirmed(star, sets, percent), "links")
    roots = components(links)

    marked = buckets.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = marked.groupBy("key").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least <> _most").select("key")
    open_rows = written(marked.join(mixed, "key"), "open")
    more = written(_confirmed(_rest(open_rows, sets, percent), sets, percent), "links")
    return roots if more.isEmpty() else components(links.union(more))


def _rest(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open classes of different components that may be similar enough, by prefixes of their sets.

    Shingles are ordered by the number of open classes that have them. Two similar sets share a shingle among the first ones of both, and
    from the place of the first shared one on there must be enough shingles left; both are conditions of the join itself.
    """
    names = written(open_rows.select("cls", "n", "root").distinct(), "open")
    each = sets.join(names, "cls", "left_semi").select("cls", F.explode("shingles").alias("shingle"))
    shared = written(each.groupBy("shingle").agg(F.count("*").alias("df"), F.min("cls").alias("cls")), "shared")
    alone = shared.where("df = 1").groupBy("cls").agg(F.count("*").alias("alone"))
    able = names.join(alone, "cls", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    able = written(able.where((F.col("n") - F.col("alone")) * 100 >= F.col("n") * percent), "able")
    tokens = sets.join(able, "cls").select("cls", able["n"], "root", "alone", F.explode("shingles").alias("shingle")).join(shared.where("df > 1").select("shingle", "df"), "shingle")
    tokens = tokens.withColumn("place", F.col("alone") + F.row_number().over(Window.partitionBy("cls").orderBy("df", "shingle")))
    prefix = written(tokens.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("shingle", "cls", "n", "root", "place"), "prefix")
    x, y = (prefix.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "root", "place"))) for s in "xy")
    left = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) + 1
    near = (F.col("cls_x") < F.col("cls_y")) & (F.col("root_x") != F.col("root_y")) & (left * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent)
    pairs = x.join(y, (x["shingle"] == y["shingle"]) & near).select(F.col("cls_x").alias("a"), F.col("cls_y").alias("b"))
    return written(pairs.distinct(), "rest")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_shingles, component_id, kept."""
    rows = written(signatures(docs, doc_id, text, size), "signatures")
    some = rows.where("n > 0")
    classes = some.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("least_id"), F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    roots = link_classes(docs, text, classes, size, percent)
    # only the classes of components of more than one class change their id
    linked = written(classes.join(roots.withColumnRenamed("node", "cls"), "cls").select("fp1", "fp2", "least_id", "root"), "linked")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = classes.select("fp1", "fp2", "least_id").join(linked.join(least, "root").select("fp1", "fp2", "component_id"), ["fp1", "fp2"], "left")
    ids = ids.select("fp1", "fp2", F.coalesce("component_id", "least_id").alias("component_id"))
    found = some.select("doc_id", "text_hash", "n", "fp1", "fp2").join(ids, ["fp1", "fp2"], "left")
    found = found.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.union(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, all columns as they were."""
    dropped = near_duplicates(docs, doc_id, text, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(dropped, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left_anti")


@query("op5_minmax_dedup")
def op5_minmax_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
