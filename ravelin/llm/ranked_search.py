"""Ranked lexical search of stated queries over all documents by dense blocked multiplication.

The queries' own words are the whole vocabulary that matters. It is numbered compactly and cut into tiles; a slice of documents gives, per
tile, a dense matrix of impacts (documents x tile words), and a BLAS product with the queries' weights (tile words x queries) adds to the
scores. Weights and impacts are integers held in float64: a tile is closed before any query's largest possible sum reaches 2**53, so every
product is exact in whatever order BLAS adds; tiles are added in 64-bit integers. One word whose own weight passes the bound stands in
several tiles with parts of it.

1. A scan counts documents with words, words, and the documents that hold each query word (one row per task and word, then summed).
2. A second scan scores. A task keeps each query's ``k`` best so far; a slice only adds what reaches the k-th score, ties included, and
   ties go by document id, so what is kept doesn't depend on how rows are dealt. Spark ranks the tasks' lists.

Texts stay in the scans. Queries go in blocks of ``PAIRS`` (query, word) pairs, which are what is brought to the driver and broadcast:
16 bytes each, or one longer query. Words are equal by their 64-bit hashes.

Defined results: null and wordless texts have no terms and no place in the counts; wordless queries give no rows; each row of the queries
is a query of its own, whatever its id; repeated documents are ranked each; null document ids come first among equal scores. Other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm import wordhash as W
from ravelin.llm.registry import query, table
from ravelin.llm.storage import written

TOP = 10
PAIRS = 1 << 20
TILE_WORDS = 512
EXACT = 1 << 53
#: An impact is at most this: (10**9 * tf) div (1000 * tf + 8 * m) with m > 0.
MAX_IMPACT = 10**6
NO_ID = np.iinfo(np.int64).min


@dataclass
class Tile:
    """Words ``at`` of the vocabulary, and the queries' weights for them (words x queries)."""

    at: np.ndarray
    weights: np.ndarray


def tiles_of(query_of: np.ndarray, word_of: np.ndarray, weight: np.ndarray, n_queries: int, limit: int = EXACT) -> list[Tile]:
    """Cut (query, word, weight) pairs into tiles whose sums of weight times impact stay below ``limit``."""
    most = (limit - 1) // MAX_IMPACT
    tiles: list[Tile] = []
    while len(word_of):
        part = np.minimum(weight, most)
        words = np.unique(word_of)
        column = np.searchsorted(words, word_of)
        order = np.argsort(column, kind="stable")
        bounds = np.searchsorted(column[order], np.arange(len(words) + 1))
        start = 0
        while start < len(words):
            sums, stop = np.zeros(n_queries, np.int64), start
            while stop < len(words) and stop - start < TILE_WORDS:
                own = order[bounds[stop]:bounds[stop + 1]]
                if stop > start and (sums[query_of[own]] + part[own]).max() > most:
                    break
                sums[query_of[own]] += part[own]
                stop += 1
            own = order[bounds[start]:bounds[stop]]
            weights = np.zeros((stop - start, n_queries))
            weights[column[own] - start, query_of[own]] = part[own]
            tiles.append(Tile(words[start:stop], weights))
            start = stop
        rest = weight > part
        query_of, word_of, weight = query_of[rest], word_of[rest], (weight - part)[rest]
    return tiles


def _query_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("query")
        for start, stop, data, offsets in W.text_slices(batch.column("text")):
            words = W.words_of(data, offsets, W.NON_WORD)
            pairs, counts = np.unique(np.stack([words.row.astype(W.U64), words.hashes], 1), axis=0, return_counts=True)
            rows = ids.slice(start, stop - start).take(pa.array(pairs[:, 0].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([rows, pa.array(pairs[:, 1].view(np.int64)), pa.array(counts, pa.int64())], names=["query", "word", "uses"])


class Vocabulary:
    """The words of a block of queries, numbered in the order of their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.first = np.zeros(1 << 16, bool)
        self.first[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def counted(self, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word number, occurrences) of the slice's known words."""
        likely = np.flatnonzero(self.first[(words.hashes >> np.uint64(48)).astype(np.int64)])
        hashes = words.hashes[likely]
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[place] == hashes
        keys, counts = np.unique(words.row[likely[known]] * len(self.hashes) + place[known], return_counts=True)
        return keys // len(self.hashes), keys % len(self.hashes), counts


def _count(shared):
    """Rows (word number, documents); number -1 has the documents with words, -2 all words."""

    def run(batches):
        vocabulary = shared.value
        held = np.zeros(len(vocabulary.hashes), np.int64)
        docs = words_all = 0
        for batch in batches:
            for _, _, data, offsets in W.text_slices(batch.column(0)):
                words = W.words_of(data, offsets, W.NON_WORD)
                sizes = words.counts()
                docs += int((sizes > 0).sum())
                words_all += int(sizes.sum())
                _, number, _ = vocabulary.counted(words)
                held += np.bincount(number, minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()), pa.array([docs, words_all, *held[at].tolist()], pa.int64())], names=["number", "n"])

    return run


class Best:
    """Each query's ``k`` best documents so far: scores and ids, best first, score 0 where there are fewer."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.score = np.zeros((n_queries, k), np.int64)
        self.doc = np.full((n_queries, k), NO_ID, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores``: queries x documents. A document that ties with the k-th goes in if its id is smaller."""
        least = self.score[:, -1]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        reach = (scores >= least[:, None]) & (scores > 0)
        for q in np.flatnonzero(reach.any(1)):
            at = np.flatnonzero(reach[q])
            score, doc = np.r_[self.score[q], scores[q, at]], np.r_[self.doc[q], docs[at]]
            order = np.lexsort((doc, -score))[:self.k]
            self.score[q], self.doc[q] = score[order], doc[order]


def impacts(tf: np.ndarray, words: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Impact of ``tf`` occurrences in a document of ``words`` words; 64-bit integers, divisions round down."""
    m = 100 - 75 + (75 * words * n_docs) // n_words
    return (1000000000 * tf) // (1000 * tf + 8 * m)


def _score(shared, k):
    def run(batches):
        vocabulary, tiles, n_docs, n_words, n_queries = shared.value
        best = Best(n_queries, k)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for start, stop, data, offsets in W.text_slices(batch.column("text")):
                words = W.words_of(data, offsets, W.NON_WORD)
                row, number, tf = vocabulary.counted(words)
                if not len(row):
                    continue
                impact = impacts(tf, words.counts()[row].astype(np.int64), n_docs, n_words).astype(float)
                scores = np.zeros((n_queries, stop - start), np.int64)
                column = np.zeros(len(vocabulary.hashes), np.int64)
                for tile in tiles:
                    column[:] = -1
                    column[tile.at] = np.arange(len(tile.at))
                    own = np.flatnonzero(column[number] >= 0)
                    docs, place = np.unique(row[own], return_inverse=True)
                    dense = np.zeros((len(docs), len(tile.at)))
                    dense[place, column[number[own]]] = impact[own]
                    scores[:, docs] += (dense @ tile.weights).T.astype(np.int64)
                best.add(scores, ids[start:stop])
        q, at = np.nonzero(best.score > 0)
        doc = best.doc[q, at]
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(best.score[q, at])], names=["query", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, pairs, k: int) -> DataFrame:
    """Ranks for one block of queries; ``pairs``: pandas (query, word, uses)."""
    context = docs.sparkSession.sparkContext
    vocabulary = Vocabulary(pairs["word"].to_numpy(np.int64).view(np.uint64))
    queries, query_of = np.unique(pairs["query"].to_numpy(np.int64), return_inverse=True)
    counted = docs.select("text").mapInArrow(_count(context.broadcast(vocabulary)), "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).toPandas()
    totals = dict(zip(counted["number"].tolist(), counted["n"].tolist()))
    n_docs, n_words = totals.get(-1, 0), totals.get(-2, 0)
    word_of = np.searchsorted(vocabulary.hashes, pairs["word"].to_numpy(np.int64).view(np.uint64))
    idf = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * totals.get(i, 0) + 1))) for i in range(len(vocabulary.hashes))], np.int64)
    weight = idf[word_of] * pairs["uses"].to_numpy(np.int64)
    useful = weight > 0
    tiles = tiles_of(query_of[useful], word_of[useful], weight[useful], len(queries))
    shared = context.broadcast((vocabulary, tiles, n_docs, max(n_words, 1), len(queries)))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared, k), "query long, doc_id long, score long")
    names = docs.sparkSession.createDataFrame([(i, int(q)) for i, q in enumerate(queries)], "query long, uid long")
    return found.join(F.broadcast(names), "query").select("uid", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, key: str = "item_id", k: int = TOP) -> DataFrame:
    """(key, rank, doc_id, score): the ``k`` best documents of each query with a score above 0."""
    numbered = written(queries.select(F.col(key), F.monotonically_increasing_id().alias("query"), "text"), "search-queries")
    pairs = written(numbered.mapInArrow(_query_words, "query long, word long, uses long"), "search-words")
    blocks = max(1, math.ceil(pairs.count() / PAIRS))
    found = None
    for block in range(blocks):
        own = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        own = own.toPandas()
        if not len(own):
            continue
        ranked = _search_block(docs, own, k)
        found = ranked if found is None else found.union(ranked)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "uid long, doc_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(numbered.select(F.col("query").alias("uid"), key), "uid").select(key, "rank", "doc_id", "score")


SQL = r"""
WITH words AS (
    SELECT doc, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS doc, doc_id, text FROM documents)),
tf AS (SELECT doc, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY doc, term),
sizes AS (SELECT doc, count(*) AS n FROM words GROUP BY doc),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs),
item_rows AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
uses AS (
    SELECT item, any_value(item_id) AS item_id, term, count(*) AS uses FROM (
        SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM item_rows) GROUP BY item, term),
scores AS (
    SELECT item, any_value(u.item_id) AS item_id, doc, any_value(tf.doc_id) AS doc_id,
           sum(uses * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_words))))::BIGINT AS score
    FROM uses u JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc) CROSS JOIN totals GROUP BY item, doc)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


@query("op12_ranked_search", SQL)
def op12_ranked_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
