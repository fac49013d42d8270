"""Tiles, kept lists and blocks of the ranked search."""

import numpy as np

from ravelin.llm import ranked_search as R


def test_tiles_hold_every_weight_and_stay_exact():
    rng = np.random.default_rng(3)
    n = 3000
    query_of, word_of = rng.integers(0, 20, n), rng.integers(0, 900, n)
    keys = np.unique(query_of * 900 + word_of)
    query_of, word_of = keys // 900, keys % 900
    weight = rng.integers(1, 40, len(keys))
    weight[5] = 1000
    limit = 60 * R.MAX_IMPACT
    tiles = R.tiles_of(query_of, word_of, weight, 20, limit)
    total = np.zeros((900, 20))
    for tile in tiles:
        assert len(tile.at) <= R.TILE_WORDS
        assert tile.weights.sum(0).max() * R.MAX_IMPACT < limit
        total[tile.at] += tile.weights
    want = np.zeros((900, 20))
    want[word_of, query_of] = weight
    assert (total == want).all()


def test_kept_lists_do_not_depend_on_the_slices():
    rng = np.random.default_rng(4)
    scores, docs = rng.integers(0, 6, (7, 300)), rng.permutation(300)
    docs[9] = R.NO_ID
    found = []
    for size in (1, 7, 300):
        best = R.Best(7, 10)
        for i in range(0, 300, size):
            best.add(scores[:, i:i + size], docs[i:i + size])
        found.append((best.score, best.doc))
    for q in range(7):
        want = sorted(((-s, d) for s, d in zip(scores[q].tolist(), docs.tolist()) if s > 0))[:10]
        for score, doc in found:
            assert [(-s, d) for s, d in zip(score[q].tolist(), doc[q].tolist()) if s > 0] == want


def test_blocks_of_queries_give_the_same_rows(spark, edge_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{edge_dir}/documents.parquet"), spark.read.parquet(f"{edge_dir}/benchmark.parquet")
    whole = sorted(map(repr, R.search(docs, items).collect()))
    monkeypatch.setattr(R, "PAIRS", 20)
    assert sorted(map(repr, R.search(docs, items).collect())) == whole
