"""The metric index beside a plain search over all pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ravelin.operators import vectors


def table(spark, rows, weights=None):
    data = [(i, [float(x) for x in v], float(w)) for i, (v, w) in enumerate(zip(rows, weights if weights is not None else np.ones(len(rows))))]
    return spark.createDataFrame(data, "id long, vector array<double>, weight double")


def clustered(rng, centres, each, spread):
    base = rng.normal(size=(centres, 12))
    rows = np.repeat(base, each, 0) + spread * rng.normal(size=(centres * each, 12))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def plain(rows, weights, asked, k, exclude_self, floor=None):
    out = set()
    for q in asked:
        scored = sorted((-round(float(rows[q] @ v) * w, 9) + 0.0, i) for i, (v, w) in enumerate(zip(rows, weights)) if not (exclude_self and i == q))
        out |= {(q, n + 1, i, -s + 0.0) for n, (s, i) in enumerate([x for x in scored if floor is None or -x[0] >= floor][:k])}
    return out


def test_search_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = np.concatenate([clustered(rng, 8, 40, 0.1), np.zeros((3, 12)), clustered(rng, 1, 1, 0.0).repeat(60, 0), -clustered(rng, 2, 5, 0.3)])
    weights = rng.choice([0.0, 0.6, 1.0], len(rows))
    index = table(spark, rows, weights)
    asked = [0, 5, 100, 319, 320, 322, 330, 391]
    queries = index.where(F.col("id").isin(asked)).select(F.col("id").alias("query"), "vector")
    built = vectors.build(index)
    for k, own, floor in ((3, True, None), (70, False, None), (400, False, None), (5, True, 0.8)):
        found = {(r["query"], r["position"], r["id"], round(r["score"], 9) + 0.0) for r in vectors.search(built, queries, k, own, floor).collect()}
        want = plain(rows, weights, asked, k, own, floor)
        assert len(found) == len(want)
        assert {x[:3] for x in found} == {x[:3] for x in want}


def test_bounds_leave_few_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 40, 50, 0.05)
    index = table(spark, rows)
    queries = index.where("id % 20 = 0").select(F.col("id").alias("query"), "vector")
    built = vectors.build(index, centres=200)
    assert vectors.scored_share(built, queries, 5).first()["share"] < 0.15
    plan = vectors.search(built, queries, 5)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_queries_are_sent_to_tiles_not_to_every_cell(spark):
    rows = clustered(np.random.default_rng(4), 2000, 1, 0.0)
    index = table(spark, rows)
    queries = index.where("id % 20 = 0").select(F.col("id").alias("query"), "vector")
    built = vectors.build(index, centres=200)
    assert vectors.probes(built, queries, 5).count() <= 100 * 20
    found = {(r["query"], r["position"], r["id"]) for r in vectors.search(built, queries, 5).where("query < 100").collect()}
    assert found == {x[:3] for x in plain(rows, np.ones(len(rows)), range(0, 100, 20), 5, False)}


def test_hits_of_a_tile_are_cut_as_they_come(monkeypatch):
    rng = np.random.default_rng(5)
    rows = np.concatenate([clustered(rng, 1, 1, 0.0).repeat(40, 0), clustered(rng, 200, 1, 0.0)])
    centres, cells = rows[40:60], (rows @ rows[40:60].T).argmax(1)
    vector = pa.array(list(rows))
    held = pa.table({"id": pa.array(range(240)), "vector": vector, "weight": pa.array(np.ones(240)), "cell": pa.array(cells)})
    asked = pa.table({"query": pa.array(range(240)), "vector": vector, "reach": pa.array(np.full(240, -np.inf))})
    monkeypatch.setattr(vectors, "HELD", 50)
    monkeypatch.setattr(vectors, "CELLS", 300)
    hits = vectors._Tile.of(held, asked, True).hits(centres, np.full(20, 4.0), np.ones(20), 7, None).to_pylist()
    want = plain(rows, np.ones(240), range(240), 7, True)
    assert {(h["query"], h["id"], h["score"]) for h in hits} == {(q, i, s) for q, _, i, s in want}


def test_tiers_and_empty_tables(spark):
    prepared = spark.createDataFrame([(1, "Q01", ["red", "house"], [1.0, 0.0]), (2, "Q02", ["blue", "boat"], [0.0, 1.0]), (3, "Q03", ["green"], None)], "id long, code string, tokens array<string>, vector array<double>")
    questions = [
        (1, "see q02 please", ["red", "house"], [1.0, 0.0]),  # named, whatever its vector says
        (2, "", ["blue", "boat"], [0.96, 0.28]),  # by vector, against its words
        (3, "", ["red", "house"], [0.71, 0.71]),  # has a vector that is near to none: words don't count
        (4, "", ["blue", "boat"], None),
        (5, "", ["green", "x", "y"], None),
        (6, "see Q77", ["green"], None),
    ]
    asked = spark.createDataFrame(questions, "query long, body string, tokens array<string>, vector array<double>")
    found = {(r["query"], r["tier"], r["id"]) for r in vectors.match_in_tiers(asked, prepared).collect()}
    assert found == {(1, "named", 2), (2, "semantic", 1), (4, "lexical", 2), (6, "lexical", 3)}
    assert vectors.match_in_tiers(asked, prepared.where("id < 0")).count() == 0
    assert vectors.search(vectors.build(table(spark, [])), asked.select("query", "vector").where("vector IS NOT NULL"), 3).count() == 0
