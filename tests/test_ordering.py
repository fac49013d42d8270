"""Chunked windows, global ranks and exact quantiles against plain Python."""

import hashlib
import random
import statistics

from pyspark.sql import functions as F

from ravelin.operators import ordering, quantiles


def test_lag_in_chunks_crosses_chunks_and_hot_key(spark):
    rows = [("hot", i, i * 2) for i in range(300)] + [("one", 5, 7)] + [("two", 1, 1), ("two", 290, 2)]
    df = spark.createDataFrame(rows, "k string, pos int, v int")
    chunk = F.floor(F.col("pos") / 10)
    back = {(r.k, r.pos): r.prev_v for r in ordering.lag_in_chunks(df, ["k"], ["pos"], chunk, ["v"]).collect()}
    ahead = {(r.k, r.pos): r.n_v for r in ordering.lag_in_chunks(df, ["k"], ["pos"], chunk, ["v"], "n_", ahead=True).collect()}
    assert back[("hot", 0)] is None and back[("one", 5)] is None and back[("two", 290)] == 1
    assert all(back[("hot", i)] == (i - 1) * 2 for i in range(1, 300))
    assert all(ahead[("hot", i)] == (i + 1) * 2 for i in range(299)) and ahead[("hot", 299)] is None


def test_running_sum_in_chunks(spark):
    df = spark.createDataFrame([("a", i, 1) for i in range(100)] + [("b", 3, 4)], "k string, pos int, v int")
    out = {(r.k, r.pos): r.s for r in ordering.running_sum_in_chunks(df, ["k"], ["pos"], F.floor(F.col("pos") / 7), F.col("v"), "s").collect()}
    assert all(out[("a", i)] == i + 1 for i in range(100)) and out[("b", 3)] == 4


def test_global_rank_with_a_third_tied(spark):
    random.seed(1)
    rows = [(i, 5.0 if i % 3 == 0 else round(random.uniform(0, 10), 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, score double")
    got = {r.id: r["rank"] for r in ordering.global_rank(df, "score", F.col("id")).collect()}
    mark = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    want = sorted(rows, key=lambda r: (-r[1], mark(r[0])))
    assert got == {r[0]: n + 1 for n, r in enumerate(want)}


def test_grouped_quantile_small_and_bracketed(spark, monkeypatch):
    random.seed(2)
    rows = [("a", random.gauss(0, 1)) for _ in range(4001)] + [("b", float(i % 3)) for i in range(500)] + [("c", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: statistics.median(v for q, v in rows if q == k and v is not None) for k in "abc"}
    for limit in (10_000, 100):
        monkeypatch.setattr(quantiles, "SMALL_GROUP", limit)
        got = {r.k: r.m for r in quantiles.grouped_quantile(df, ["k"], {"m": F.col("v")}).collect()}
        assert got == want


def test_exact_quantiles(spark):
    values = [float(i * i % 97) for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    edges = ordering.exact_quantiles(df, "v", [0.25, 0.5, 0.75]).first().edges
    assert [round(e, 9) for e in edges] == [round(q, 9) for q in statistics.quantiles(values, n=4, method="inclusive")]


def test_nulls_are_ranked_last(spark):
    rows = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(200)], "id long, score double")
    got = {r.id: r.rank for r in ordering.global_rank(rows, "score", F.col("id")).collect()}
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    want = sorted(got, key=lambda i: (i % 5 == 0, -(i % 7) if i % 5 else 0, digest(i)))
    assert [got[i] for i in want] == list(range(1, 201))


def test_rows_of_few_groups_are_not_sorted_by_group(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(900)], "k int, v double").repartition(4)
    medians = quantiles.grouped_quantile(df, ["k"], {"m": F.col("v")})
    assert {r.k: r.m for r in medians.collect()} == {0: 448.5, 1: 449.5, 2: 450.5}
    plan = medians._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
