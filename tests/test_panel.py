import datetime as dt

from pyspark.sql import functions as F

from ravelin.operators import panel

D = dt.datetime


def test_gap_edges_are_outside(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (2.5,), (2.49,)], "g double")
    assert [r.c for r in df.select(panel.gap_class(F.col("g")).alias("c")).collect()] == ["short", "kept", "long", "kept"]


def test_same_unit_growth_doubles_in_a_year(spark):
    rows = [(1, D(2020, 1, 1), 1, 100.0), (1, D(2021, 1, 1), 2, 200.0), (2, D(2020, 1, 1), 3, 50.0)]
    df = spark.createDataFrame(rows, "unit int, start timestamp_ntz, id int, rent double")
    pairs = panel.pair_with_previous(df, ["unit"], "start", "id", ["rent"])
    out = panel.same_unit_growth(pairs, ["rent"]).collect()
    assert len(out) == 1 and abs(out[0].rent_growth - 100) < 0.6 and out[0].gap_days == 366


def test_interval_attach_month_start_and_end_are_inclusive(spark):
    parents = spark.createDataFrame(
        [("u", D(2020, 1, 15), D(2020, 12, 31), 1), ("u", D(2020, 6, 20), D(2021, 6, 19), 2)],
        "k string, start timestamp_ntz, stop timestamp_ntz, pid int",
    )
    children = spark.createDataFrame(
        [("u", D(2020, 1, 1), "a"), ("u", D(2019, 12, 31), "b"), ("u", D(2020, 6, 1), "c"), ("u", D(2021, 6, 19), "d"),
         ("u", D(2021, 6, 20), "e"), ("x", D(2020, 5, 5), "f")], "k string, at timestamp_ntz, id string",
    )
    out = {r.id: r.parent_pid for r in panel.attach_interval(children, parents, "k", "at", "start", "stop", "pid").collect()}
    assert out == {"a": 1, "b": None, "c": 2, "d": 2, "e": None, "f": None}


def test_spread_rows_are_not_broadcast(spark):
    """Rows listed per month or step are many times their table, which is all that Spark's estimate sees."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate")
    parents = orders.withColumn("stop", F.date_add("o_orderdate", 364))
    children = orders.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    attached = panel.attach_interval(children, parents, "o_custkey", "at", "o_orderdate", "stop", "o_orderkey")
    steps = orders.select("o_custkey", F.month("o_orderdate").alias("m"), "o_orderkey")
    served = panel.as_of_backward(steps.select("o_custkey", F.col("m").alias("at"), F.col("o_orderkey").alias("id")), steps, "o_custkey", "id", "at", "m", ["o_orderkey"], 3)
    for out in (attached, served):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_as_of_tolerance_is_inclusive(spark):
    right = spark.createDataFrame([("u", 10, 1.0), ("u", 12, 2.0)], "k string, m int, v double")
    left = spark.createDataFrame([("u", 9, 0), ("u", 11, 1), ("u", 15, 2), ("u", 16, 3)], "k string, at int, id int")
    out = {r.id: r.v for r in panel.as_of_backward(left, right, "k", "id", "at", "m", ["v"], 3).collect()}
    assert out == {0: None, 1: 1.0, 2: 2.0, 3: None}


def test_small_cells_are_masked(spark):
    df = spark.createDataFrame([(4, 1.0), (5, 2.0)], "n int, v double")
    assert [r.v for r in panel.mask_small(df, "n", ["v"]).collect()] == [None, 2.0]


def test_split_adds_up(spark):
    rows = [(1, i % 2 == 0, i % 3 == 0, float(i), float(2 * i)) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "g int, p boolean, c boolean, ps double, cs double")
    r = panel.freq_size(df, ["g"], "p", "c", F.col("ps"), F.col("cs")).first()
    assert abs(r.total - r.frequency - r["size"]) < 1e-9


def test_backtest_reads_no_row_of_the_target_year(spark):
    pairs = spark.createDataFrame([(2000, 1.0), (2001, 5.0), (2002, 900.0)], "year long, effective_growth double")
    trend = {r.target_year: r.predicted for r in panel.internal_trend(pairs).collect()}
    assert trend[2002] == 3.0
