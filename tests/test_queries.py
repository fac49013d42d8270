"""Every check-SQL query on the smallest data set, and plan checks."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools import check

ROOT = "/root/testdata/sf0.001"
QUICK = [
    "win01", "win04", "joi01", "joi02", "agg01", "agg05", "agg22", "agg23", "top01", "top02", "txt01", "txt05", "txt14", "prj08", "src01",
    "src05", "dq01", "dq07", "top14", "set02", "set03", "joi17", "joi19", "joi22", "joi23", "joi26", "joi27", "joi33", "joi36", "str02", "str05", "udf01", "udf03",
    "agg04", "agg27", "agg29", "win16", "txt09", "txt10", "txt16", "txt18", "txt19", "txt20", "txt21", "txt22", "txt25", "txt26", "txt27", "top03", "top07",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are absent")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"create view {name} as select * from '{ROOT}/{name}.parquet'")
    return connection


def quick():
    return [n for n in entry.queries() if n.split("_")[0] in QUICK]


@pytest.mark.parametrize("name", quick())
def test_query_equals_sql(spark, tables, name):
    text, _, good = check.compare(spark, tables, name, entry.queries()[name], entry.oracle_sql().get(name), ROOT)
    assert good, text


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_no_cartesian_product_and_pruned_scans(spark):
    plan = entry.queries()["joi12_same_subject_pairs"](spark, ROOT)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    plan = entry.queries()["win04_latest_row_per_key"](spark, ROOT)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    scan = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scan and all("o_orderpriority" not in line for line in scan)


def test_texts_stay_in_their_scans(spark):
    """No exchange of the state and search plans carries a text."""
    for name in ("set03_state_diff", "top03_current_statement", "top07_bm25_ranking"):
        df = entry.queries()[name](spark, ROOT)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            if "Exchange" in line:
                assert "text#" not in line, line[:300]
