"""Every query on the edge tables and on the smallest given tables, beside its SQL; every query on empty tables."""

import os

import duckdb
import pytest

from ravelin.llm.queries import CHECK_SQL, QUERIES

ROOT = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(v[i]) for i in order) for v in values))


def compare(spark, name, root):
    connection = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        connection.execute(f"create view {t} as select * from '{root}/{t}.parquet'")
    found = QUERIES[name](spark, root)
    want = connection.execute(CHECK_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    a, b = rows(found.columns, [tuple(r) for r in found.collect()]), rows(names, want.fetchall())
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    assert not different, different[:3]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(CHECK_SQL))
def test_edge_tables(spark, edge_dir, name):
    compare(spark, name, edge_dir)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(CHECK_SQL))
def test_given_tables(spark, name):
    compare(spark, name, ROOT)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []
