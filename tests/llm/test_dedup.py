import random

import pyarrow.parquet as pq

from ravelin.llm.graphs import components
from ravelin.llm.minmax_dedup import keep_first, near_duplicates
from ravelin.llm.queries import QUERIES
from tests.llm import brute


def check(spark, docs, **options):
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), **options).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = [(d, n, c, c is None or d == c) for (d, _), (n, c) in zip(docs, brute.components(docs, options.get("size", 4)))]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_edge_tables(spark, edge_dir):
    table = pq.read_table(f"{edge_dir}/documents.parquet", columns=["doc_id", "text"])
    docs = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    found = QUERIES["op5_minmax_dedup"](spark, edge_dir).collect()
    want = [(d, n, c, c is None or d == c) for (d, _), (n, c) in zip(docs, brute.components(docs))]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_chain_and_family_without_a_common_centre(spark):
    """A chain of edits (ends far apart), and a family whose members are like some others but not like its smallest member."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(14):
        docs.append((i + 1000 if i else 5, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    base = [f"b{i}" for i in range(100)]
    for i in range(60):
        text = list(base)
        for at in rng.sample(range(100), rng.randrange(0, 9)):
            text[at] = f"e{rng.randrange(40)}"
        docs.append((100 + i, " ".join(text)))
    check(spark, docs)
    check(spark, docs, size=5)


def test_keep_first_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(3, text, "a"), (1, text.upper(), "b"), (None, text, "c"), (9, None, "d"), (None, "alone here", "e"), (8, "", "f")], "doc_id long, text string, kept string")
    out = keep_first(docs)
    assert out.columns == docs.columns
    assert sorted(r["kept"] for r in out.collect()) == ["b", "d", "e", "f"]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (5000, 4000)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[i] for i in range(1000, 1100)} == {1000} and found[5000] == 4000
