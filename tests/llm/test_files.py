import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import extendible_shards as X
from ravelin.llm import training_order as T
from ravelin.llm import url_filter as U
from ravelin.llm import warc


def test_shards_of_a_hot_key_fit(spark, tmp_path):
    """A third of the rows has one key; some rows repeat; one row is larger than the limit."""
    docs = [(7 if i % 3 == 0 else i, "x" * (50 + i % 7), i) for i in range(900)] + [(7, "x" * 50, -1)] * 5 + [(None, None, -2), (1, "y" * 5000, -3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard long")
    found = X.sharded(df.drop("shard"), limit=1000).collect()
    assert Counter((r["doc_id"], r["bytes"]) for r in found) == Counter((d, len(t or "")) for d, t, _ in docs)
    sums, rows = Counter(), Counter()
    for r in found:
        sums[r["shard"]] += r["bytes"]
        rows[r["shard"]] += 1
    assert all(sums[r["shard"]] == r["shard_bytes"] and rows[r["shard"]] == r["shard_rows"] for r in found)
    assert all(v <= 1000 or rows[k] == 1 for k, v in sums.items())
    names = sorted(sums)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    # a bucket was split only if it was too large: the parent of every shard is over the limit
    for name in names:
        parent = name[:-1].rstrip(".")
        if name and not name.endswith("."):
            assert sum(v for k, v in sums.items() if k.startswith(name[:-1])) > 1000 or parent != name[:-1]
    X.write_shards(df.drop("shard"), str(tmp_path / "out"), limit=1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"]) for r in back.select("doc_id", "text").collect()) == Counter((d, t) for d, t, _ in docs)
    assert back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).where("b > 1000 and n > 1").count() == 0


def test_training_order_round_trip(spark, tmp_path):
    if not os.path.exists(T.MODEL):
        pytest.skip("no vocabulary file")
    import sentencepiece

    texts = ["", None, "hello world", "words and more words. " * 50, "é\n" * 30, "hello world"]
    docs = spark.createDataFrame([(i if i < 5 else 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    folder = str(tmp_path / "order")
    index = T.write_training_order(spark.read.parquet(str(tmp_path / "docs")), folder, sequence=16, per_shard=5).collect()
    n = len(index)
    assert sorted(r["slot"] for r in index) == list(range(n))
    by_slot = sorted(index, key=lambda r: r["slot"])
    assert [r["shard"] for r in by_slot] == sorted(r["shard"] for r in index) and len({r["shard"] for r in index}) > 2
    firsts = {r["shard"]: r["slot"] for r in reversed(by_slot)}
    assert all(r["offset"] == (r["slot"] - firsts[r["shard"]]) * 32 for r in index)
    assert sorted(os.listdir(folder)) == sorted(["order.json", "shards", *(f"shard-{s:08d}.u16" for s in firsts)])
    assert [r["seq"] for r in by_slot] != sorted(r["seq"] for r in index)
    read = {r["slot"]: np.frombuffer(r["ids"], "<u2") for r in T.read_training_order(spark, folder).collect()}
    assert len(read) == n and all(len(x) == 16 for x in read.values())
    part = T.read_training_order(spark, folder, 3, n - 2).collect()
    assert sorted(r["slot"] for r in part) == list(range(3, n - 2)) and all((np.frombuffer(r["ids"], "<u2") == read[r["slot"]]).all() for r in part)
    model = sentencepiece.SentencePieceProcessor(model_file=T.MODEL)
    want = Counter(tuple(model.encode(t) + [T.END]) for t in texts if t is not None)
    by_doc: dict = {}
    for r in sorted(index, key=lambda r: (r["doc_id"], r["seq"])):
        by_doc.setdefault((r["doc_id"], r["seq"]), []).append(tuple(read[r["slot"]][:r["n_ids"]].tolist()))
    got = Counter()
    for doc in {d for d, _ in by_doc}:
        copies = len(by_doc[(doc, 0)])
        got[tuple(x for s in range(len([1 for d, _ in by_doc if d == doc])) for x in by_doc[(doc, s)][0])] += copies
    assert got == want


def test_archives_and_ranges(spark, tmp_path, edge_dir):
    pages = spark.read.parquet(f"{edge_dir}/pages.parquet").select("page_id", "url", "html")
    folder = str(tmp_path / "warc")
    index = warc.build_index(warc.write_archives(pages.repartition(2), folder, archive_bytes=2000), folder)
    assert len(os.listdir(folder)) > 3
    some = index.where("page_id % 7 = 0")
    for gap, size in ((0, 1), (1 << 20, 1 << 20)):
        got = warc.read_records(some, folder, gap, size).collect()
        assert Counter((r["page_id"], r["offset"]) for r in got) == Counter((r["page_id"], r["offset"]) for r in some.collect())
        given = {r["page_id"]: r for r in pages.collect()}
        for r in got:
            page = given[int(r["page_id"])]
            assert r["url"] == page["url"]
            if r["record_type"] == "response":
                assert r["payload"] == (page["html"] or "").encode() and r["digest"] == r["found_digest"]
            else:
                assert given[int(r["refers_to"])]["html"] == page["html"]


def test_rules_by_trie_and_by_join(spark, rng):
    labels, segments = ["a", "b", "com", "org"], ["", "x", "xy", "y"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(segments) for _ in range(rng.randrange(0, 4)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(40)] + [(None, "/", "allow")]
    urls = [(i, f"http://{host()}{path()}{rng.choice(['', '?q', '#f'])}") for i in range(400)] + [(400, None), (401, "x")]
    pages, frame = spark.createDataFrame(urls, "page_id int, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    one = sorted(map(tuple, U.judge(pages, frame).collect()))
    two = sorted(map(tuple, U.judge(pages, frame, broadcast_bytes=0).select("page_id", "url", "host", "path", "rule", "verdict").collect()))
    assert [x[0] for x in one] == [x[0] for x in two]
    fits = [r for r in rules if r[0]]
    for (i, url, h, p, rule, verdict), other in zip(one, two):
        good = [r for r in fits if (h == r[0] or h.endswith("." + r[0])) and p.startswith(r[1])]
        want = max(good, key=lambda r: (r[0].count("."), len(r[1]), r[2] == "block"), default=None)
        assert rule == (want and want[0] + want[1]) == other[4]
        assert verdict == other[5] == (want[2] if want else "allow" if h else "block")
