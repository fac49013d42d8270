from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ravelin.llm import extendible_shards as X
from ravelin.llm.queries import QUERIES


def test_query_lists_the_written_files(spark, edge_dir, monkeypatch):
    """The query's rows are those of the files it wrote, nulls and repeated rows too."""
    folders = []
    monkeypatch.setattr(X, "new_folder", lambda s, label, real=X.new_folder: folders.append(real(s, label)) or folders[-1])
    rows = QUERIES["op8_extendible_shards"](spark, edge_dir).collect()
    given = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0))).collect()
    files = pq.read_table(folders[0]).select(["doc_id", "text"]).to_pylist()
    size = lambda t: len((t or "").encode())
    assert Counter((r["doc_id"], r["bytes"]) for r in rows) == Counter(map(tuple, given)) == Counter((f["doc_id"], size(f["text"])) for f in files)


def test_shards_read_back_equal_the_assignment(spark, tmp_path):
    docs = [(7 if i % 3 == 0 else i, "é" * (50 + i % 7)) for i in range(600)] + [(7, "x" * 50)] * 5 + [(None, None), (1, "y" * 5000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    want, got = X.sharded(df, limit=1000).collect(), X.written_shards(df, str(tmp_path / "out"), limit=1000).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len({r["shard"] for r in got}) > 50 and any("." in r["shard"] for r in got)


def test_a_large_directory_goes_by_row_numbers(spark, tmp_path):
    docs = [(7 if i % 3 == 0 else i, "é" * (50 + i % 7)) for i in range(200)] + [(None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    for name, largest in (("a", 0), ("b", 10**6)):
        X.write_shards(df, str(tmp_path / name), limit=1000, largest=largest)
    rows = [Counter(map(tuple, X.read_shards(df, str(tmp_path / n)).select("doc_id", "text", "shard").collect())) for n in "ab"]
    # rows of a hot key go by their number, which is the same in both
    assert rows[0] == rows[1]
