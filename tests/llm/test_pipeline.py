import corpus_pipeline
from ravelin.llm import language_mixture
from ravelin.llm.storage import written
from tests.llm import brute


def test_stages_on_edge_tables(spark, edge_dir):
    docs = written(spark.read.parquet(f"{edge_dir}/documents.parquet"), "docs")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        docs = written(stage(spark, docs, edge_dir), name)
        if name != "encode":
            assert docs.columns == columns
            steps[name] = before, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    before, after = steps["language_id"]
    assert all(any(c.isalpha() for c in t) for _, t in after) and {d for d, t in before if t and len(t) > 500} <= {d for d, _ in after}
    before, after = steps["near_dedup"]
    want = [d for d, (_, c) in zip(before, brute.components(before, 5)) if c is None or c == d[0]]
    assert sorted(map(repr, after)) == sorted(map(repr, want))
    before, after = steps["decontaminate"]
    assert 0 < len(after) < len(before)
    before, after = steps["mask_secrets"]
    assert len(after) == len(before) and any("[secret]" in t for _, t in after) and not any("password=abcdefgh" in t for _, t in after)
    rows = docs.collect()
    assert len(rows) == len(after) and all(1 <= r["n_samples"] <= 2 for r in rows)


def test_run_equals_the_stages(spark):
    root = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, root)
    assert corpus_pipeline.ORACLE_SQL is None and rows.count() > 0
    assert rows.select("doc_id").distinct().count() == rows.count()
    assert language_mixture.UNKNOWN == "und"
