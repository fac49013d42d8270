import hashlib
import os

import pyarrow as pa
import pytest

import corpus_pipeline
from ravelin.llm import piece_sampling as P
from ravelin.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no vocabulary file")


def test_query_and_stage_decode_every_sample(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text")
    hashes = {hashlib.sha256(d["text"].encode()).hexdigest() for d in docs.collect() if d["text"] is not None}
    rows = [r for r in QUERIES["op9_piece_sampling"](spark, edge_dir).collect() if r["ids"] is not None]
    assert all(r["round_trip"] for r in rows) and {r["decoded_sha256"] for r in rows} == hashes
    for r in corpus_pipeline.encode(spark, docs, edge_dir).collect():
        assert len(r["decoded_sha256"]) == r["n_samples"] == len(r["samples"]) and (r["round_trip"] or r["n_samples"] == 0) and set(r["decoded_sha256"]) <= hashes


def test_a_changed_id_is_no_round_trip():
    with open(P.MODEL, "rb") as f:
        vocabulary = P.Vocabulary(f.read())
    ids = [vocabulary.pieces.index(b" the"), vocabulary.pieces.index(b"at")]
    found = P.round_trips(vocabulary, pa.array([ids, ids[::-1], ids + ids[:1]], pa.list_(pa.int32())), [b"theat"] * 3).to_pylist()
    assert [x["same"] for x in found] == [True, False, False] and found[0]["sha256"] == hashlib.sha256(b"theat").hexdigest()


def test_lists_with_nulls_and_slices():
    with open(P.MODEL, "rb") as f:
        vocabulary = P.Vocabulary(f.read())
    ids = [vocabulary.pieces.index(b" the"), vocabulary.pieces.index(b"at")]
    lists = pa.array([[ids[1]], None, [], ids, ids[::-1]], pa.list_(pa.int32())).slice(1)
    assert P.decoded(vocabulary, lists).to_pylist() == [None, "", "theat", "at the"]
    with pytest.raises(IndexError):
        P.decoded(vocabulary, pa.array([[-1]], pa.list_(pa.int32())))
