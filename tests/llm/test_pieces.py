import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ravelin.llm import piece_sampling as P
from ravelin.llm import wordhash as W

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def vocabulary():
    with open(P.MODEL, "rb") as f:
        return P.Vocabulary(f.read())


def sampled(vocabulary, texts, seeds, k):
    out = []
    for a, b, data, offsets in W.text_slices(pa.array(texts), 1 << 16):
        s = P.Slice(vocabulary, data, offsets, W.mix(seeds[a:b]))
        found, thresholds = P.sample_slice(s, k)
        for paths, t in zip(found, thresholds):
            out.append([(tuple(P.piece_ids(s, [p])[0].tolist()), p.log_prob, P.log_inclusion(p.log_prob, t)) for p in paths])
    return out


def all_paths(vocabulary, text):
    """Every segmentation of ' ' + text by the vocabulary, with its probability."""
    whole = b" " + text.encode()
    ids = {p: i for i, p in enumerate(vocabulary.pieces) if p and vocabulary.weights[i] and i not in set(vocabulary.byte_ids.tolist())}
    done = {len(whole): [((), 0.0)]}
    for at in range(len(whole) - 1, -1, -1):
        done[at] = [((ids[whole[at:end]], *rest), vocabulary.weights[ids[whole[at:end]]] + w) for end in range(at + 1, len(whole) + 1) if whole[at:end] in ids for rest, w in done[end]]
    total = np.logaddexp.reduce([w for _, w in done[0]])
    return {p: w - total for p, w in done[0]}


def test_samples_follow_the_lattice_without_replacement(vocabulary):
    text, n, k = "the cat", 6000, 3
    want = all_paths(vocabulary, text)
    found = sampled(vocabulary, [text] * n, np.arange(n, dtype=np.uint64), k)
    assert all(len({p for p, _, _ in row}) == len(row) == k for row in found)
    assert all(abs(lp - want[p]) < 1e-6 for row in found for p, lp, _ in row)
    first = Counter(row[0][0] for row in found)
    top = sorted(want, key=want.get)[-4:]
    for path in top:
        p = np.exp(want[path])
        assert abs(first[path] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
    # second sample given the first: probabilities of the rest, rescaled
    best = top[-1]
    rest = [row[1][0] for row in found if row[0][0] == best]
    p = np.exp(want[top[-2]]) / (1 - np.exp(want[best]))
    assert abs(rest.count(top[-2]) / len(rest) - p) < 5 * np.sqrt(p * (1 - p) / len(rest)) + 1e-3
    # inclusion scores make sums over samples unbiased: the total probability is 1
    estimate = [sum(np.exp(lp - q) for _, lp, q in row) for row in found]
    assert abs(np.mean(estimate) - 1) < 5 * np.std(estimate) / np.sqrt(n)


def test_all_segmentations_of_a_short_text(vocabulary):
    want = all_paths(vocabulary, "ab")
    row = sampled(vocabulary, ["ab"], np.array([5], np.uint64), len(want) + 3)[0]
    assert {p for p, _, _ in row} == set(want) and all(q == 0 for _, _, q in row)


def test_round_trip_and_independence_of_layout(spark):
    texts = ["", " ", "a", "  two  blanks ", "x\n\n\ty", "日本語 ▁ ﬁ €🙂", "a" * 3000, "Some words, and more words.\n" * 400, "z\x00y", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    one = {r["doc_id"]: r["samples"] for r in P.sample_pieces(docs.coalesce(1), F.col("doc_id"), k=3).collect()}
    many = {r["doc_id"]: r["samples"] for r in P.sample_pieces(docs.repartition(7), F.col("doc_id"), k=3).collect()}
    assert one == many and one[9] == [] and all(len({tuple(s["ids"]) for s in one[i]}) == len(one[i]) for i in range(9))
    flat = P.sample_pieces(docs, F.col("doc_id"), k=3, keep_text=False).select("doc_id", F.explode("samples.ids").alias("ids"))
    back = P.decode_pieces(flat, "ids").collect()
    assert len(back) >= 18 and all(r["text"] == texts[r["doc_id"]] for r in back)


def test_query_gives_samples_of_every_document(spark, edge_dir):
    from ravelin.llm.queries import QUERIES

    rows = QUERIES["op9_piece_sampling"](spark, edge_dir).collect()
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(r["doc_id"] for r in rows).keys() == {d["doc_id"] for d in docs}
    assert all(r["n_pieces"] in (None, -1) or r["n_pieces"] == len(r["ids"]) for r in rows)
