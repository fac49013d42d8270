"""Removal of repeated substrings beside a plain loop over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from ravelin.llm import suffix_dedup as S
from ravelin.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


def flags(docs):
    texts = [(t or "").encode() for _, t in docs]
    n = S.LENGTH
    seen = Counter(hash(b[p:p + n]) for b in texts for p in range(len(b) - n + 1))
    for b in texts:
        gone, end = bytearray(len(b)), 0
        for p in range(len(b) - n + 1):
            if seen[hash(b[p:p + n])] > 1:
                start, end = max(p, end), p + n
                gone[start:end] = b"\x01" * (end - start)
        yield b, gone


def expected(docs):
    out = []
    for (doc_id, _), (b, gone) in zip(docs, flags(docs)):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def check(spark, docs, **options):
    found = sorted(repr(tuple(r)) for r in S.removal_report(spark.createDataFrame(docs, SCHEMA), **options).collect())
    assert found == expected(docs)


def noise(rng, n):
    return "".join(rng.choice("abcdefghij klmnopé") for _ in range(n))


def planted(rng):
    """Passages of all lengths around the limit between other texts, at starts and ends, in several copies, overlapping and nested."""
    docs = []
    for i in range(60):
        passage = noise(rng, rng.choice([300, 380, 399, 400, 401, 450, 650, 1500]))
        for _ in range(rng.choice([1, 2, 2, 3])):
            cut = rng.randrange(0, 60)
            docs.append(noise(rng, rng.choice([0, 0, 5, 210, 900])) + passage[cut:len(passage) - rng.randrange(0, 60)] + noise(rng, rng.choice([0, 0, 7, 300])))
    hot = noise(rng, 700)
    docs += [noise(rng, rng.randrange(0, 300)) + hot + noise(rng, rng.randrange(0, 300)) for _ in range(150)]
    docs += ["z" * 3000, "z" * 400, "z" * 399, "ab" * 500, "ab" * 500, "y" * 401, None, "", "q" * 5000 + noise(rng, 50) + "q" * 5000]
    docs += [docs[3], docs[3], noise(rng, 30000), "é" * 300, "é" * 300]
    return [(i if i % 17 else None, t) for i, t in enumerate(docs)]


def test_planted_passages(spark):
    docs = planted(random.Random(11))
    check(spark, docs)
    check(spark, docs, run_bytes=60_000, range_bytes=30_000)


def test_ranges_inside_one_passage(spark):
    """Stretches of suffixes that go through many ranges: one passage in many surroundings."""
    rng = random.Random(12)
    hot = noise(rng, 450)
    docs = [(i, noise(rng, 250) + hot + noise(rng, 250)) for i in range(200)]
    check(spark, docs, run_bytes=40_000, range_bytes=8_000)


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(13)
    part = noise(rng, 3000)
    docs = [(1, noise(rng, 9000) + part + noise(rng, 4000) + part), (2, part[1000:2000] + noise(rng, 100))]
    want = [(a.tolist(), p.tolist(), q.tolist()) for a, p, q, _ in S.sampled(*flat(docs))]
    monkeypatch.setattr(S, "PIECE", 700)
    cut = [(a.tolist(), p.tolist(), q.tolist()) for a, p, q, _ in S.sampled(*flat(docs))]
    assert {(a, p) for x in want for a, f, t in zip(*x) for p in range(f, t + 1)} == {(a, p) for x in cut for a, f, t in zip(*x) for p in range(f, t + 1)}
    monkeypatch.undo()
    check(spark, docs)


def flat(docs):
    texts = [t.encode() for _, t in docs]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_bytes_that_stay(spark):
    docs = planted(random.Random(14))[:40]
    found = S.without_repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    want = [(d, None if t is None else bytes(x for x, g in zip(b, gone) if not g)) for (d, t), (b, gone) in zip(docs, flags(docs))]
    assert sorted(repr((r["doc_id"], None if r["kept"] is None else bytes(r["kept"]))) for r in found) == sorted(map(repr, want))


def test_edge_tables(spark, edge_dir):
    table = pq.read_table(f"{edge_dir}/documents.parquet", columns=["doc_id", "text"])
    docs = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    assert sorted(repr(tuple(r)) for r in QUERIES["op11_suffix_dedup"](spark, edge_dir).collect()) == expected(docs)


def test_merge_never_loses_order_or_prefixes():
    rng = random.Random(15)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(600)]
    streams = []
    for run in range(7):
        own = sorted({(t, len(t)) for t in texts[run::7]})
        stream = S.Stream(run)
        for at in range(0, len(own), 16):
            items = [S.Item(t, a, False) for t, a in own[at:at + 16]]
            stream.extend(at, *S.decode(S.encode(items), len(items)))
        streams.append(stream)
    found = [(s.items[i].text, known) for s, i, known in S.merged(streams)]
    assert [t for t, _ in found] == sorted(t for s in streams for t in (x.text for x in s.items))
    before = b""
    for text, known in found:
        assert known == S.common(before, text)
        before = text
