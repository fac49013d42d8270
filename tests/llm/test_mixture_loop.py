"""The language mixture beside a plain loop over words, languages and all set sizes, without arrays or bounds."""

import math

import numpy as np

from ravelin.llm import language_mixture as L

ROOT = "/root/testdata/sf0.01"


def em(likely, share):
    """Rounds of EM from ``share``; proportions and log likelihood."""
    for _ in range(L.ROUNDS):
        sums = [0.0] * len(share)
        for word in likely:
            parts = [s * p for s, p in zip(share, word)]
            total = sum(parts)
            for i, part in enumerate(parts):
                sums[i] += part / total
        share = [s / len(likely) for s in sums]
    return share, sum(math.log(sum(s * p for s, p in zip(share, word))) for word in likely)


def plain(model, text):
    """Proportions of the languages of one text with words."""
    data = np.frombuffer(text.encode(), np.uint8)
    bucket, first, _ = L.trigrams(data, np.array([0, len(data)]))
    ends = [*first[1:].tolist(), len(bucket)]
    few, k = len(first) < L.BACKGROUND_WORDS, len(model.languages)
    likely = []
    for a, b in zip(first.tolist(), ends):
        logs = [sum(float(model.log_p[g, i]) for g in bucket[a:b]) for i in range(k)] + [-math.inf if few else -(b - a) * math.log(L.BUCKETS)]
        top = max(logs)
        likely.append([math.exp(max(x - top, -L.ODD_WORD)) for x in logs])
    prior = [float(s) for s in model.share]
    shares, _ = em(likely, [*prior, 0.0] if few else [*(s * (1 - L.BACKGROUND) for s in prior), L.BACKGROUND])
    order = sorted(range(k), key=lambda i: -shares[i])
    best, chosen = -math.inf, None
    for size in range(1, k + 1):
        kept = [max(shares[i], 1e-4) if i in order[:size] else 0.0 for i in range(k)] + [0.0 if few else max(shares[k], 1e-4)]
        fitted, value = em(likely, [x / sum(kept) for x in kept])
        value -= L.PENALTY * math.log(max(len(likely), 2)) * size
        if value > best:
            best, chosen = value, fitted
    return chosen[:-1]


def test_proportions_equal_the_plain_loop(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    model = L.train_on_documents(docs)
    some = {}
    for r in docs.where("n_chars < 600").orderBy("doc_id").collect():
        some.setdefault(r["lang"], []).append(r["text"])
    names = sorted(some)
    texts = [t for n in names for t in some[n][:3]]
    texts += [some[a][3] + " " + some[b][4] for a, b in zip(names, names[1:])] + [" ".join(some[n][5] for n in names)]
    texts += ["a", "le chat", "xqzj vvkq wwzx qqqj zzxk jjqv", some[names[0]][6] + " xqzj vvkq wwzx qqqj zzxk jjqv"]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    rows, found = L.mixture(model.log_p, model.share, np.frombuffer(data, np.uint8), offsets)
    assert rows.tolist() == list(range(len(texts)))
    for text, got in zip(texts, found):
        want = plain(model, text)
        assert np.allclose(got, want, atol=2e-3), (text[:60], got, want)
        assert [x > 0 for x in got] == [x > 0 for x in want]
