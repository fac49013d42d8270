import random

from ravelin.llm import secrets as S


def test_keys_joined_to_a_name_are_masked(spark):
    """Hex and upper-case keys behind names that are no assign words; most had too little entropy for the class of the whole string."""
    rng = random.Random(8)
    key = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(rng.randrange(26, 41)))
    texts = [name + key(alphabet) for name in ("key=", "API_", "id-", "q/") for alphabet in ("0123456789ABCDEF", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(20)]
    docs = spark.createDataFrame([(i, f"é {t} 🙂") for i, t in enumerate(texts)], "doc_id int, text string")
    masked = [r["text"] for r in S.mask_secrets(docs).collect()]
    assert sum("[secret]" in t for t in masked) >= 0.95 * len(texts)
    assert all(t.startswith("é ") and t.endswith(" 🙂") and t.count("[secret]") <= 2 for t in masked)


def test_runs_are_suppressed_alone(spark):
    texts = ["key=example0123456789ABCDEF0123", "key=" + "AB" * 20 + "1", "id-" + "1234567890" * 3, "example_key=9F86D081884C7D659A2FEAA0C55AD015"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    masked = {r["doc_id"]: r["text"] for r in S.mask_secrets(docs).collect()}
    assert [masked[i] for i in range(3)] == texts[:3] and masked[3] == "example_key=[secret]"


def test_spans_of_runs_are_joined(spark):
    key = "9F86D081884C7D659A2FEAA0C55AD015"
    docs = spark.createDataFrame([(1, f"key={key} {key}")], "doc_id int, text string")
    spans = [(s["start"], s["end"]) for s in S.scan_secrets(docs, runs=True).collect()[0]["spans"]]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and spans[-1] == (37, 69) and spans[0][1] == 36
