import math
import random
import time

from pyspark.sql import functions as F

from ravelin.llm import secrets as S


def windows(string):
    kind = next(k for k in S.CLASSES if __import__("re").match(k.pattern, string))
    out = []
    for i in range(len(string) - kind.window + 1):
        part = string[i:i + kind.window]
        total = sum(round(S.UNIT * c * math.log2(c)) for c in map(part.count, set(part)))
        if total <= kind.most():
            if out and out[-1][1] >= i:
                out[-1] = (out[-1][0], i + kind.window)
            else:
                out.append((i, i + kind.window))
    return out


def test_sliding_windows_equal_recomputed_ones(spark):
    rng = random.Random(3)
    strings = []
    for alphabet in ("0123456789abcdef", "ABCDEFGHJK0123456789", "abcXYZ0189+/_=-QRSTuvw"):
        for _ in range(25):
            strings.append("".join(rng.choice(rng.choice([alphabet, alphabet[:3]])) for _ in range(rng.randrange(20, 70))) + "a1")
    df = spark.createDataFrame([(i, f"é {s} 🙂") for i, s in enumerate(strings)], "doc_id int, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "entropy"] for r in S.scan_secrets(df, allow=()).collect()}
    want = {i: [(2 + a, 2 + b) for a, b in windows(s)] if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) else [] for i, s in enumerate(strings)}
    assert found == want and any(want.values()) and not all(want.values())


def test_allow_list_and_masking(spark):
    key = "Zx8Qw3Er7Ty2Ui9Op4As6Df1"
    df = spark.createDataFrame([(1, f"a {key} b", "x"), (2, f"a {key}example b", "y"), (3, "see password=abcdefgh1 ok", "z"), (4, "plain é", "w"), (5, None, "v")], "doc_id int, text string, spans string")
    masked = S.mask_secrets(df)
    assert masked.columns == df.columns and {r["spans"] for r in masked.collect()} == set("xyzwv")
    out = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert out == {1: "a [secret] b", 2: f"a {key}example b", 3: "see [secret] ok", 4: "plain é", 5: None}
    assert S.scan_secrets(df).where((F.col("doc_id") == 5) & (F.size("spans") == 0)).count() == 1


def test_long_candidates_and_many_matches_take_time_in_proportion(spark):
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    string = "".join(rng.choice(alphabet if i // 700 % 2 else "aA1") for i in range(200_000))
    many = " ".join(f"{rng.getrandbits(160):040x}" for _ in range(20_000))
    df = spark.createDataFrame([(1, "é " + string), (2, many)], "doc_id int, text string")
    began = time.time()
    found = {r["doc_id"]: r["spans"] for r in S.scan_secrets(df, allow=()).collect()}
    assert time.time() - began < 100
    assert [(s["start"], s["end"]) for s in found[1] if s["kind"] == "entropy"] == [(2 + a, 2 + b) for a, b in windows(string)]
    assert [s["start"] for s in found[2] if s["kind"] == "hex"] == [41 * i for i in range(20_000)]
