"""Form KC beside the character database, on single characters and on sequences."""

import random
import unicodedata

from pyspark.sql import functions as F

from ravelin.functions import composition


def differing(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("r", composition.composed(F.col("t")))
    return [(r.t, r.r) for r in df.collect() if r.r != (None if r.t is None else unicodedata.normalize("NFKC", r.t))]


def test_every_character(spark):
    codes = [c for block in composition.BLOCKS for c in block if not 0xD800 <= c < 0xE000]
    assert differing(spark, [f"a{chr(c)}b" for c in codes] + [chr(c) for c in codes]) == []


def test_every_pair_and_marks_between(spark):
    pairs = list(composition._pairs())
    assert differing(spark, pairs + [p[0] + "̣" + p[1] for p in pairs] + [p[0] + "̕" + p[1] + "x" for p in pairs]) == []


def test_random_sequences(spark):
    rng = random.Random(5)
    alphabet = "aeoEA \n🎉é½ﬁ…" + "̧̣́̂̈́̕োೋ각가각゙かΩ"
    assert differing(spark, ["".join(rng.choices(alphabet, k=rng.randrange(1, 12))) for _ in range(4000)] + ["", None, "é" * 20000]) == []



def test_characters_beyond_the_blocks_and_bytes_that_are_no_text(spark):
    assert differing(spark, ["a\U0001d400b", "\U0002f800", "\U0001d15é", "\U000110a5\U000110ba"]) == []
    df = spark.sql("SELECT CAST(X'6565CC81FF65CC81' AS STRING) AS t")
    assert bytes(df.select(composition.composed(F.col("t")).cast("binary")).first()[0]) == b"e\xc3\xa9\xff\xc3\xa9"


def test_texts_full_of_marks_take_no_pattern_per_character(spark):
    plan = spark.range(1).select(composition.composed(F.lit("é"))).select("*")._jdf.queryExecution().toString()
    assert "regexp" not in plan and "lambdafunction" not in plan
