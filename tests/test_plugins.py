"""The default engine: its answers, and each pattern looked for once."""

from ravelin.functions import plugins


def test_lexicon_answers_look_for_each_pattern_once(spark):
    df = spark.createDataFrame([(1, "Audit du budget, contrôle"), (2, "rien"), (3, None)], "id int, text string")
    out = plugins.ask(df).select("id", "answer.choice", "answer.confidence")
    assert {(r.id, r.choice, round(r.confidence, 6)) for r in out.collect()} == {(1, "oversight", 0.666667), (2, "noise", 1.0), (3, "noise", 1.0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("budget") == 1
