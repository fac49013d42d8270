import math

import numpy as np
import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ravelin.operators import fairness as fair, models


def sample(spark, n=4000):
    rng = np.random.default_rng(0)
    x, g = rng.normal(size=n), rng.integers(0, 2, n)
    p = 1 / (1 + np.exp(-(0.3 + 1.2 * x - 0.8 * g)))
    y = (rng.uniform(size=n) < p).astype(int)
    rows = [(int(i), float(a), float(b), int(c), "a" if b == 0 else "b") for i, (a, b, c) in enumerate(zip(x, g, y))]
    return spark.createDataFrame(rows, "id long, x double, g double, y int, grp string")


def test_logit_and_refits_agree(spark):
    df = sample(spark)
    model = models.fit_logit(df, ["x", "g"], "y")
    assert abs(model.coefficients[0] - 1.2) < 0.15 and abs(model.coefficients[1] + 0.8) < 0.2
    beta = models.bootstrap_logit(df, "id", ["x", "g"], "y", 30)
    assert np.allclose(beta.mean(axis=0)[1:], model.coefficients.toArray(), atol=0.08)
    errors = model.summary.coefficientStandardErrors
    assert abs(beta[:, 1].std() - errors[0]) < 0.4 * errors[0]


def test_gap_parts_add_up(spark):
    parts = {r.part: r.points for r in models.decompose_gap(sample(spark), ["x"], "y", "grp", "a", "b").collect()}
    assert abs(parts["explained"] + parts["unexplained"] - parts["gap"]) < 1e-9 and abs(parts["x"] - parts["explained"]) < 1e-9


def test_quota_totals_are_exact(spark):
    df = sample(spark, 1003)
    assert fair.select_top(df, "x", 0.4, "id").agg(F.sum("selected")).first()[0] == round(0.4 * 1003)
    quotas = fair.largest_remainder(df, "grp", 0.4)
    assert fair.select_quota(df, "grp", "x", "id", quotas).agg(F.sum("selected")).first()[0] == round(0.4 * 1003)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (2.0, 1), (0.0, 0)], "s double, y int")
    assert abs(fair.auc(df, "s", "y").first().auc - 0.875) < 1e-12


def test_chi2_tail():
    assert abs(models.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(models.chi2_tail(9.487729036781154, 4) - 0.05) < 1e-9
    assert math.isclose(models.chi2_tail(2.0, 2), math.exp(-1), rel_tol=1e-9)


def test_reduction_narrows_the_gap(spark):
    df = sample(spark)
    gap = lambda rows: abs(np.subtract(*[r.tpr for r in fair.fairness_frame(rows, ["grp"], F.col("y"), F.col("selected")).orderBy("grp").collect()]))
    model = models.fit_logit(df, ["x", "g"], "y")
    plain = df.withColumn("selected", (models.linear_score(model, ["x", "g"]) > 0).cast("int"))
    assert gap(models.reduction(df, ["x", "g"], "y", "grp", 0.02)) < gap(plain)


def test_forest_predicts_after_an_observed_query(spark):
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    df = sample(spark, 400)
    scored = models.predict(df, models.forest(df, ["x", "g"], "y", trees=5), ["x", "g"])
    assert scored.where(F.col("pred") == F.col("y")).count() > 240


def test_normal_equations_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.normal(size=30), "y": rng.integers(0, 2, 30), "_hash": rng.integers(-(2**60), 2**60, 30)})
    beta = rng.normal(size=(4, 2))
    sums = next(models._newton_sums(["x"], "y", beta)(iter([pdf])))["v"].to_numpy().reshape(4, 6)
    x, w = np.column_stack([np.ones(30), pdf["x"]]), models.poisson_weights(pdf["_hash"].to_numpy(), 4)
    for b in range(4):
        p = 1 / (1 + np.exp(-x @ beta[b]))
        gram = sum(w[n, b] * p[n] * (1 - p[n]) * np.outer(x[n], x[n]) for n in range(30))
        assert np.allclose(sums[b], np.r_[gram.ravel(), sum(w[n, b] * (pdf["y"][n] - p[n]) * x[n] for n in range(30))])
