"""The front over bounds: gaps within their bounds, duality gaps, errors that fall, sums that rows confirm."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.operators import fronts
from tests.test_models import sample

BOUNDS = [0.0, 0.05, 0.2, 1.0]


def test_front(spark):
    df = sample(spark, 3000).cache()
    points = fronts.constrained_front(df, ["x", "g"], "y", "grp", "a", BOUNDS)
    errors = [p.error for p in points]
    assert errors == sorted(errors, reverse=True)
    for p in points:
        assert abs(p.gap) <= p.bound + 1e-9
        assert -1e-9 <= p.duality_gap <= 0.01
        assert len(p.mixture) <= 2 and abs(sum(s for s, _ in p.mixture) - 1) < 1e-12
        drawn = fronts.mixed_selection(df, "id", ["x", "g"], p)
        seen = drawn.agg(F.avg(F.abs(F.col("chance") - F.col("y"))).alias("error")).first()["error"]
        rates = {r["grp"]: r["t"] for r in drawn.where("y = 1").groupBy("grp").agg(F.avg("chance").alias("t")).collect()}
        assert abs(seen - p.error) < 1e-9 and abs(rates["a"] - rates["b"] - p.gap) < 1e-9
    # the widest bound doesn't bind: its error is that of the plain refit or better
    plain = fronts._Problem(df, ["x", "g"], "y", "grp", "a")
    assert points[-1].error <= plain.judged(plain.fit([0.0]))[0].error + 1e-12
    # and no threshold pair per group, tried on a grid, beats the front by more than its duality gap
    pdf = df.toPandas()
    x, y, a = pdf["x"].to_numpy(), pdf["y"].to_numpy(), (pdf["grp"] == "a").to_numpy()
    best = {b: 1.0 for b in BOUNDS}
    for s in np.linspace(-2, 2, 41):
        for t in np.linspace(-2, 2, 41):
            h = np.where(a, x > s, x > t)
            gap = abs(h[a & (y == 1)].mean() - h[~a & (y == 1)].mean())
            for b in BOUNDS:
                if gap <= b:
                    best[b] = min(best[b], np.mean(h != y))
    assert all(p.error <= best[p.bound] + 0.012 for p in points)


def test_a_group_without_positive_rows_is_an_error(spark):
    df = spark.createDataFrame([(1, 0.5, 1, "a"), (2, 0.1, 0, "b")], "id long, x double, y int, grp string")
    with pytest.raises(ValueError, match="both groups"):
        fronts.constrained_front(df, ["x"], "y", "grp", "a", [0.1])
