"""Group-fairness analytics: rates, gaps, drift, exact selection and threshold methods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.operators.ordering import exact_quantiles, global_rank, global_running_sums

Z95 = 1.959963984540054


def group_of(col: Column, members: list[str], inside: str, outside: str) -> Column:
    """Two-group mapping by membership."""
    return F.when(col.isin(members), inside).otherwise(outside)


def hash_fraction(*parts: Column) -> Column:
    """Uniform number in [0, 1) from the md5 of the joined parts; the same on every run and engine."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_steps() -> list[float]:
    """Cumulative probabilities of Poisson(1), up to the last one below 1 as a double."""
    steps, term, total = [], math.exp(-1), 0.0
    while total + term < 1.0:
        total += term
        steps.append(total)
        term /= len(steps)
    return steps


def poisson_one(u: Column) -> Column:
    """Poisson(1) draw from a uniform number by its distribution function."""
    draw = F.lit(0)
    for step in poisson_steps():
        draw = draw + (u >= F.lit(step)).cast("int")
    return draw


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and sample standard deviations."""
    stats = []
    for c in columns:
        stats += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"sd_{c}")]
    return df.agg(*stats)


def standardize(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the statistics of a reference table (one row)."""
    wide = df.join(F.broadcast(stats))
    return wide.withColumns(
        {f"z_{c}": (F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in columns}
    ).drop(*stats.columns)


def dummies(df: DataFrame, column: str, categories: list[str], prefix: str) -> DataFrame:
    """0/1 columns for a reference list, first category left out, unseen values all zero."""
    return df.withColumns(
        {
            f"{prefix}_{c}": F.coalesce((F.col(column) == c).cast("double"), F.lit(0.0))
            for c in categories[1:]
        }
    )


def select_top(df: DataFrame, score: str, rate: float, identifier: str, name: str = "selected") -> DataFrame:
    """Mark exactly round(rate * n) rows of highest score; ties by hash of the identifier."""
    total = df.agg(F.bround(F.lit(rate) * F.count(F.lit(1))).cast("long").alias("_quota"))
    ranked = global_rank(df, score, F.col(identifier), "_rank")
    return (
        ranked.join(F.broadcast(total))
        .withColumn(name, (F.col("_rank") <= F.col("_quota")).cast("int"))
        .drop("_rank", "_quota")
    )


def largest_remainder(df: DataFrame, group: str, rate: float) -> DataFrame:
    """Quota per group whose sum is exactly round(rate * n); one row per group throughout."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    exact = F.lit(rate) * F.col("n")
    whole = W.partitionBy(F.lit(0))
    base = sizes.withColumn("base", F.floor(exact)).withColumn("rest", exact - F.col("base"))
    spare = F.bround(F.lit(rate) * F.sum("n").over(whole)).cast("long") - F.sum("base").over(whole)
    order = F.row_number().over(whole.orderBy(F.desc("rest"), group))
    return (
        base.withColumn("_spare", spare)
        .withColumn("_order", order)
        .select(group, "n", (F.col("base") + (F.col("_order") <= F.col("_spare")).cast("long")).alias("quota"))
    )


def select_quota(df: DataFrame, group: str, score: str, identifier: str, quotas: DataFrame) -> DataFrame:
    """Mark the ``quota`` best rows of each group; group sizes may be large."""
    ranked = global_rank(df, score, F.col(identifier), "_rank", [group])
    return (
        ranked.join(F.broadcast(quotas.select(group, "quota")), group, "left")
        .withColumn("selected", (F.col("_rank") <= F.coalesce("quota", F.lit(0))).cast("int"))
        .drop("_rank", "quota")
    )


def binned_gap(df: DataFrame, x: str, y: str, group: str, groups: tuple[str, str], bins: int) -> DataFrame:
    """Rates of two groups inside right-closed quantile bins of ``x``."""
    edges = exact_quantiles(df, x, [i / bins for i in range(1, bins)])
    placed = df.join(F.broadcast(edges)).withColumn(
        "bin", F.aggregate("edges", F.lit(0), lambda n, e: n + (F.col(x) > e).cast("int"))
    )
    first, second = groups
    rate = lambda g: F.avg(F.when(F.col(group) == g, F.col(y)))
    return placed.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), rate(first).alias("rate_a"), rate(second).alias("rate_b")
    )


def weighted_bin_gap(table: DataFrame) -> DataFrame:
    """Size-weighted mean of the gaps of the bins."""
    gap = F.col("rate_a") - F.col("rate_b")
    return table.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("gap"))


def fairness_frame(df: DataFrame, keys: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Selection rate, true-positive rate and accuracy per key."""
    p = predicted.cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("selection_rate"), F.avg(truth.cast("double")).alias("base_rate"),
        F.avg(F.when(truth == 1, p)).alias("tpr"), F.avg((truth == predicted).cast("double")).alias("accuracy"),
    )


def group_gaps(frame: DataFrame, keys: list[str], group: str, a: str, b: str) -> DataFrame:
    """Parity and equal-opportunity gap between two groups of a fairness frame."""
    pick = lambda c, g: F.max(F.when(F.col(group) == g, F.col(c)))
    return frame.groupBy(*keys).agg(
        (pick("selection_rate", a) - pick("selection_rate", b)).alias("parity_gap"),
        (pick("tpr", a) - pick("tpr", b)).alias("opportunity_gap"),
        (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("concordance"),
        (F.sum(F.col("selection_rate") * F.col("n")) / F.sum("n")).alias("selection_rate"),
    )


def against_references(
    df: DataFrame, references: list[str], predicted: Column, group: str, a: str, b: str, keys: list[str] | None = None
) -> DataFrame:
    """Gaps against every reference label, one row per key and reference; one pass over the rows."""
    keys = keys or []
    long = df.select(
        *keys, group, predicted.alias("_p"),
        F.explode(F.array(*[F.struct(F.lit(r).alias("reference"), F.col(r).alias("truth")) for r in references])).alias("_r"),
    ).select(*keys, group, "_p", "_r.reference", "_r.truth")
    frame = fairness_frame(long, [*keys, "reference", group], F.col("truth"), F.col("_p"))
    return group_gaps(frame, [*keys, "reference"], group, a, b)


def crosstab_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("o"))


def chi_square(counts: DataFrame) -> DataFrame:
    """Chi-square statistic, size and table shape from grouped counts (one row per cell)."""
    whole = W.partitionBy(F.lit(0))
    cells = counts.withColumns(
        {
            "ra": F.sum("o").over(W.partitionBy("a")),
            "rb": F.sum("o").over(W.partitionBy("b")),
            "n": F.sum("o").over(whole),
        }
    )
    # cells with no row still count: sum (o-e)^2/e = sum o^2/e - n over the observed cells
    expected = F.col("ra") * F.col("rb") / F.col("n")
    return cells.agg(
        (F.sum(F.col("o") * F.col("o") / expected) - F.max("n")).alias("chi2"), F.max("n").alias("n"),
        F.count_distinct("a").alias("rows"), F.count_distinct("b").alias("cols"),
    ).withColumn("dof", (F.col("rows") - 1) * (F.col("cols") - 1))


def cramer_v(counts: DataFrame) -> DataFrame:
    small = F.least(F.col("rows"), F.col("cols")) - 1
    return chi_square(counts).select(F.sqrt(F.col("chi2") / F.col("n") / small).alias("association"))


def ks_statistic(df: DataFrame, x: str, side: Column) -> DataFrame:
    """Two-sample KS distance and its asymptotic p-value; ``side`` is true for the first sample.

    The p-value uses the leading terms of the Kolmogorov series with the usual size correction,
    so it is approximate.
    """
    rows = df.select(
        F.col(x).alias("x"), side.cast("int").alias("a"), (~side).cast("int").alias("b")
    ).where(F.col("x").isNotNull())
    cum = global_running_sums(rows, "x", ["a", "b"])
    sizes = rows.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.col("cum_a") / F.col("na") - F.col("cum_b") / F.col("nb"))
    one = cum.join(F.broadcast(sizes)).agg(F.max(gap).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    en = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    lam = (en + 0.12 + 0.11 / en) * F.col("d")
    series = F.lit(0.0)
    for k in range(1, 20):
        series = series + 2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam)
    return one.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def mean_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Absolute mean difference of batch ``b`` in standard deviations of reference ``a``."""
    left = a.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    )
    right = b.agg(*[F.avg(c).alias(f"b_{c}") for c in columns])
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("measure"),
                    F.abs((F.col(f"b_{c}") - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias("smd"),
                )
                for c in columns
            ]
        )
    ).alias("r")
    return left.join(F.broadcast(right)).select(rows).select("r.measure", "r.smd")


def auc(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve from running counts over distinct scores; ties count half."""
    keys = keys or []
    rows = df.select(
        *keys, F.col(score).cast("double").alias("s"), F.col(label).cast("long").alias("p"),
        (1 - F.col(label)).cast("long").alias("q"),
    ).where(F.col("s").isNotNull())
    cum = global_running_sums(rows, "s", ["p", "q"], keys)
    below = F.col("cum_q") - F.col("q")
    wins = F.sum(F.col("p") * (below + F.col("q") / 2.0))
    return cum.groupBy(*keys).agg((wins / (F.sum("p") * F.sum("q"))).alias("auc"))


def balanced_accuracy(truth: Column, predicted: Column) -> Column:
    hit = (truth == predicted).cast("double")
    return (F.avg(F.when(truth == 1, hit)) + F.avg(F.when(truth == 0, hit))) / 2


def log_likelihood(truth: Column, probability: Column) -> Column:
    return F.sum(F.when(truth == 1, F.log(probability)).otherwise(F.log(1 - probability)))


def bootstrap_ci(
    df: DataFrame, identifier: str, numerators: dict[str, tuple[Column, Column]], replicates: int, low: float = 0.025,
    high: float = 0.975,
) -> DataFrame:
    """Percentile intervals of ratios sum(w * num) / sum(w * den) under Poisson(1) weights.

    Weights come from a hash of (id, replicate). Every map task reduces its rows to one
    row per replicate before the shuffle, so what moves is replicates x tasks rows.
    """
    draws = df.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    weight = poisson_one(hash_fraction(F.col(identifier), F.col("_b")))
    sums = []
    for name, (num, den) in numerators.items():
        sums += [F.sum(weight * num).alias(f"n_{name}"), F.sum(weight * den).alias(f"d_{name}")]
    per = draws.groupBy("_b").agg(*sums)
    out = []
    for name in numerators:
        ratio = F.col(f"n_{name}") / F.col(f"d_{name}")
        out += [F.percentile(ratio, F.lit(low)).alias(f"{name}_low"), F.percentile(ratio, F.lit(high)).alias(f"{name}_high")]
    return per.agg(*out)


def rate_band(batch: DataFrame, expected: DataFrame, key: str, y: Column) -> DataFrame:
    """Observed rate per key beside the expected rate +- z standard errors."""
    seen = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("observed"))
    margin = F.lit(Z95) * F.sqrt(F.col("expected") * (1 - F.col("expected")) / F.col("n"))
    return (
        seen.join(expected.select(key, "expected"), key, "left")
        .withColumns({"low": F.col("expected") - margin, "high": F.col("expected") + margin})
        .withColumn("out_of_band", (~F.col("observed").between(F.col("low"), F.col("high"))).cast("int"))
    )


def group_thresholds(df: DataFrame, score: str, label: str, group: str, constraint: str, steps: int = 100) -> DataFrame:
    """Score threshold per group under an equal rate (``tpr`` or ``selection``), least total error.

    For each rate k/steps the threshold of a group is the highest score that reaches the
    rate. The common rate with the fewest errors is kept, the lowest one on a tie.
    """
    rows = df.select(
        group, (-F.col(score)).alias("s"), F.col(label).cast("long").alias("p"),
        (1 - F.col(label)).cast("long").alias("q"),
    )
    cum = global_running_sums(rows, "s", ["p", "q"], [group])
    totals = rows.groupBy(group).agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    full = cum.join(F.broadcast(totals), group)
    tpr = constraint == "tpr"
    reach = F.col("cum_p") if tpr else F.col("cum_p") + F.col("cum_q")
    step = F.col("p") if tpr else F.col("p") + F.col("q")
    base = F.col("tp") if tpr else F.col("tp") + F.col("tq")
    last = F.floor(reach * steps / base)
    first = F.floor((reach - step) * steps / base) + 1
    points = full.where(last >= first).select(
        group, F.explode(F.sequence(first, last)).alias("k"), (-F.col("s")).alias("threshold"),
        (F.col("cum_q") + F.col("tp") - F.col("cum_p")).alias("errors"),
    )
    best = points.groupBy("k").agg(F.sum("errors").alias("total")).agg(F.min(F.struct("total", "k")).alias("best"))
    return points.join(F.broadcast(best), F.col("k") == F.col("best.k")).select(
        group, F.col("k").alias("rate_step"), "threshold", "errors"
    )


def debiased_score(weights: dict[str, float], intercept: float, group_terms: set[str], removed: Column) -> Column:
    """Linear score with a share ``removed`` of the group terms taken out."""
    total = F.lit(intercept)
    for name, weight in weights.items():
        kept = (1 - removed) if name in group_terms else F.lit(1.0)
        total = total + F.col(name) * F.lit(weight) * kept
    return total
