"""Statistical and learned models of the fairness audit, fitted with Spark ML or with one pass per iteration."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators import fairness as fair
from ravelin.operators.quantiles import grouped_quantile
from ravelin.session import cut_lineage

REPLICATE_STEP = 0x9E3779B97F4A7C15
TREES, LEAF = 300, 20


def assemble(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=name, handleInvalid="error").transform(df)


def chi2_tail(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square law by the series of the incomplete gamma function."""
    if statistic <= 0:
        return 1.0
    a, x = dof / 2.0, statistic / 2.0
    term = total = 1.0 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return max(0.0, 1.0 - math.exp(a * math.log(x) - x - math.lgamma(a)) * total)


def fit_logit(df: DataFrame, features: list[str], label: str):
    """Unpenalised logistic regression."""
    rows = assemble(df.select(*features, F.col(label).cast("double").alias("_y")), features)
    return GeneralizedLinearRegression(family="binomial", featuresCol="features", labelCol="_y", maxIter=50).fit(rows)


def coefficient_table(df: DataFrame, model, features: list[str]) -> DataFrame:
    """One row per feature: coefficient, standard error and 95 % interval."""
    errors = model.summary.coefficientStandardErrors
    rows = [(n, float(c), float(e)) for n, c, e in zip([*features, "intercept"], [*model.coefficients, model.intercept], errors)]
    table = df.sparkSession.createDataFrame(rows, "feature string, coefficient double, std_error double")
    return table.withColumns(
        {
            "low": F.col("coefficient") - fair.Z95 * F.col("std_error"),
            "high": F.col("coefficient") + fair.Z95 * F.col("std_error"),
        }
    )


def weights_of(model, features: list[str]) -> dict[str, float]:
    return {n: float(c) for n, c in zip(features, model.coefficients)}


def linear_score(model, features: list[str], removed: set[str] | None = None) -> Column:
    """Linear predictor as a column expression, with some terms left out."""
    return fair.debiased_score(weights_of(model, features), float(model.intercept), removed or set(), F.lit(1.0))


def log_likelihood(df: DataFrame, model, features: list[str], label: str) -> DataFrame:
    probability = 1 / (1 + F.exp(-linear_score(model, features)))
    return df.agg(fair.log_likelihood(F.col(label), probability).alias("loglik"))


def lr_test(df: DataFrame, reduced: tuple, full: tuple, label: str) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p-value of a likelihood-ratio test of (model, features) pairs; one pass."""
    prob = lambda m: 1 / (1 + F.exp(-linear_score(*m)))
    row = df.agg(
        fair.log_likelihood(F.col(label), prob(full)).alias("a"), fair.log_likelihood(F.col(label), prob(reduced)).alias("b")
    ).first()
    statistic, dof = 2 * (row.a - row.b), len(full[1]) - len(reduced[1])
    return statistic, dof, chi2_tail(statistic, dof)


def decompose_gap(df: DataFrame, features: list[str], label: str, group: str, a: str, b: str) -> DataFrame:
    """Explained and unexplained parts of the rate gap, the explained part shared by coefficient x mean difference."""
    model = fit_logit(df.where(F.col(group) == a), features, label)
    probability = 1 / (1 + F.exp(-linear_score(model, features)))
    is_a = F.col(group) == a
    stats = [F.avg(F.when(is_a, F.col(label))).alias("rate_a"), F.avg(F.when(~is_a, F.col(label))).alias("rate_b"),
             F.avg(F.when(~is_a, probability)).alias("counterfactual")]
    for f in features:
        stats.append((F.avg(F.when(is_a, F.col(f))) - F.avg(F.when(~is_a, F.col(f)))).alias(f"d_{f}"))
    row = df.agg(*stats)
    weights = weights_of(model, features)
    total = F.lit(0.0)
    for f in features:
        total = total + F.lit(weights[f]) * F.col(f"d_{f}")
    explained = F.col("rate_a") - F.col("counterfactual")
    part = lambda name, value: F.struct(F.lit(name).alias("part"), value.alias("points"))
    parts = [part(f, explained * F.lit(weights[f]) * F.col(f"d_{f}") / total) for f in features]
    parts += [part("explained", explained), part("unexplained", F.col("counterfactual") - F.col("rate_b")), part("gap", F.col("rate_a") - F.col("rate_b"))]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.part", "p.points")


def split_by_hash(df: DataFrame, identifier: str, share: float, salt: str) -> tuple[DataFrame, DataFrame]:
    """Seeded split: the same rows go to the same side on every run."""
    u = fair.hash_fraction(F.lit(salt), F.col(identifier))
    return df.where(u < share), df.where(u >= share)


def forest(train: DataFrame, features: list[str], label: str, trees: int = TREES, leaf: int = LEAF):
    """Random forest without its training summary.

    The summary holds the session, and a prediction sends its model to the tasks: once the session has observed a query, it can't be sent.
    """
    rows = assemble(train.select(*features, F.col(label).cast("double").alias("_y")), features)
    return RandomForestClassifier(featuresCol="features", labelCol="_y", numTrees=trees, minInstancesPerNode=leaf, seed=42).fit(rows).copy()


def predict(df: DataFrame, model, features: list[str]) -> DataFrame:
    """Rows with ``prob`` and ``pred``."""
    scored = model.transform(assemble(df, features))
    return scored.withColumn("prob", vector_to_array("probability")[1]).withColumn("pred", F.col("prediction").cast("int")).drop(
        "features", "probability", "rawPrediction", "prediction"
    )


def ablate(train: DataFrame, test: DataFrame, sets: dict[str, list[str]], label: str, group: str, a: str, b: str, trees: int) -> DataFrame:
    """Accuracy and parity gap of the forest retrained on each column set; a handful of fits."""
    out = None
    for name, features in sets.items():
        scored = predict(test, forest(train, features, label, trees), features)
        frame = fair.fairness_frame(scored, [group], F.col(label), F.col("pred"))
        row = fair.group_gaps(frame, [], group, a, b).select(F.lit(name).alias("columns"), F.col("concordance").alias("accuracy"), "parity_gap")
        out = row if out is None else out.unionByName(row)
    return out


def proxy_power(df: DataFrame, identifier: str, sets: dict[str, list[str]], target: str, folds: int, trees: int) -> DataFrame:
    """How well column sets predict a group: out-of-fold balanced accuracy and AUC, mean and spread over the folds."""
    fold = F.floor(fair.hash_fraction(F.lit("fold"), F.col(identifier)) * folds).cast("int")
    rows = cut_lineage(df.withColumn("fold", fold))
    scored = None
    for name, features in sets.items():
        for k in range(folds):
            model = forest(rows.where(F.col("fold") != k), features, target, trees)
            part = predict(rows.where(F.col("fold") == k), model, features).select(F.lit(name).alias("columns"), "fold", target, "prob", "pred")
            scored = part if scored is None else scored.unionByName(part)
    scored = cut_lineage(scored)
    ba = scored.groupBy("columns", "fold").agg(fair.balanced_accuracy(F.col(target), F.col("pred")).alias("ba"))
    area = fair.auc(scored, "prob", target, ["columns", "fold"])
    return ba.join(area, ["columns", "fold"]).groupBy("columns").agg(
        F.avg("ba").alias("ba"), F.stddev_samp("ba").alias("ba_sd"), F.avg("auc").alias("auc")
    )


# ---- many logistic refits at once ---------------------------------------------------------------


def poisson_weights(hashes: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) weights per row and replicate from a 64-bit row hash; the same in every pass."""
    steps = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(REPLICATE_STEP)
    z = hashes.astype(np.uint64)[:, None] + steps[None, :]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(cuts, u).astype(float)


def _newton_sums(features: list[str], label: str, beta: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    replicates, width = beta.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((replicates, width, width))
        grad = np.zeros((replicates, width))
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(float)])
            w = poisson_weights(pdf["_hash"].to_numpy(np.int64), replicates)
            p = 1 / (1 + np.exp(-x @ beta.T))
            grad += (w * (pdf[label].to_numpy(float)[:, None] - p)).T @ x
            curve = w * p * (1 - p)
            products = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
            gram += (curve.T @ products).reshape(gram.shape)
        flat = np.concatenate([gram.reshape(replicates, -1), grad], axis=1)
        yield pd.DataFrame({"b": np.repeat(np.arange(replicates), flat.shape[1]), "k": np.tile(np.arange(flat.shape[1]), replicates), "v": flat.ravel()})

    return run


def bootstrap_logit(df: DataFrame, identifier: str, features: list[str], label: str, replicates: int, steps: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    """Coefficients (intercept first) of ``replicates`` weighted refits, all moved together by Newton steps.

    Each step is one pass: tasks add up their normal equations for every replicate, Spark sums
    them, and what comes back is replicates x (p^2 + p) numbers, whatever the number of rows. It ends when no
    coefficient moves by more than ``tolerance``; not getting there in ``steps`` is an error.
    """
    rows = df.select(*features, label, F.xxhash64(F.col(identifier)).alias("_hash"))
    width = len(features) + 1
    beta = np.zeros((replicates, width))
    for _ in range(steps):
        sums = rows.mapInPandas(_newton_sums(features, label, beta), "b int, k int, v double").groupBy("b", "k").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros((replicates, width * width + width))
        flat[sums["b"], sums["k"]] = sums["v"]
        gram = flat[:, : width * width].reshape(replicates, width, width) + 1e-9 * np.eye(width)
        step = np.linalg.solve(gram, flat[:, width * width :][:, :, None])[:, :, 0]
        beta = beta + step
        if np.abs(step).max() <= tolerance:
            return beta
    raise RuntimeError("the refits did not converge")


def decision_flips(df: DataFrame, identifier: str, features: list[str], beta: np.ndarray, removed: set[str], rate: float) -> DataFrame:
    """Decisions per replicate that differ from the unweighted choice ``selected``: one row per replicate."""
    kept = [0.0 if f in removed else 1.0 for f in features]
    lists = F.array(*[F.struct(F.lit(b).alias("b"), F.array(*[F.lit(float(v)) for v in row]).alias("w")) for b, row in enumerate(beta)])
    wide = df.select(identifier, "selected", *features, F.explode(lists).alias("r"))
    score = F.get("r.w", 0)
    for i, f in enumerate(features):
        score = score + F.get("r.w", i + 1) * F.lit(kept[i]) * F.col(f)
    scored = wide.select(identifier, F.col("selected").alias("base"), F.col("r.b").alias("b"), score.alias("score"))
    quotas = scored.groupBy("b").agg(F.bround(F.lit(rate) * F.count(F.lit(1))).cast("long").alias("quota"))
    chosen = fair.select_quota(scored, "b", "score", identifier, quotas)
    return chosen.groupBy("b").agg(F.count_if(F.col("base") != F.col("selected")).alias("flips"))


def reduction(df: DataFrame, features: list[str], label: str, group: str, bound: float, rounds: int = 6, cap: float = 5.0, rate: float = 2.0) -> DataFrame:
    """Selection under a bound on the true-positive-rate gap by a sequence of cost-weighted refits.

    Multipliers per group move with the excess gap; the final decision is the majority of the refits.
    The two-row group statistics are all that reaches the driver.
    """
    rows = cut_lineage(assemble(df, features))
    sizes = {r[group]: r.n for r in rows.where(F.col(label) == 1).groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, positives = rows.count(), sum(sizes.values())
    theta = {(g, s): 0.0 for g in sizes for s in (1, -1)}
    votes = F.lit(0.0)
    scored = rows
    for k in range(rounds):
        top = 1.0 + sum(math.exp(v) for v in theta.values())
        lam = {g: cap * (math.exp(theta[g, 1]) - math.exp(theta[g, -1])) / top for g in sizes}
        pull = F.lit(0.0)
        for g, m in sizes.items():
            pull = F.when(F.col(group) == g, lam[g] / m - sum(lam.values()) / positives).otherwise(pull)
        cost = (1 - 2 * F.col(label)) / F.lit(float(n)) + F.when(F.col(label) == 1, pull).otherwise(0.0)
        weighted = rows.withColumn("_t", (cost < 0).cast("double")).withColumn("_w", F.abs(cost) * n)
        model = LogisticRegression(featuresCol="features", labelCol="_t", weightCol="_w", maxIter=100).fit(weighted)
        line = fair.debiased_score({f: float(c) for f, c in zip(features, model.coefficients)}, float(model.intercept), set(), F.lit(0.0))
        scored = scored.withColumn(f"_h{k}", (line > 0).cast("int"))
        tpr = scored.where(F.col(label) == 1).groupBy(group).agg(F.avg(f"_h{k}").alias("t"), F.count(F.lit(1)).alias("n")).collect()
        overall = sum(r.t * r.n for r in tpr) / positives
        for r in tpr:
            theta[r[group], 1] += rate * (r.t - overall - bound)
            theta[r[group], -1] += rate * (overall - r.t - bound)
        votes = votes + F.col(f"_h{k}")
    return scored.withColumn("selected", (votes / rounds >= 0.5).cast("int")).select(*df.columns, "selected")


def penalised_logit(df: DataFrame, features: list[str], label: str):
    """Logistic regression with the ridge term 0.5 |w|^2 on the summed loss."""
    rows = assemble(df.select(*features, F.col(label).cast("double").alias("_y")), features)
    n = max(rows.count(), 1)
    return LogisticRegression(featuresCol="features", labelCol="_y", regParam=1.0 / n, standardization=False, maxIter=200).fit(rows)


def monitor(batch: DataFrame, expected: DataFrame, key: str, decision: str, criteria: list[str], group: str, limits: dict[str, float]) -> DataFrame:
    """Indicators of a batch with their verdict: rate, keys out of band, residual penalty, group AUC.

    The penalty is the group coefficient over the first criterion's coefficient.
    """
    rate = batch.agg(F.avg(decision).alias("value")).select(F.lit("rate").alias("indicator"), "value")
    band = fair.rate_band(batch, expected, key, F.col(decision)).agg(F.sum("out_of_band").cast("double").alias("value")).select(
        F.lit("out of band").alias("indicator"), "value"
    )
    features = [*criteria, group]
    w = dict(zip(features, penalised_logit(batch, features, decision).coefficients))
    penalty = float(w[group] / w[criteria[0]])
    guess = penalised_logit(batch, criteria, group)
    line = fair.debiased_score(dict(zip(criteria, map(float, guess.coefficients))), float(guess.intercept), set(), F.lit(0.0))
    area = fair.auc(batch.withColumn("_s", line), "_s", group).select(F.lit("group auc").alias("indicator"), F.col("auc").alias("value"))
    one = batch.sparkSession.createDataFrame([("residual penalty", penalty)], "indicator string, value double")
    table = rate.unionByName(band).unionByName(one).unionByName(area)
    ok = (
        F.when(F.col("indicator") == "rate", F.col("value").between(limits["rate_low"], limits["rate_high"]))
        .when(F.col("indicator") == "out of band", F.col("value") == 0)
        .when(F.col("indicator") == "residual penalty", F.abs("value") <= limits["penalty"])
        .otherwise(F.col("value") <= limits["auc"])
    )
    return table.withColumn("conforms", ok.cast("int"))


def unit_regression(pairs: DataFrame, expiring: DataFrame, features: list[str], renewal: str, growth: str) -> DataFrame:
    """Forecast of the growth of expiring units: log-ratio regression scored as renewal and as re-letting, mixed by share."""
    target = pairs.withColumn("_y", F.log1p(F.col(growth) / 100))
    complete = assemble(target.dropna(subset=[*features, "_y"]), features)
    model = LinearRegression(featuresCol="features", labelCol="_y", standardization=True, maxIter=50).fit(complete)
    share = pairs.agg(F.avg(F.col(renewal)).alias("_share"))

    def score(flag: float) -> Column:
        total = F.lit(float(model.intercept))
        for f, c in zip(features, model.coefficients):
            total = total + F.lit(float(c)) * (F.lit(flag) if f == renewal else F.col(f))
        return F.expm1(total) * 100

    scored = expiring.join(F.broadcast(share)).withColumn("g", F.col("_share") * score(1.0) + (1 - F.col("_share")) * score(0.0))
    return grouped_quantile(scored, [], {"predicted": F.col("g")})
