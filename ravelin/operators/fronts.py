"""Selection under bounds on the gap of true-positive rates of two groups: a front over all bounds by column generation.

A selection is a mixture of linear rules. With the error and the signed gap of each rule as a point, the least error under a bound is a
point of the lower convex hull: it mixes two rules at most, and the hull's slope there is the multiplier of the bound. For these
multipliers the cost-weighted refits give new rules; those of all bounds are fitted together, so a Newton step is one pass over the rows
for the whole front. The refits also give the lower bound of the error under each bound (the value of the Lagrangian at its multiplier),
and the difference is the duality gap. It ends when every gap is within the tolerance, or when no refit improves a Lagrangian.

What comes back per pass is a few sums per rule, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-6
NEWTON_STEPS, NEWTON_TOLERANCE = 12, 1e-4


@dataclass
class Rule:
    """Select where intercept + weights . features > 0; its error and signed gap (first group less second) over the rows it was fitted on."""

    weights: np.ndarray
    error: float
    gap: float


@dataclass
class FrontPoint:
    bound: float
    error: float
    gap: float
    lower: float
    multiplier: float
    #: Rules and the share of each.
    mixture: list[tuple[float, Rule]]

    @property
    def duality_gap(self) -> float:
        return self.error - self.lower


def _sums(rows: DataFrame, task: Callable[[pd.DataFrame], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all batches of an array that ``task`` makes of one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for batch in batches:
            total += task(batch)
        yield pd.DataFrame({"k": np.arange(total.size), "v": total.ravel()})

    found = rows.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(int(np.prod(shape)))
    out[found["k"]] = found["v"]
    return out.reshape(shape)


def _arrays(features: list[str], first: float, second: float, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns with a leading one, labels, and each row's part in the gap."""
    x = np.column_stack([np.ones(len(batch)), batch[features].to_numpy(float)])
    y, g = batch["_y"].to_numpy(float), batch["_g"].to_numpy(float)
    return x, y, y * (g / first - (1 - g) / second)


class _Problem:
    def __init__(self, df: DataFrame, features: list[str], label: str, group: str, first: str):
        self.features = features
        self.rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y"), (F.col(group) == first).cast("double").alias("_g"))
        one = self.rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p"), F.sum(F.col("_y") * F.col("_g")).alias("m")).first()
        self.n, self.first, self.second = one["n"] or 0, one["m"] or 0.0, (one["p"] or 0.0) - (one["m"] or 0.0)
        if not self.n or not self.first or not self.second:
            raise ValueError("both groups need rows with a positive label")

        self.arrays = partial(_arrays, features, self.first, self.second)

    def fit(self, multipliers: list[float]) -> list[np.ndarray]:
        """Rules of least cost-weighted logistic loss, one per multiplier, moved together by Newton steps."""
        k, width = len(multipliers), len(self.features) + 1
        pull, n, arrays = np.array(multipliers), self.n, self.arrays
        beta = np.zeros((k, width))
        for _ in range(NEWTON_STEPS):

            def task(batch: pd.DataFrame, beta=beta) -> np.ndarray:
                x, y, part = arrays(batch)
                cost = ((1 - 2 * y) / n)[:, None] + part[:, None] * pull[None, :]
                p = 1 / (1 + np.exp(-np.clip(x @ beta.T, -40, 40)))
                weight = np.abs(cost) * n
                grad = (weight * ((cost < 0) - p)).T @ x
                curve = weight * p * (1 - p)
                gram = np.stack([x.T @ (x * curve[:, [i]]) for i in range(k)])
                return np.concatenate([gram.reshape(k, -1), grad], 1)

            flat = _sums(self.rows, task, (k, width * width + width))
            gram = flat[:, : width * width].reshape(k, width, width) + RIDGE * n * np.eye(width)
            grad = flat[:, width * width :] - RIDGE * n * beta
            step = np.linalg.solve(gram, grad[:, :, None])[:, :, 0]
            # a long step is shortened: weights of one sign can make the loss flat
            step *= np.minimum(1.0, 5.0 / np.maximum(np.abs(step).max(1, keepdims=True), 1e-12))
            beta = beta + step
            if np.abs(step).max() <= NEWTON_TOLERANCE:
                break
        return list(beta)

    def judged(self, weights: list[np.ndarray]) -> list[Rule]:
        beta, n, arrays = np.array(weights), self.n, self.arrays

        def task(batch: pd.DataFrame) -> np.ndarray:
            x, y, part = arrays(batch)
            chosen = (x @ beta.T > 0).astype(float)
            return np.stack([np.abs(chosen - y[:, None]).sum(0) / n, part @ chosen], 1)

        found = _sums(self.rows, task, (len(weights), 2))
        return [Rule(w, float(e), float(g)) for w, (e, g) in zip(weights, found)]


def _best(pool: list[Rule], bound: float) -> tuple[float, float, float, list[tuple[float, Rule]]]:
    """(error, gap, multiplier, mixture) of least error with a gap of at most ``bound`` either way, over mixtures of rules."""
    inside = [(r.error, abs(r.gap), r.gap, 0.0, [(1.0, r)]) for r in pool if abs(r.gap) <= bound]
    for side in (bound, -bound):
        for a in pool:
            for b in pool:
                if a.gap < side < b.gap:
                    share = (side - a.gap) / (b.gap - a.gap)
                    slope = (b.error - a.error) / (b.gap - a.gap)
                    inside.append(((1 - share) * a.error + share * b.error, abs(side), side, -slope, [(1 - share, a), (share, b)]))
    if not inside:
        raise ValueError("no rule selects both groups alike")
    error, _, gap, multiplier, mixture = min(inside, key=lambda x: (round(x[0], 12), x[1]))
    return error, gap, multiplier, mixture


def constrained_front(df: DataFrame, features: list[str], label: str, group: str, first: str, bounds: list[float], tolerance: float = 2e-3, rounds: int = 20) -> list[FrontPoint]:
    """Least error under each bound on the gap of true-positive rates between group ``first`` and the rest, with its duality gap.

    Rules that select nobody and everybody have no gap, so every bound can be met. Errors fall with the bound.
    """
    problem = _Problem(df, features, label, group, first)
    width = len(features) + 1
    nobody, everybody = np.zeros(width), np.zeros(width)
    nobody[0], everybody[0] = -1.0, 1.0
    pool = problem.judged([nobody, everybody, *problem.fit([0.0])])
    asked = {0.0}
    while True:
        points = []
        for bound in sorted(bounds):
            error, gap, multiplier, mixture = _best(pool, bound)
            lower = min(r.error + multiplier * r.gap for r in pool) - abs(multiplier) * bound
            points.append(FrontPoint(bound, error, gap, lower, multiplier, mixture))
        rounds -= 1
        fresh = sorted({round(p.multiplier, 9) for p in points} - asked)
        if not fresh or rounds < 0:
            return points
        asked |= set(fresh)
        found = problem.judged(problem.fit(fresh))
        # the Lagrangian at a new multiplier is as low as the refit for it makes it
        better = [r for r, m in zip(found, fresh) if r.error + m * r.gap < min(p.error + m * p.gap for p in pool) - tolerance]
        pool += found
        if not better:
            return [_with_pool(p, pool) for p in points]


def _with_pool(point: FrontPoint, pool: list[Rule]) -> FrontPoint:
    error, gap, _, mixture = _best(pool, point.bound)
    lower = min(r.error + point.multiplier * r.gap for r in pool) - abs(point.multiplier) * point.bound
    return FrontPoint(point.bound, error, gap, lower, point.multiplier, mixture)


def mixed_selection(df: DataFrame, identifier: str, features: list[str], point: FrontPoint) -> DataFrame:
    """Adds ``chance``, the mixture's probability of selection, and ``selected``, drawn by the hash of the id."""

    def rule(weights: np.ndarray) -> Column:
        total = F.lit(float(weights[0]))
        for f, w in zip(features, weights[1:]):
            total = total + F.lit(float(w)) * F.col(f)
        return (total > 0).cast("double")

    chance = F.lit(0.0)
    for share, r in point.mixture:
        chance = chance + F.lit(float(share)) * rule(r.weights)
    draw = F.pmod(F.xxhash64(F.col(identifier)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.withColumn("chance", chance).withColumn("selected", (draw < F.col("chance")).cast("int"))
