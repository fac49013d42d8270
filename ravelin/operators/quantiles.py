"""Exact grouped quantiles.

``percentile`` keeps every distinct value of a group in one buffer. Here a
sketch first brackets the wanted rank, and only the distinct values inside the
bracket, 0.2 % of a group, are ordered by one task. Groups of at most
``SMALL_GROUP`` rows, in which the bracket could be narrower than one row, are
ordered whole. A bracket that misses its rank is an error, never a wrong value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.session import cut_lineage

SMALL_GROUP = 10_000
ACCURACY = 2_000
SLACK = 2.0 / ACCURACY
#: Up to so many brackets go to the rows; with few groups, an exchange by group would sort whole groups in a task.
SENT_GROUPS = 10_000


def grouped_quantile(df: DataFrame, keys: list[str], values: dict[str, Column], p: float = 0.5) -> DataFrame:
    """Linear-interpolated quantile ``p`` of each value per key: columns ``keys + names``.

    Null values are skipped; a key with only nulls is absent.
    """
    measures = F.explode(
        F.array(*[F.struct(F.lit(n).alias("m"), c.cast("double").alias("v")) for n, c in values.items()])
    )
    long = (
        df.select(*keys, measures.alias("_m"))
        .select(*keys, F.col("_m.m").alias("_measure"), F.col("_m.v").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    )
    by = [*keys, "_measure"]
    low_p, high_p = max(0.0, p - SLACK), min(1.0, p + SLACK)
    bracket = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", [low_p, high_p], ACCURACY).alias("_b"),
    )
    small = F.col("_n") <= SMALL_GROUP
    bracket = bracket.select(
        *by,
        "_n",
        F.when(small, F.lit(float("-inf"))).otherwise(F.col("_b")[0]).alias("_lo"),
        F.when(small, F.lit(float("inf"))).otherwise(F.col("_b")[1]).alias("_hi"),
        (F.lit(p) * (F.col("_n") - 1)).alias("_r"),
    )
    bracket = cut_lineage(bracket)
    if bracket.count() <= SENT_GROUPS:
        bracket = F.broadcast(bracket)
    # rows below the bracket collapse to one null row per map task, rows above it are dropped
    joined = long.join(bracket, by).where(F.col("_v") <= F.col("_hi"))
    counted = joined.groupBy(
        *by, "_r", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_at")
    ).agg(F.count(F.lit(1)).alias("_c"))
    upto = W.partitionBy(*by).orderBy(F.col("_at").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    placed = counted.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    holds = lambda rank: (F.col("_start") <= rank) & (rank < F.col("_end"))
    picked = placed.groupBy(*by).agg(
        F.max(F.when(holds(F.floor("_r")), F.col("_at"))).alias("_low"),
        F.max(F.when(holds(F.ceil("_r")), F.col("_at"))).alias("_high"),
        F.first("_r").alias("_r"),
    )
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_r") - F.floor("_r"))
    missed = F.col("_low").isNull() | F.col("_high").isNull()
    named = picked.withColumn("_q", F.when(missed, F.raise_error(F.lit("the sketch missed a rank")).cast("double")).otherwise(value))
    if not keys:
        return named.agg(
            *[F.max(F.when(F.col("_measure") == n, F.col("_q"))).alias(n) for n in values]
        )
    return named.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_measure") == n, F.col("_q"))).alias(n) for n in values]
    )
