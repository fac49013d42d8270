"""Ordered computations that stay parallel when one key holds much of the data.

A plain window puts a whole key on one task. Here each key is cut into chunks
that follow the order (a month, a block of line numbers), the window runs inside
a chunk, and one small row per (key, chunk) carries the state across chunks.

Top-k per key needs none of this: ``row_number() <= k`` is pruned by Spark's
window group limit before the shuffle, so a hot key sends k rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CHUNK = "_chunk"


def lag_in_chunks(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, values: list[str], prefix: str = "prev_",
    ahead: bool = False,
) -> DataFrame:
    """Add ``prefix + v``: the value of the previous row of the same key (the next one with ``ahead``), else null."""
    rows = df.withColumn(CHUNK, chunk)
    inside = W.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() if ahead else F.col(c).asc() for c in order])
    across = W.partitionBy(*keys).orderBy(F.col(CHUNK).desc() if ahead else F.col(CHUNK).asc())
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    rows = rows.withColumns(
        {
            "_before": F.lag(payload).over(inside),
            "_first": F.row_number().over(inside) == 1,
            "_last": F.lead(F.lit(1)).over(inside).isNull(),
        }
    )
    tails = rows.where("_last").select(*keys, CHUNK, payload.alias("_tail"))
    carry = tails.select(
        *keys, CHUNK, F.lag("_tail").over(across).alias("_carry")
    ).where(F.col("_carry").isNotNull())
    joined = rows.join(carry, [*keys, CHUNK], "left")
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_before"))
    out = joined.withColumn("_prev", before)
    return out.withColumns({prefix + v: F.col(f"_prev.{v}") for v in values}).drop(
        CHUNK, "_before", "_first", "_last", "_carry", "_prev"
    )


def running_sum_in_chunks(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, name: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per key in the given order."""
    rows = df.withColumn(CHUNK, chunk).withColumn("_value", value)
    inside = W.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, CHUNK).agg(F.sum("_value").alias("_total"))
    earlier = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, CHUNK, F.sum("_total").over(earlier).alias("_carry"))
    return (
        rows.withColumn("_inside", F.sum("_value").over(inside))
        .join(carry, [*keys, CHUNK], "left")
        .withColumn(name, F.col("_inside") + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop(CHUNK, "_value", "_inside", "_carry")
    )


def range_buckets(df: DataFrame, score: str, tie: Column) -> DataFrame:
    """Add ``_bucket`` and ``_sub`` that follow ``score asc nulls last, md5(tie) asc``.

    The bounds are as many quantiles as the session has shuffle partitions (64 at least), found in a row by halving. A
    score repeated often enough to be a bound gets a bucket of its own, and so do nulls; both are cut further by the tie hash.
    """
    buckets = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probabilities = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(df.stat.approxQuantile(score, probabilities, min(0.002, 0.1 / buckets)) or []))

    def place(low: int, high: int) -> Column:
        """2 * (bounds below the score), plus 1 when the score is a bound."""
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        at = F.lit(bounds[middle])
        return F.when(F.col(score) < at, place(low, middle)).when(F.col(score) == at, F.lit(2 * middle + 1)).otherwise(place(middle + 1, high))

    mark = F.md5(tie.cast("string"))
    bucket = F.when(F.col(score).isNull(), F.lit(2 * len(bounds) + 1)).otherwise(place(0, len(bounds)))
    return df.withColumns({"_mark": mark, "_bucket": bucket}).withColumn(
        "_sub", F.when(F.col("_bucket") % 2 == 1, F.substring(F.col("_mark"), 1, 2)).otherwise(F.lit(""))
    )


def global_rank(
    df: DataFrame, score: str, tie: Column, name: str = "rank", keys: list[str] | None = None
) -> DataFrame:
    """Exact 1-based rank by ``score desc nulls last, md5(tie)`` over the table or per key, with no one-task window.

    ``keys`` is for a few large groups (two groups, a list of settings); their offsets
    table holds one row per group and bucket.
    """
    keys = keys or []
    rows = range_buckets(df.withColumn("_neg", -F.col(score)), "_neg", tie)
    offsets = _offsets(rows, {"_n": F.lit(1)}, keys)
    inside = W.partitionBy(*keys, "_bucket", "_sub").orderBy(F.asc_nulls_last("_neg"), "_mark")
    return (
        rows.withColumn("_inner", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket", "_sub"], "left")
        .withColumn(name, F.col("_inner") + F.col("_n_before"))
        .drop("_neg", "_mark", "_bucket", "_sub", "_inner", "_n_before")
    )


def _offsets(rows: DataFrame, sums: dict[str, Column], keys: list[str]) -> DataFrame:
    """Totals of all earlier buckets of the key; rows per key that reach the window: at most 256 per bucket of a repeated score."""
    totals = rows.groupBy(*keys, "_bucket", "_sub").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("_bucket", "_sub").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *keys,
        "_bucket",
        "_sub",
        *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k in sums],
    )


def global_running_sums(
    df: DataFrame, value: str, sums: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Inclusive running sums over distinct ``value`` ascending, for the table or per (few, large) key.

    Returns one row per key and distinct value with ``sums`` and ``cum_<sum>``.
    """
    keys = keys or []
    per_value = df.groupBy(*keys, value).agg(*[F.sum(s).alias(s) for s in sums])
    rows = range_buckets(per_value.withColumn("_score", F.col(value).cast("double")), "_score", F.lit(""))
    rows = rows.withColumn("_sub", F.lit(""))
    offsets = _offsets(rows, {s: F.col(s) for s in sums}, keys)
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(offsets, [*keys, "_bucket", "_sub"], "left")
    return out.select(
        *keys,
        value,
        *sums,
        *[(F.sum(s).over(inside) + F.col(f"{s}_before")).alias(f"cum_{s}") for s in sums],
    )


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float]) -> DataFrame:
    """One row with ``edges``: the linear-interpolated quantiles of the whole column."""
    rows = df.select(F.col(value).cast("double").alias("_v"), F.lit(1).alias("_n")).where(F.col("_v").isNotNull())
    cum = global_running_sums(rows, "_v", ["_n"])
    cum = cum.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_total")))).withColumn(
        "_from", F.col("cum__n") - F.col("_n")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("cum__n")), F.col("_v")))

    ranks = [F.lit(p) * (F.col("_total") - 1) for p in probabilities]
    picks = []
    for i, r in enumerate(ranks):
        picks += [at(F.floor(r)).alias(f"lo{i}"), at(F.ceil(r)).alias(f"hi{i}"), F.max(r - F.floor(r)).alias(f"fr{i}")]
    one = cum.agg(*picks)
    return one.select(
        F.array(
            *[
                F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"fr{i}")
                for i in range(len(probabilities))
            ]
        ).alias("edges")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, name: str = "rn") -> DataFrame:
    """First ``k`` rows of each key; the group limit runs before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)
