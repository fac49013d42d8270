"""Data-quality checks; every battery is one pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(AssertionError):
    """A required check does not hold."""


def check_battery(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """(rule, failures): rows that break each rule, plus repeated values of the unique columns."""
    counts = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    parts = [df.agg(*counts).select(_pairs(list(rules)).alias("r")).select("r.rule", "r.failures")]
    for c in unique or []:
        repeats = df.groupBy(c).agg(F.count(F.lit(1)).alias("k")).agg(
            F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("failures")
        )
        parts.append(repeats.select(F.lit(f"{c} unique").alias("rule"), "failures"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pairs(names: list[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("failures")) for n in names]))


def require(checks: DataFrame) -> DataFrame:
    """The checks again, or a failed job when any rule has failures."""
    broken = F.when(F.col("failures") > 0, F.raise_error(F.concat(F.lit("check failed: "), "rule")).cast("long"))
    return checks.withColumn("failures", F.coalesce(broken, F.col("failures")))


def constant_columns(df: DataFrame, table: str) -> DataFrame:
    """Columns with a single value (nulls count as a value): minimum and maximum decide, in one pass."""
    stats = []
    for c in df.columns:
        s = F.col(c).cast("string")
        stats.append(
            F.struct(F.lit(c).alias("column"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.count_if(s.isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).alias(c)
        )
    wide = df.agg(*stats).select(F.explode(F.array(*[F.col(c) for c in df.columns])).alias("s"))
    same = ((F.col("s.nulls") == 0) & (F.col("s.lo") == F.col("s.hi"))) | (F.col("s.nulls") == F.col("s.n"))
    return wide.where(same).select(F.lit(table).alias("table_name"), F.col("s.column").alias("column_name"))


def evidence(df: DataFrame, claims: dict[str, Column]) -> DataFrame:
    """Share of rows, in percent, where each claim holds."""
    shares = [F.struct(F.lit(n).alias("claim"), (F.avg(c.cast("double")) * 100).alias("share_pct")).alias(f"c{i}") for i, (n, c) in enumerate(claims.items())]
    return df.agg(*shares).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(claims))])).alias("c")).select("c.claim", "c.share_pct")


def functional_dependency(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Does each determinant value have one dependent value? Minimum and maximum per key are enough."""
    per = df.groupBy(determinant).agg(F.min(dependent).alias("lo"), F.max(dependent).alias("hi"))
    return per.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("lo") != F.col("hi")).alias("violations"))


def matches_announced(values: DataFrame, announced: DataFrame) -> DataFrame:
    """Computed values (name, value) against announced ones (name, expected, digits), to the last digit."""
    close = F.abs(F.col("value") - F.col("expected")) <= F.pow(F.lit(10.0), -F.col("digits"))
    return announced.join(values, "name", "left").select("name", F.coalesce(close, F.lit(False)).cast("int").alias("matches"))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Number of keys found on both sides."""
    return a.select(key).join(b.select(key), key, "left_semi").agg(F.count_distinct(key).alias("shared"))


def discrepancies(manifest: DataFrame, files: DataFrame, key: str, size: str) -> DataFrame:
    """Missing, extra and wrong-sized entries of an inventory."""
    joined = manifest.select(key, F.col(size).alias("expected")).join(files.select(key, F.col(size).alias("found")), key, "full")
    kind = (
        F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra")
        .when(F.col("found") != F.col("expected"), "size mismatch")
    )
    return joined.withColumn("problem", kind).where(F.col("problem").isNotNull())


def quality_profile(items: DataFrame, keys: list[str], columns: list[str], conform: Column, inside: Column) -> DataFrame:
    """Fill rate per column, key conformity and inside-page share per source."""
    fills = [F.avg(F.col(c).isNotNull().cast("double")).alias(f"fill_{c}") for c in columns]
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *fills, F.avg(conform.cast("double")).alias("conform"), F.avg(inside.cast("double")).alias("inside")
    )
