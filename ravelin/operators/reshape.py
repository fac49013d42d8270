"""Reshaping and register tables: crosstabs, pivots, facets, histograms, registers of actions and invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.operators.ordering import running_sum_in_chunks


def crosstab(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Counts of ``a`` by the listed values of ``b`` with row and column totals."""
    cells = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    # the cube leaves one row per cell and margin
    label = F.when(F.col("_ga") == 1, "total").otherwise(F.col(a))
    pick = lambda cond, name: F.coalesce(F.max(F.when(cond, F.col("n"))), F.lit(0)).alias(name)
    return cells.groupBy(label.alias(a)).agg(
        *[pick((F.col("_gb") == 0) & (F.col(b) == v), v) for v in values], pick(F.col("_gb") == 1, "total")
    )


def melt(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value).where(F.col(value).isNotNull())


def status_counts(df: DataFrame, key: str, status: str, values: list[str], total: str = "all") -> DataFrame:
    """Counts per key and listed status, zero-filled, with a grand total row."""
    counts = [F.count_if(F.col(status) == v).alias(v) for v in values]
    return df.rollup(key).agg(*counts, F.count(F.lit(1)).alias("n")).withColumn(key, F.coalesce(F.col(key), F.lit(total)))


def scores(details: DataFrame, expected: Column, found: Column, flagged: Column, matched: Column) -> DataFrame:
    """Recall, precision and flags outside the truth; null for an empty denominator."""
    d = details.agg(
        F.count_if(expected).alias("n_expected"), F.count_if(expected & found).alias("n_found"),
        F.count_if(flagged).alias("n_flagged"), F.count_if(flagged & matched).alias("n_true"),
    )
    return d.select(
        F.round(F.try_divide("n_found", "n_expected"), 3).alias("recall"), F.round(F.try_divide("n_true", "n_flagged"), 3).alias("precision"),
        "n_expected", "n_found", "n_flagged", (F.col("n_flagged") - F.col("n_true")).alias("off_truth"),
    )


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) for every column, in one aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("n"))


def day_histogram(df: DataFrame, day: Column, groups: dict[str, Column]) -> DataFrame:
    """Counts per day and group from the first of the first month to the last day; empty days are zero, undated rows apart."""
    counts = df.groupBy(day.alias("day")).agg(*[F.count_if(c).alias(n) for n, c in groups.items()])
    span = counts.agg(F.trunc(F.min("day"), "MM").alias("lo"), F.max("day").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    dense = days.join(counts, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in groups])
    undated = counts.where(F.col("day").isNull())
    return dense.unionByName(undated)


def number_duplicates(df: DataFrame, identifier: str, order: list[str], chunk: Column, name: str) -> DataFrame:
    """Identifier with ``-n`` from its second use on."""
    numbered = running_sum_in_chunks(df, [identifier], order, chunk, F.lit(1), "_k")
    suffix = F.when(F.col("_k") > 1, F.concat(F.lit("-"), F.col("_k").cast("string"))).otherwise("")
    return numbered.withColumn(name, F.concat(identifier, suffix)).drop("_k")


def collisions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows marked with how often their key occurs; counted first, then joined back."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    return df.join(counts, keys).withColumn("collides", F.col("_k") > 1).drop("_k")


def portfolio(invoices: DataFrame, key: str, amount: str, paid: Column, disputed: Column, authorized: DataFrame) -> DataFrame:
    """Billed, paid, pending, disputed, admissible and open amounts per key."""
    amt = F.col(amount)
    pending = ~paid
    sums = invoices.groupBy(key).agg(
        F.sum(amt).alias("billed"), F.sum(F.when(paid, amt).otherwise(0.0)).alias("paid"),
        F.sum(F.when(pending, amt).otherwise(0.0)).alias("pending"),
        F.sum(F.when(pending & disputed, amt).otherwise(0.0)).alias("disputed"),
        F.bool_or(disputed).cast("int").alias("has_disputed_line"),
    )
    return sums.join(authorized, key, "left").withColumns(
        {
            "admissible": F.greatest(F.lit(0.0), F.col("pending") - F.col("disputed")),
            "open": F.greatest(F.lit(0.0), F.coalesce("authorized", F.lit(0.0)) - F.col("billed")),
        }
    )


def faceted(df: DataFrame, filters: dict[str, list], arrays: dict[str, list[str]], haystack: Column, query: str) -> DataFrame:
    """AND over facets, OR inside a facet, any value of an array facet, every search word in the haystack."""
    keep = F.lit(True)
    for c, values in filters.items():
        if values:
            keep = keep & F.col(c).isin(values)
    for c, values in arrays.items():
        if values:
            keep = keep & F.arrays_overlap(F.col(c), F.array(*[F.lit(v) for v in values]))
    for word in query.split():
        keep = keep & haystack.contains(word)
    return df.where(keep)


def version_overlay(base: DataFrame, later: DataFrame, key: str, version: int, touched: DataFrame) -> DataFrame:
    """Rows as of a version: the newest row of each key among base (0) and versions up to it, with a review flag."""
    rows = base.withColumn("version", F.lit(0)).unionByName(later.where(F.col("version") <= version))
    newest = rows.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc("version")))).where("_rn = 1").drop("_rn")
    flags = touched.where(F.col("version") <= version).select("subject").distinct().withColumn("_t", F.lit(1))
    return newest.join(flags, "subject", "left").withColumn("to_review", F.coalesce("_t", F.lit(0))).drop("_t")
