"""Panel analytics: same-unit growth, rule joins, forecasts and backtests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.operators.ordering import lag_in_chunks
from ravelin.operators.quantiles import grouped_quantile

# Fixed values of the growth rules.
DAYS_PER_YEAR = 365.25
MIN_GAP_YEARS = 0.5
MAX_GAP_YEARS = 2.5
MIN_CELL = 5
TREND_YEARS = 3
INTERNAL_WEIGHT = 0.5
NEW_BUILDING_YEARS = 5
LOOKBACK = 3
TOLERANCE = 0.02


def pair_with_previous(
    df: DataFrame, keys: list[str], start: str, tie: str, values: list[str], chunk_unit: str = "month"
) -> DataFrame:
    """Each row with the previous row of its key and the gap in years; first rows are dropped."""
    paired = lag_in_chunks(df, keys, [start, tie], F.date_trunc(chunk_unit, start), [start, *values])
    days = F.datediff(F.col(start), F.col(f"prev_{start}"))
    return paired.where(F.col(f"prev_{start}").isNotNull()).withColumns(
        {"gap_days": days, "gap_years": days / F.lit(DAYS_PER_YEAR)}
    )


def annualized_growth(current: Column, previous: Column, gap: Column) -> Column:
    """Yearly growth in percent between two values ``gap`` years apart."""
    return (F.pow(current / previous, F.lit(1.0) / gap) - 1) * 100


def gap_class(gap: Column) -> Column:
    """Both edges belong to the outer classes."""
    return F.when(gap <= MIN_GAP_YEARS, "short").when(gap >= MAX_GAP_YEARS, "long").otherwise("kept")


def same_unit_growth(pairs: DataFrame, measures: list[str]) -> DataFrame:
    """Keep pairs strictly inside the gap limits and add ``<measure>_growth``."""
    kept = pairs.where((F.col("gap_years") > MIN_GAP_YEARS) & (F.col("gap_years") < MAX_GAP_YEARS))
    return kept.withColumns(
        {
            f"{m}_growth": annualized_growth(F.col(m), F.col(f"prev_{m}"), F.col("gap_years"))
            for m in measures
        }
    )


def mask_small(df: DataFrame, count: str, columns: list[str], floor: int = MIN_CELL) -> DataFrame:
    """Null out values that rest on fewer than ``floor`` rows."""
    return df.withColumns({c: F.when(F.col(count) >= floor, F.col(c)) for c in columns})


def count_and_medians(df: DataFrame, keys: list[str], medians: dict[str, Column], n: str = "n") -> DataFrame:
    """Row count and exact medians per key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    return counts.join(grouped_quantile(df, keys, medians), keys, "left")


def attach_interval(
    child: DataFrame, parent: DataFrame, key: str, at: str, start: str, end: str, parent_id: str
) -> DataFrame:
    """Attach each child to the latest parent of its key whose [month start, end] holds the child date.

    Parents are reduced to one per (key, month, last covered day): at most 31 entries
    per key and month, whatever the number of parents. A child then meets one row per
    (key, month) and picks from that short list; an unmatched child keeps nulls.
    """
    months = F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month")))
    by_day = (
        parent.select(key, start, end, parent_id, months.alias("_month"))
        .withColumn("_until", F.least(F.to_date(end), F.last_day("_month")))
        .groupBy(key, "_month", "_until")
        .agg(F.max(F.struct(start, parent_id)).alias("_best"))
    )
    lists = by_day.groupBy(key, "_month").agg(
        F.collect_list(F.struct(F.col("_best"), F.col("_until"))).alias("_cover")
    )
    # the lists are larger than Spark estimates from the parents, so they are never sent to the driver
    joined = child.withColumn("_month", F.trunc(at, "MM")).join(lists.hint("merge"), [key, "_month"], "left")
    holding = F.filter("_cover", lambda c: c["_until"] >= F.to_date(F.col(at)))
    hit = F.array_max(F.transform(holding, lambda c: c["_best"]))
    return (
        joined.withColumn("_hit", hit)
        .withColumns({f"parent_{start}": F.col(f"_hit.{start}"), f"parent_{parent_id}": F.col(f"_hit.{parent_id}")})
        .drop("_month", "_cover", "_hit")
    )


def as_of_backward(
    left: DataFrame, right: DataFrame, by: str, left_id: str, left_on: str, right_on: str,
    right_values: list[str], tolerance: int,
) -> DataFrame:
    """Latest right row of the same key with ``0 <= left_on - right_on <= tolerance``; inclusive on whole steps.

    Right rows are first reduced to the last one per (key, step) so that a hot key
    sends at most one row per step, then each is listed under the steps it can serve.
    """
    per_step = right.groupBy(by, right_on).agg(
        F.max_by(F.struct(*right_values), F.struct(*right_values)).alias("_value")
    )
    served = per_step.withColumn(left_on, F.explode(F.sequence(right_on, F.col(right_on) + F.lit(tolerance))))
    best = served.groupBy(by, left_on).agg(
        F.max_by(F.struct(F.col(right_on), F.col("_value")), right_on).alias("_hit")
    )
    joined = left.join(best.hint("merge"), [by, left_on], "left")
    return joined.select(
        *left.columns,
        F.col(f"_hit.{right_on}").alias(right_on),
        *[F.col(f"_hit._value.{v}").alias(v) for v in right_values],
    )


def regime(province: Column, rule_province: str, age: Column, first_start: Column, exempt_after: str) -> Column:
    """Rule regime of an entity from its province, age and first start date."""
    rule = F.when(first_start > F.lit(exempt_after).cast("timestamp_ntz"), "exempt").otherwise("guideline")
    return F.when(province == rule_province, rule).otherwise(
        F.when(age > NEW_BUILDING_YEARS, "reference_rate").otherwise("new_building")
    )


def freq_size(df: DataFrame, keys: list[str], prev_flag: str, flag: str, prev_size: Column, size: Column) -> DataFrame:
    """Split the change of (share x mean size) into a frequency and a size part with midpoint weights."""
    stats = df.groupBy(*keys).agg(
        F.avg(F.col(prev_flag).cast("double")).alias("share_prev"),
        F.avg(F.col(flag).cast("double")).alias("share_new"),
        F.avg(F.when(F.col(prev_flag), prev_size)).alias("size_prev"),
        F.avg(F.when(F.col(flag), size)).alias("size_new"),
    )
    sp, sn, zp, zn = (F.col(c) for c in ("share_prev", "share_new", "size_prev", "size_new"))
    return stats.withColumns(
        {
            "total": sn * zn - sp * zp,
            "frequency": (sn - sp) * (zn + zp) / 2,
            "size": (zn - zp) * (sn + sp) / 2,
        }
    )


def formula_match(
    rows: DataFrame, stored: Column, full: Column, part: Column, has_filler: Column, tolerance: float = TOLERANCE
) -> DataFrame:
    """Share of rows where a formula gives the stored value, for all rows and split by filler rows."""

    def case(name: str, keep: Column, formula: Column) -> Column:
        return F.struct(
            F.lit(name).alias("grp"), keep.alias("keep"), (F.abs(formula - stored) < tolerance).alias("ok")
        )

    cases = F.explode(
        F.array(
            case("all", F.lit(True), full),
            case("without filler", ~has_filler, full),
            case("with filler, full", has_filler, full),
            case("with filler, part", has_filler, part),
        )
    ).alias("c")
    return rows.select(cases).where("c.keep").groupBy(F.col("c.grp").alias("grp")).agg(
        F.count(F.lit(1)).alias("leases"), (F.avg(F.col("c.ok").cast("double")) * 100).alias("match_pct")
    )


def weighted_growth(growth: Column, weight: Column) -> Column:
    """Growth in percent of a weighted total, as one aggregate expression."""
    return (F.sum(weight * (1 + growth / 100)) / F.sum(weight) - 1) * 100


def annual_change(df: DataFrame, keys: list[str], months_needed: int = 12) -> DataFrame:
    """Mean of the monthly values per year, incomplete years dropped, change against the row before.

    Expects ``year`` and ``value`` with one row per month; what reaches the window is one row per key and year.
    """
    annual = (
        df.groupBy(*keys, "year")
        .agg(F.avg("value").alias("index_mean"), F.count(F.lit(1)).alias("months"))
        .where(F.col("months") == months_needed)
    )
    before = F.lag("index_mean").over(W.partitionBy(*keys).orderBy("year"))
    return annual.withColumn("change_pct", (F.col("index_mean") / before - 1) * 100)


def forecast_rows(
    pairs: DataFrame, regimes: DataFrame, rules: DataFrame, index_rent: DataFrame, segment: list[str],
    internal_weight: float = INTERNAL_WEIGHT,
) -> DataFrame:
    """Every target year at once: pairs of the year before, shifted towards their anchor.

    ``pairs`` holds year, key, province, is_renewal, contract_growth, effective_growth.
    The anchor is the rule of the target year for a renewal under a rule, else the index
    change of the year before. The row is revised by (1 - w) x (anchor - segment median).
    """
    base = pairs.withColumn("target_year", F.col("year") + 1)
    by_segment = ["target_year", *segment]
    medians = grouped_quantile(base, by_segment, {"segment_contract": F.col("contract_growth")})
    anchored = (
        base.join(medians, by_segment, "left")
        .join(regimes, ["key", "target_year"], "left")
        .join(F.broadcast(rules), ["regime", "target_year"], "left")
        .join(F.broadcast(index_rent), ["province", "target_year"], "left")
    )
    uses_rule = F.col("is_renewal") & F.col("rule_pct").isNotNull()
    anchor = F.when(uses_rule, F.col("rule_pct")).otherwise(F.col("index_pct"))
    source = F.when(uses_rule, F.concat(F.lit("rule "), F.col("target_year").cast("string"))).otherwise(
        F.concat(F.lit("index "), F.col("province"), F.lit(" "), F.col("year").cast("string"))
    )
    revision = F.lit(1.0 - internal_weight) * (F.col("anchor_pct") - F.col("segment_contract"))
    return (
        anchored.withColumn("anchor_pct", anchor)
        .withColumn("anchor_source", source)
        .withColumn("revision", revision)
        .withColumn("forecast_contract", F.col("contract_growth") + F.col("revision"))
        .withColumn("forecast_effective", F.col("effective_growth") + F.col("revision"))
    )


def yearly_median(pairs: DataFrame, value: str, name: str) -> DataFrame:
    """Median per year: at most one row per year from here on."""
    return grouped_quantile(pairs, ["year"], {name: F.col(value)})


def internal_trend(pairs: DataFrame, years: int = TREND_YEARS) -> DataFrame:
    """Mean of the yearly medians of the ``years`` years before each target year."""
    medians = yearly_median(pairs, "effective_growth", "med")
    targets = medians.select(F.explode(F.sequence(F.lit(1), F.lit(years))).alias("k"), "year", "med")
    return (
        targets.withColumn("target_year", F.col("year") + F.col("k"))
        .groupBy("target_year")
        .agg(F.avg("med").alias("predicted"))
    )


Method = Callable[[dict[str, DataFrame]], DataFrame]


def _combined(context: dict[str, DataFrame], weight: float) -> DataFrame:
    rows = forecast_rows(
        context["pairs"], context["regimes"], context["rules"], context["index"], ["province", "is_renewal"], weight
    )
    return grouped_quantile(rows, ["target_year"], {"predicted": F.col("forecast_effective")})


def _persistence(context: dict[str, DataFrame]) -> DataFrame:
    medians = yearly_median(context["pairs"], "effective_growth", "predicted")
    return medians.select((F.col("year") + 1).alias("target_year"), "predicted")


# name -> function of the shared inputs, giving (target_year, predicted)
FORECAST_METHODS: dict[str, Method] = {
    "combination": lambda context: _combined(context, INTERNAL_WEIGHT),
    "persistence": _persistence,
    "internal_trend": lambda context: internal_trend(context["pairs"]),
    "external_anchor": lambda context: _combined(context, 0.0),
}


def run_methods(context: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """All registered methods for all target years in one plan: (method, target_year, predicted)."""
    parts = [
        FORECAST_METHODS[n](context).select(F.lit(n).alias("method"), "target_year", "predicted")
        for n in (names or list(FORECAST_METHODS))
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def backtest(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Predicted beside observed for the years that have pairs."""
    actual = yearly_median(pairs, "effective_growth", "actual").withColumnRenamed("year", "target_year")
    return predictions.join(actual, "target_year").withColumn("error", F.col("predicted") - F.col("actual"))


def mae(results: DataFrame, recent: list[int]) -> DataFrame:
    """Mean absolute error per method over all years and over ``recent``, with average-tie ranks.

    The input is one row per method and year, so the unpartitioned window is bounded.
    """
    err = F.abs(F.col("error"))
    table = results.groupBy("method").agg(
        F.avg(F.when(F.col("target_year").isin(recent), err)).alias("mae_recent"), F.avg(err).alias("mae_all")
    )

    def average_rank(c: str) -> Column:
        peers = F.count(F.lit(1)).over(W.partitionBy(c))
        return F.rank().over(W.orderBy(c)) + (peers - 1) / 2

    return table.withColumns({"rank_recent": average_rank("mae_recent"), "rank_all": average_rank("mae_all")})
