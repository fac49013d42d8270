"""Panel queries: growth of the same unit, rule joins, forecasts and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.operators import panel
from ravelin.operators.ordering import running_sum_in_chunks, top_per_key
from ravelin.operators.quantiles import grouped_quantile
from ravelin.plans import fragments as fr
from ravelin.plans.registry import query
from ravelin.sources.tables import Tables

DAY = "yyyy-MM-dd"


@query(
    "win01_previous_row_pairs",
    f"""WITH {fr.ALL_PAIRS_SQL}
    SELECT o_orderkey, o_custkey, strftime(prev_start, '%Y-%m-%d') AS prev_start, prev_contract,
           round(gap_years, 6) AS gap_years FROM all_pairs""",
)
def previous_row_pairs(t: Tables) -> DataFrame:
    return fr.all_pairs(t).select(
        "o_orderkey", "o_custkey", F.date_format("prev_o_orderdate", DAY).alias("prev_start"),
        "prev_contract", F.round("gap_years", 6).alias("gap_years"),
    )


@query(
    "win02_same_unit_growth",
    f"""WITH {fr.PAIRS_SQL}, g AS (
      SELECT year, count(*) AS pairs, count(DISTINCT o_custkey) AS units, median(contract_growth) AS c,
             median(effective_growth) AS e FROM pairs GROUP BY year)
    SELECT year, pairs, units, CASE WHEN pairs >= 5 THEN round(c, 4) END AS contract_pct,
           CASE WHEN pairs >= 5 THEN round(e, 4) END AS effective_pct FROM g""",
)
def same_unit_growth(t: Tables) -> DataFrame:
    rows = fr.pairs(t)
    units = rows.groupBy("year").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("o_custkey").alias("units")
    )
    medians = grouped_quantile(
        rows, ["year"], {"contract_pct": F.col("contract_growth"), "effective_pct": F.col("effective_growth")}
    )
    table = panel.mask_small(units.join(medians, "year", "left"), "pairs", ["contract_pct", "effective_pct"])
    return table.withColumns({c: F.round(c, 4) for c in ("contract_pct", "effective_pct")})


RANK_TIES = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


@query(
    "win03_rank_against_stored_rank",
    f"""WITH r AS (SELECT l_linenumber, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY {", ".join(RANK_TIES)}) AS rn FROM lineitem)
    SELECT count(*) AS n, sum(CASE WHEN rn = l_linenumber THEN 1 ELSE 0 END)::BIGINT AS agree,
           round(avg(CASE WHEN rn = l_linenumber THEN 1.0 ELSE 0.0 END), 6) AS share FROM r""",
)
def rank_check(t: Tables) -> DataFrame:
    ranked = running_sum_in_chunks(
        t.lineitem.select("l_orderkey", *RANK_TIES), ["l_orderkey"], RANK_TIES,
        F.date_trunc("month", "l_shipdate"), F.lit(1), "rn",
    )
    agree = F.col("rn") == F.col("l_linenumber")
    return ranked.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(agree).alias("agree"),
        F.round(F.avg(agree.cast("double")), 6).alias("share"),
    )


@query(
    "win04_latest_row_per_key",
    """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
      FROM orders) WHERE rn = 1""",
)
def latest_row(t: Tables) -> DataFrame:
    latest = top_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return latest.select(
        "o_custkey", "o_orderkey", F.date_format("o_orderdate", DAY).alias("day"), "o_totalprice"
    )


@query(
    "win05_percent_change_per_series",
    """WITH y AS (SELECT o_orderstatus, year(o_orderdate) AS year, sum(o_totalprice) AS total
      FROM orders GROUP BY ALL)
    SELECT o_orderstatus, year, round(total, 2) AS total, round((total / lag(total) OVER
      (PARTITION BY o_orderstatus ORDER BY year) - 1) * 100, 6) AS change_pct FROM y""",
)
def percent_change(t: Tables) -> DataFrame:
    # one row per series and year reaches the window
    yearly = t.orders.groupBy("o_orderstatus", F.year("o_orderdate").cast("long").alias("year")).agg(
        F.sum("o_totalprice").alias("total")
    )
    before = F.lag("total").over(W.partitionBy("o_orderstatus").orderBy("year"))
    return yearly.withColumn("change_pct", F.round((F.col("total") / before - 1) * 100, 6)).withColumn(
        "total", F.round("total", 2)
    )


@query(
    "win06_group_median_on_rows",
    """SELECT o_orderkey, round(o_totalprice - median(o_totalprice) OVER (PARTITION BY o_orderstatus,
      year(o_orderdate)), 4) AS above_median FROM orders""",
)
def group_median_on_rows(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"))
    medians = grouped_quantile(rows, ["o_orderstatus", "year"], {"med": F.col("o_totalprice")})
    return rows.join(medians, ["o_orderstatus", "year"]).select(
        "o_orderkey", F.round(F.col("o_totalprice") - F.col("med"), 4).alias("above_median")
    )


@query(
    "win07_trailing_mean_of_yearly_medians",
    """WITH y AS (SELECT year(o_orderdate) AS year, median(o_totalprice) AS med FROM orders GROUP BY 1)
    SELECT year, round(med, 4) AS med, round(avg(med) OVER (ORDER BY year RANGE BETWEEN 3 PRECEDING
      AND 1 PRECEDING), 4) AS trailing FROM y""",
)
def trailing_mean(t: Tables) -> DataFrame:
    rows = t.orders.select("o_totalprice", F.year("o_orderdate").cast("long").alias("year"))
    yearly = grouped_quantile(rows, ["year"], {"med": F.col("o_totalprice")})
    # one row per year: a bounded window
    trailing = F.avg("med").over(W.orderBy("year").rangeBetween(-panel.TREND_YEARS, -1))
    return yearly.select("year", F.round("med", 4).alias("med"), F.round(trailing, 4).alias("trailing"))


@query(
    "prj04_gap_classes",
    f"""WITH {fr.ALL_PAIRS_SQL}, k AS (SELECT CASE WHEN gap_years <= 0.5 THEN 'short'
      WHEN gap_years >= 2.5 THEN 'long' ELSE 'kept' END AS gap_class, gap_days FROM all_pairs)
    SELECT gap_class, count(*) AS pairs, round(median(gap_days), 4) AS median_gap_days FROM k GROUP BY 1""",
)
def gap_classes(t: Tables) -> DataFrame:
    rows = fr.all_pairs(t).withColumn("gap_class", panel.gap_class(F.col("gap_years")))
    out = panel.count_and_medians(rows, ["gap_class"], {"median_gap_days": F.col("gap_days")}, "pairs")
    return out.withColumn("median_gap_days", F.round("median_gap_days", 4))


@query(
    "joi01_interval_attach",
    """WITH child AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, o_custkey
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    hits AS (SELECT c.*, p.o_orderdate AS start, p.o_orderkey AS parent FROM child c LEFT JOIN orders p
      ON p.o_custkey = c.o_custkey AND date_trunc('month', p.o_orderdate) <= c.l_shipdate
      AND c.l_shipdate <= p.o_orderdate + INTERVAL 364 DAY),
    best AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
      l_extendedprice, l_shipdate ORDER BY start DESC, parent DESC) AS rn FROM hits)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, parent AS parent_orderkey
    FROM best WHERE rn = 1""",
)
def interval_attach(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    child = t.lineitem.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    parent = orders.withColumn("o_end", F.date_add("o_orderdate", 364))
    linked = panel.attach_interval(
        child.drop("o_orderkey"), parent, "o_custkey", "l_shipdate", "o_orderdate", "o_end", "o_orderkey"
    )
    return linked.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.col("parent_o_orderkey").alias("parent_orderkey"),
    )


@query(
    "joi02_as_of_backward",
    """WITH v AS (SELECT user_id, event_id AS view_id, ts, value AS view_value, datediff('day', DATE '2024-01-01', ts::DATE) AS vday
      FROM events WHERE event_type = 'view'),
    p AS (SELECT user_id, event_id, value, datediff('day', DATE '2024-01-01', ts::DATE) AS day FROM events WHERE event_type = 'purchase'),
    j AS (SELECT p.event_id, p.value, v.view_id, v.view_value, p.day - v.vday AS age,
      row_number() OVER (PARTITION BY p.event_id ORDER BY v.vday DESC NULLS LAST, v.ts DESC, v.view_id DESC) AS rn
      FROM p LEFT JOIN v ON v.user_id = p.user_id AND p.day - v.vday BETWEEN 0 AND 3)
    SELECT event_id, value, view_id, view_value, age FROM j WHERE rn = 1""",
)
def as_of(t: Tables) -> DataFrame:
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    views = t.events.where("event_type = 'view'").select(
        "user_id", day.alias("vday"), "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value")
    )
    buys = t.events.where("event_type = 'purchase'").select("user_id", "event_id", "value", day.alias("day"))
    hits = panel.as_of_backward(
        buys, views, "user_id", "event_id", "day", "vday", ["ts", "view_id", "view_value"], panel.LOOKBACK
    )
    return hits.select("event_id", "value", "view_id", "view_value", (F.col("day") - F.col("vday")).alias("age"))


@query(
    "joi03_reconcile_with_rules",
    f"""WITH {fr.PAIRS_SQL}, {fr.INDEX_SQL}, rules AS (SELECT * FROM {fr.rule_values_sql()}),
    g AS (SELECT year, province, count(*) AS pairs, median(contract_growth) AS c, median(effective_growth) AS e
          FROM pairs GROUP BY ALL),
    both_rules AS (SELECT coalesce(a.target_year, b.target_year) AS year, a.rule_pct AS reference_pct,
      b.rule_pct AS guideline_pct FROM (SELECT * FROM rules WHERE regime = 'reference_rate') a
      FULL JOIN (SELECT * FROM rules WHERE regime = 'guideline') b ON a.target_year = b.target_year)
    SELECT g.year, g.province, pairs, CASE WHEN pairs >= 5 THEN round(c, 4) END AS contract_pct,
      CASE WHEN pairs >= 5 THEN round(e, 4) END AS effective_pct, round(index_pct, 6) AS index_pct,
      CASE WHEN g.province = '{fr.GUIDELINE_PROVINCE}' THEN guideline_pct ELSE reference_pct END AS rule_pct
    FROM g LEFT JOIN index_rent i ON i.province = g.province AND i.target_year = g.year
    LEFT JOIN both_rules r ON r.year = g.year""",
)
def reconcile_with_rules(t: Tables) -> DataFrame:
    facts = panel.count_and_medians(
        fr.pairs(t), ["year", "province"],
        {"contract_pct": F.col("contract_growth"), "effective_pct": F.col("effective_growth")}, "pairs",
    )
    rules = fr.rules(t)
    reference = rules.where("regime = 'reference_rate'").select("target_year", F.col("rule_pct").alias("reference_pct"))
    guideline = rules.where("regime = 'guideline'").select("target_year", F.col("rule_pct").alias("guideline_pct"))
    both = reference.join(guideline, "target_year", "full").withColumnRenamed("target_year", "year")
    index = fr.index_rent(t).withColumnRenamed("target_year", "year")
    joined = facts.join(F.broadcast(index), ["year", "province"], "left").join(F.broadcast(both), "year", "left")
    rule = F.when(F.col("province") == fr.GUIDELINE_PROVINCE, F.col("guideline_pct")).otherwise(F.col("reference_pct"))
    masked = panel.mask_small(joined.withColumn("rule_pct", rule), "pairs", ["contract_pct", "effective_pct"])
    return masked.select(
        "year", "province", "pairs", F.round("contract_pct", 4).alias("contract_pct"),
        F.round("effective_pct", 4).alias("effective_pct"), F.round("index_pct", 6).alias("index_pct"), "rule_pct",
    )


@query(
    "joi04_dictionary_lookup",
    """SELECT c_custkey, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""",
)
def dictionary_lookup(t: Tables) -> DataFrame:
    return fr.customers_with_region(t).select(
        "c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )


@query(
    "joi05_rule_or_fallback_anchor",
    f"""WITH {fr.PAIRS_SQL}, {fr.REGIMES_SQL}, {fr.INDEX_SQL}, {fr.forecast_sql()}
    SELECT o_orderkey, target_year, round(anchor_pct, 6) AS anchor_pct, anchor_source FROM forecast""",
)
def rule_or_fallback(t: Tables) -> DataFrame:
    c = fr.forecast_context(t)
    rows = panel.forecast_rows(c["pairs"], c["regimes"], c["rules"], c["index"], ["province", "is_renewal"])
    return rows.select("o_orderkey", "target_year", F.round("anchor_pct", 6).alias("anchor_pct"), "anchor_source")


@query(
    "agg01_grouped_summary_fixed_order",
    """WITH o AS (SELECT * FROM (VALUES (0, 'URGENT'), (1, 'HIGH'), (2, 'MEDIUM'), (3, 'NOT SPECIFIED'), (4, 'LOW'),
      (5, 'NONE')) v(pos, priority)),
    s AS (SELECT substr(o_orderpriority, 3) AS priority, count(*) AS n, avg(o_totalprice) AS mean_price,
      median(o_totalprice) AS median_price, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1)
    SELECT pos, priority, coalesce(n, 0) AS n, round(mean_price, 4) AS mean_price,
      round(median_price, 4) AS median_price, coalesce(customers, 0) AS customers FROM o LEFT JOIN s USING (priority)""",
)
def grouped_summary(t: Tables) -> DataFrame:
    order = ["URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW", "NONE"]
    rows = t.orders.withColumn("priority", F.substring("o_orderpriority", 3, 100))
    stats = rows.groupBy("priority").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"),
        F.count_distinct("o_custkey").alias("customers"),
    )
    medians = grouped_quantile(rows, ["priority"], {"median_price": F.col("o_totalprice")})
    fixed = t.spark.createDataFrame(list(enumerate(order)), "pos int, priority string")
    return fixed.join(stats.join(medians, "priority"), "priority", "left").select(
        "pos", "priority", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean_price", 4).alias("mean_price"),
        F.round("median_price", 4).alias("median_price"), F.coalesce("customers", F.lit(0)).alias("customers"),
    )


@query(
    "agg05_small_cell_mask",
    """WITH g AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN n >= 5 THEN n END AS n, CASE WHEN n >= 5 THEN round(m, 6) END AS mean_price FROM g""",
)
def small_cells(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price"))
    # the count itself is masked last, after it has served as the test
    masked = panel.mask_small(panel.mask_small(g, "n", ["mean_price"]), "n", ["n"])
    return masked.withColumn("mean_price", F.round("mean_price", 6))


@query(
    "agg06_weighted_growth",
    f"""WITH {fr.PAIRS_SQL}
    SELECT year, round((sum(prev_effective * (1 + effective_growth / 100)) / sum(prev_effective) - 1) * 100, 4)
      AS weighted_pct FROM pairs GROUP BY year""",
)
def weighted_growth(t: Tables) -> DataFrame:
    growth = panel.weighted_growth(F.col("effective_growth"), F.col("prev_effective"))
    return fr.pairs(t).groupBy("year").agg(F.round(growth, 4).alias("weighted_pct"))


@query(
    "agg07_frequency_size_split",
    f"""WITH {fr.PAIRS_SQL}, s AS (SELECT year, avg(prev_conceded::INT) AS sp, avg(conceded::INT) AS sn,
      avg(CASE WHEN prev_conceded THEN prev_discount * 100 END) AS zp,
      avg(CASE WHEN conceded THEN discount * 100 END) AS zn FROM pairs GROUP BY year)
    SELECT year, round(sn * zn - sp * zp, 6) AS total, round((sn - sp) * (zn + zp) / 2, 6) AS frequency,
      round((zn - zp) * (sn + sp) / 2, 6) AS size FROM s""",
)
def frequency_size(t: Tables) -> DataFrame:
    split = panel.freq_size(
        fr.pairs(t), ["year"], "prev_conceded", "conceded", F.col("prev_discount") * 100, F.col("discount") * 100
    )
    return split.select("year", *[F.round(c, 6).alias(c) for c in ("total", "frequency", "size")])


@query(
    "agg17_annual_index_change",
    f"""WITH {fr.LEASES_SQL}, {fr.INDEX_SQL}
    SELECT province, target_year - 1 AS year, round(index_pct, 6) AS change_pct FROM index_rent""",
)
def annual_index(t: Tables) -> DataFrame:
    monthly = fr.leases(t).groupBy("province", "year", F.month("o_orderdate").alias("month")).agg(
        F.sum("contract").alias("value")
    )
    return panel.annual_change(monthly, ["province"]).select(
        "province", "year", F.round("change_pct", 6).alias("change_pct")
    )


METHODS_SQL = f"""WITH {fr.PAIRS_SQL}, {fr.REGIMES_SQL}, {fr.INDEX_SQL}, {fr.forecast_sql()}, {fr.forecast_sql(0, "0")},
ymed AS (SELECT year, median(effective_growth) AS med FROM pairs GROUP BY year),
predicted AS (
  SELECT 'combination' AS method, target_year, median(forecast_effective) AS predicted FROM forecast
    WHERE forecast_effective IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'external_anchor', target_year, median(forecast_effective) FROM forecast0
    WHERE forecast_effective IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'persistence', year + 1, med FROM ymed
  UNION ALL SELECT 'internal_trend', t.y, avg(med) FROM ymed JOIN
    (SELECT DISTINCT year + k AS y FROM ymed, (SELECT unnest([1, 2, 3]) AS k)) t ON ymed.year BETWEEN t.y - 3 AND t.y - 1
    GROUP BY ALL),
results AS (SELECT method, target_year, predicted, med AS actual, predicted - med AS error
  FROM predicted JOIN ymed ON ymed.year = target_year)"""


def _results(t: Tables) -> DataFrame:
    context = fr.forecast_context(t)
    return panel.backtest(panel.run_methods(context), context["pairs"])


@query(
    "ml13_walk_forward_backtest",
    METHODS_SQL + """ SELECT method, target_year, round(predicted, 4) AS predicted, round(actual, 4) AS actual,
    round(error, 4) AS error FROM results""",
)
def walk_forward(t: Tables) -> DataFrame:
    return _results(t).select(
        "method", "target_year", *[F.round(c, 4).alias(c) for c in ("predicted", "actual", "error")]
    )


@query("udf02_forecast_method_registry",
       METHODS_SQL + " SELECT method, target_year, round(predicted, 4) AS predicted FROM predicted")
def method_registry(t: Tables) -> DataFrame:
    return panel.run_methods(fr.forecast_context(t)).withColumn("predicted", F.round("predicted", 4))


@query(
    "agg34_mae_per_method_with_rank",
    METHODS_SQL + """, m AS (SELECT method, avg(abs(error)) FILTER (target_year IN (1999, 2000, 2001)) AS mae_recent,
      avg(abs(error)) AS mae_all FROM results GROUP BY method)
    SELECT method, round(mae_recent, 4) AS mae_recent, round(mae_all, 4) AS mae_all,
      (rank() OVER (ORDER BY mae_recent) + (count(*) OVER (PARTITION BY mae_recent) - 1) / 2.0)::DOUBLE AS rank_recent,
      (rank() OVER (ORDER BY mae_all) + (count(*) OVER (PARTITION BY mae_all) - 1) / 2.0)::DOUBLE AS rank_all FROM m""",
)
def mae_per_method(t: Tables) -> DataFrame:
    table = panel.mae(_results(t), [1999, 2000, 2001])
    return table.withColumns({c: F.round(c, 4) for c in ("mae_recent", "mae_all")})


@query(
    "ml14_combined_forecast_by_segment",
    f"""WITH {fr.PAIRS_SQL}, {fr.REGIMES_SQL}, {fr.INDEX_SQL}, {fr.forecast_sql()}
    SELECT target_year, province, is_renewal::INT AS is_renewal, count(*) AS pairs,
      round(median(contract_growth), 4) AS internal_contract, round(median(forecast_contract), 4) AS forecast_contract,
      round(median(forecast_effective), 4) AS central FROM forecast GROUP BY ALL""",
)
def combined_by_segment(t: Tables) -> DataFrame:
    c = fr.forecast_context(t)
    rows = panel.forecast_rows(c["pairs"], c["regimes"], c["rules"], c["index"], ["province", "is_renewal"])
    by = ["target_year", "province", "is_renewal"]
    out = panel.count_and_medians(
        rows, by,
        {"internal_contract": F.col("contract_growth"), "forecast_contract": F.col("forecast_contract"),
         "central": F.col("forecast_effective")}, "pairs",
    )
    return out.select(
        "target_year", "province", F.col("is_renewal").cast("int").alias("is_renewal"), "pairs",
        *[F.round(c, 4).alias(c) for c in ("internal_contract", "forecast_contract", "central")],
    )


@query(
    "ml16_scenario_band_and_fallback",
    METHODS_SQL + """, m AS (SELECT avg(abs(error)) AS mae FROM results WHERE method = 'combination'),
    band AS (SELECT target_year, min(predicted) - (SELECT mae FROM m) AS low, max(predicted) + (SELECT mae FROM m) AS high,
      max(CASE WHEN method = 'combination' THEN predicted END) AS central FROM predicted GROUP BY 1),
    own AS (SELECT target_year, n_name, count(*) AS pairs, median(forecast_effective) AS own FROM forecast
      JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
    SELECT b.target_year, n.n_name, coalesce(pairs, 0) AS pairs, round(low, 4) AS low, round(high, 4) AS high,
      round(CASE WHEN coalesce(pairs, 0) = 0 THEN central WHEN pairs >= 5 THEN own END, 4) AS forecast
    FROM band b CROSS JOIN nation n LEFT JOIN own o ON o.target_year = b.target_year AND o.n_name = n.n_name
    WHERE b.central IS NOT NULL""",
)
def scenario_band(t: Tables) -> DataFrame:
    context = fr.forecast_context(t)
    predicted = panel.run_methods(context)
    error = panel.backtest(predicted, context["pairs"]).where("method = 'combination'").agg(
        F.avg(F.abs("error")).alias("mae")
    )
    chosen = F.max(F.when(F.col("method") == "combination", F.col("predicted")))
    band = predicted.groupBy("target_year").agg(
        F.min("predicted").alias("lo"), F.max("predicted").alias("hi"), chosen.alias("central")
    ).where(F.col("central").isNotNull())
    rows = panel.forecast_rows(
        context["pairs"], context["regimes"], context["rules"], context["index"], ["province", "is_renewal"]
    )
    nations = fr.customers_with_region(t).select(F.col("c_custkey").alias("key"), "n_name")
    own = panel.count_and_medians(
        rows.join(nations, "key"), ["target_year", "n_name"], {"own": F.col("forecast_effective")}, "pairs"
    )
    # years x nations: a fixed small grid; error is one row
    names = t.nation.agg(F.collect_list("n_name").alias("names"))
    grid = band.join(F.broadcast(error)).join(F.broadcast(names)).withColumn("n_name", F.explode("names"))
    pairs = F.coalesce("pairs", F.lit(0))
    value = F.when(pairs == 0, F.col("central")).when(pairs >= panel.MIN_CELL, F.col("own"))
    return grid.join(own, ["target_year", "n_name"], "left").select(
        "target_year", "n_name", pairs.alias("pairs"), F.round(F.col("lo") - F.col("mae"), 4).alias("low"),
        F.round(F.col("hi") + F.col("mae"), 4).alias("high"), F.round(value, 4).alias("forecast"),
    )


@query(
    "ml17_regime_classification",
    f"WITH {fr.LEASES_SQL}, {fr.REGIMES_SQL} SELECT key, target_year, regime FROM regimes",
)
def regime_classes(t: Tables) -> DataFrame:
    return fr.regimes(t).select("key", "target_year", "regime")


@query(
    "agg35_entity_facts",
    f"""WITH {fr.PAIRS_SQL}, l AS (SELECT n_name, o_custkey, year, o_orderdate, o_orderkey, is_renewal FROM leases
      JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    last AS (SELECT n_name, o_custkey, max(o_orderdate) AS last_start FROM l GROUP BY ALL),
    a AS (SELECT n_name, min(year) AS first_year, count(DISTINCT o_custkey) AS units FROM l GROUP BY 1),
    b AS (SELECT n_name, count(*) FILTER (last_start + INTERVAL 364 DAY < TIMESTAMP '2001-08-01') AS ended FROM last GROUP BY 1),
    r AS (SELECT n_name, count(*) AS renewals, avg(CASE WHEN contract_growth > 2.5 THEN 1.0 ELSE 0.0 END) AS above
      FROM pairs JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE is_renewal GROUP BY 1)
    SELECT a.n_name, first_year, units, CASE WHEN ended >= 5 THEN ended END AS ended,
      CASE WHEN ended >= 5 THEN round(ended / units * 100, 4) END AS share_ended, coalesce(renewals, 0) AS renewals,
      CASE WHEN renewals >= 5 THEN round(above * 100, 4) END AS above_benchmark
    FROM a JOIN b USING (n_name) LEFT JOIN r USING (n_name)""",
)
def entity_facts(t: Tables) -> DataFrame:
    names = fr.customers_with_region(t).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    rows = fr.leases(t)
    # one partial row per customer first, so that a large nation is not one group of raw rows
    per_unit = rows.groupBy("o_custkey").agg(F.min("year").alias("first"), F.max("o_orderdate").alias("last_start"))
    over = F.date_add("last_start", 364) < F.lit("2001-08-01").cast("date")
    facts = per_unit.join(names, "o_custkey").groupBy("n_name").agg(
        F.min("first").alias("first_year"), F.count(F.lit(1)).alias("units"), F.count_if(over).alias("ended")
    )
    renewals = fr.pairs(t).where("is_renewal").join(names, "o_custkey").groupBy("n_name").agg(
        F.count(F.lit(1)).alias("renewals"), F.avg((F.col("contract_growth") > 2.5).cast("double") * 100).alias("above")
    )
    joined = facts.join(renewals, "n_name", "left").withColumn(
        "share_ended", F.round(F.col("ended") / F.col("units") * 100, 4)
    )
    masked = panel.mask_small(panel.mask_small(joined, "ended", ["share_ended"]), "ended", ["ended"])
    return masked.select(
        "n_name", "first_year", "units", "ended", "share_ended", F.coalesce("renewals", F.lit(0)).alias("renewals"),
        F.when(F.col("renewals") >= panel.MIN_CELL, F.round("above", 4)).alias("above_benchmark"),
    )


@query(
    "dq04_formula_reconciliation",
    """WITH l AS (SELECT l_orderkey, round(avg(l_discount), 6) AS d, sum(l_discount) AS ds, count(*) AS n,
      sum(CASE WHEN l_discount > 0 THEN 1 ELSE 0 END) AS n2, max(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS filler
      FROM lineitem GROUP BY 1),
    f AS (SELECT filler, o_totalprice * (1 - d) AS effective, o_totalprice - o_totalprice * ds / n AS formula,
      o_totalprice - CASE WHEN n2 > 0 THEN o_totalprice * ds / n2 ELSE 0 END AS part FROM l JOIN orders ON o_orderkey = l_orderkey),
    c AS (SELECT filler, abs(formula - effective) < 1 AS full_ok, abs(part - effective) < 1 AS part_ok FROM f)
    SELECT 'all' AS grp, count(*) AS leases, round(avg(full_ok::INT) * 100, 4) AS match_pct FROM c
    UNION ALL SELECT 'without filler', count(*), round(avg(full_ok::INT) * 100, 4) FROM c WHERE filler = 0
    UNION ALL SELECT 'with filler, full', count(*), round(avg(full_ok::INT) * 100, 4) FROM c WHERE filler = 1
    UNION ALL SELECT 'with filler, part', count(*), round(avg(part_ok::INT) * 100, 4) FROM c WHERE filler = 1""",
)
def formula_reconciliation(t: Tables) -> DataFrame:
    """Stored effective price against the formula over its lines, with and without the filler lines (no discount)."""
    per = t.lineitem.groupBy("l_orderkey").agg(
        F.round(F.avg("l_discount"), 6).alias("d"), F.sum("l_discount").alias("ds"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_discount") > 0).alias("n2"), F.max((F.col("l_discount") == 0).cast("int")).alias("filler"),
    )
    price = F.col("o_totalprice")
    rows = per.join(t.orders.select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    return panel.formula_match(
        rows, stored=price * (1 - F.col("d")), full=price - price * F.col("ds") / F.col("n"),
        part=price - F.when(F.col("n2") > 0, price * F.try_divide("ds", "n2")).otherwise(0.0),
        has_filler=F.col("filler") == 1, tolerance=1.0,
    ).withColumn("match_pct", F.round("match_pct", 4))


@query(
    "dq08_code_profile",
    """WITH a AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1),
    b AS (SELECT l_returnflag, median(l_quantity) AS months, median(l_discount / (1 + l_tax)) AS share FROM lineitem
      WHERE l_tax > 0 GROUP BY 1)
    SELECT l_returnflag, n, rank() OVER (ORDER BY n DESC) AS position, round(months, 4) AS median_months,
      round(share, 6) AS median_share FROM a LEFT JOIN b USING (l_returnflag)""",
)
def code_profile(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    medians = grouped_quantile(
        t.lineitem.where("l_tax > 0"), ["l_returnflag"],
        {"median_months": F.col("l_quantity"), "median_share": F.col("l_discount") / (1 + F.col("l_tax"))},
    )
    # one row per code
    position = F.rank().over(W.orderBy(F.desc("n")))
    return counts.join(medians, "l_returnflag", "left").select(
        "l_returnflag", "n", position.alias("position"), F.round("median_months", 4).alias("median_months"),
        F.round("median_share", 6).alias("median_share"),
    )
