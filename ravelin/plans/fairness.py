"""Fairness queries. Applicants are customers; the label is a rule with hash noise, so it is the same everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators import fairness as fair
from ravelin.plans import fragments as fr
from ravelin.plans.registry import query
from ravelin.sources.tables import Tables

CENTRES = ["AMERICA", "EUROPE"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
RATE = 0.4


def applicants(t: Tables) -> DataFrame:
    """One row per customer: id, score, program, region, group, number of orders, decision."""
    orders = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    rows = fr.customers_with_region(t).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    remote = (~F.col("r_name").isin(CENTRES)).cast("int")
    noise = fair.hash_fraction(F.lit("noise"), F.col("c_custkey"))
    rule = F.col("c_acctbal") / 4000 - 1.2 * remote + 4 * (noise - 0.5) > 0.8
    return rows.select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), F.col("c_mktsegment").alias("program"),
        F.col("r_name").alias("region"), fair.group_of(F.col("r_name"), CENTRES, "centre", "remote").alias("grp"),
        remote.alias("remote"), F.coalesce("n_orders", F.lit(0)).cast("double").alias("hours"),
        rule.cast("int").alias("y"),
    )


APPLICANTS_SQL = """
n_ord AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1),
base AS (SELECT c_custkey AS id, c_acctbal AS score, c_mktsegment AS program, r_name AS region,
  CASE WHEN r_name IN ('AMERICA', 'EUROPE') THEN 'centre' ELSE 'remote' END AS grp,
  CASE WHEN r_name IN ('AMERICA', 'EUROPE') THEN 0 ELSE 1 END AS remote, coalesce(k, 0)::DOUBLE AS hours,
  ('0x' || substr(md5('noise:' || c_custkey), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN n_ord ON o_custkey = c_custkey),
applicants AS (SELECT *, CASE WHEN score / 4000 - 1.2 * remote + 4 * (u - 0.5) > 0.8 THEN 1 ELSE 0 END AS y FROM base)"""

TOP_SQL = """(row_number() OVER (ORDER BY {score} DESC, md5(id::VARCHAR)) <= round_even(0.4 * count(*) OVER (), 0))::INT"""


@query(
    "prj03_two_group_mapping",
    f"WITH {APPLICANTS_SQL} SELECT id, grp, y FROM applicants",
)
def two_groups(t: Tables) -> DataFrame:
    return applicants(t).select("id", "grp", "y")


@query(
    "prj05_standardize",
    f"""WITH {APPLICANTS_SQL}, s AS (SELECT avg(score) AS m, stddev_samp(score) AS s, avg(hours) AS mh,
      stddev_samp(hours) AS sh FROM applicants)
    SELECT id, round((score - m) / s, 6) AS z_score, round((hours - mh) / sh, 6) AS z_hours FROM applicants, s""",
)
def standardized(t: Tables) -> DataFrame:
    rows = applicants(t)
    z = fair.standardize(rows, fair.moments(rows, ["score", "hours"]), ["score", "hours"])
    return z.select("id", F.round("z_score", 6).alias("z_score"), F.round("z_hours", 6).alias("z_hours"))


@query(
    "prj06_aligned_dummies",
    "SELECT c_custkey AS id, " + ", ".join(f"(c_mktsegment = '{s}')::INT::DOUBLE AS p_{s}" for s in [*SEGMENTS[1:], "UNSEEN"])
    + " FROM customer",
)
def aligned_dummies(t: Tables) -> DataFrame:
    cats = [*SEGMENTS, "UNSEEN"]
    return fair.dummies(t.customer, "c_mktsegment", cats, "p").select(
        F.col("c_custkey").alias("id"), *[f"p_{c}" for c in cats[1:]]
    )


@query(
    "prj07_interactions",
    f"WITH {APPLICANTS_SQL} SELECT id, round(score * remote, 4) AS score_x_remote, hours * remote AS hours_x_remote FROM applicants",
)
def interactions(t: Tables) -> DataFrame:
    rows = applicants(t)
    return rows.select(
        "id", *[F.round(F.col(c) * F.col("remote"), 4).alias(f"{c}_x_remote") for c in ("score", "hours")]
    )


@query(
    "top01_exact_global_quota",
    f"WITH {APPLICANTS_SQL} SELECT id, {TOP_SQL.format(score='score')} AS selected FROM applicants",
)
def exact_quota(t: Tables) -> DataFrame:
    return fair.select_top(applicants(t), "score", RATE, "id").select("id", "selected")


@query(
    "top02_per_group_quotas",
    f"""WITH {APPLICANTS_SQL}, g AS (SELECT grp, count(*) AS n FROM applicants GROUP BY 1),
    q AS (SELECT grp, floor(0.4 * n) AS base, 0.4 * n - floor(0.4 * n) AS rest, n FROM g),
    r AS (SELECT grp, base, row_number() OVER (ORDER BY rest DESC, grp) AS pos,
      round_even(0.4 * sum(n) OVER (), 0) - sum(base) OVER () AS spare FROM q),
    quotas AS (SELECT grp, base + (pos <= spare)::INT AS quota FROM r)
    SELECT id, a.grp, (row_number() OVER (PARTITION BY a.grp ORDER BY score DESC, md5(id::VARCHAR)) <= quota)::INT AS selected
    FROM applicants a JOIN quotas USING (grp)""",
)
def group_quotas(t: Tables) -> DataFrame:
    rows = applicants(t)
    quotas = fair.largest_remainder(rows, "grp", RATE)
    return fair.select_quota(rows, "grp", "score", "id", quotas).select("id", "grp", "selected")


BINS_SQL = f"""WITH {APPLICANTS_SQL}, e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q
      FROM applicants),
    b AS (SELECT len(list_filter(q, lambda x: score > x))::INT AS bin, y, grp FROM applicants, e),
    t AS (SELECT bin, count(*) AS n, avg(CASE WHEN grp = 'centre' THEN y END) AS rate_a,
      avg(CASE WHEN grp = 'remote' THEN y END) AS rate_b FROM b GROUP BY 1)"""


@query("agg02_quantile_bin_gap",
       BINS_SQL + " SELECT bin, n, round(rate_a, 6) AS rate_a, round(rate_b, 6) AS rate_b FROM t")
def bin_gap(t: Tables) -> DataFrame:
    table = fair.binned_gap(applicants(t), "score", "y", "grp", ("centre", "remote"), 10)
    return table.select("bin", "n", F.round("rate_a", 6).alias("rate_a"), F.round("rate_b", 6).alias("rate_b"))


@query("agg02_weighted_bin_gap",
       BINS_SQL + " SELECT round(sum((rate_a - rate_b) * n) / sum(n), 6) AS gap FROM t")
def bin_gap_total(t: Tables) -> DataFrame:
    table = fair.binned_gap(applicants(t), "score", "y", "grp", ("centre", "remote"), 10)
    return fair.weighted_bin_gap(table).withColumn("gap", F.round("gap", 6))


@query(
    "agg09_group_fairness_frame",
    """WITH j AS (SELECT lang, quality, (n_chars > 2000)::INT AS p FROM documents JOIN labels USING (doc_id))
    SELECT lang, count(*) AS n, round(avg(p), 6) AS selection_rate, round(avg(CASE WHEN quality = 1 THEN p END), 6) AS tpr,
      round(avg((quality = p)::INT), 6) AS accuracy FROM j GROUP BY lang""",
)
def fairness_frame(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    frame = fair.fairness_frame(rows, ["lang"], F.col("quality"), (F.col("n_chars") > 2000).cast("int"))
    return frame.select(
        "lang", "n", *[F.round(c, 6).alias(c) for c in ("selection_rate", "tpr", "accuracy")]
    )


@query(
    "agg09_parity_and_opportunity_gap",
    f"""WITH {APPLICANTS_SQL}, d AS (SELECT *, {TOP_SQL.format(score='score')} AS p FROM applicants)
    SELECT round(avg(CASE WHEN grp = 'centre' THEN p END) - avg(CASE WHEN grp = 'remote' THEN p END), 6) AS parity_gap,
      round(avg(CASE WHEN grp = 'centre' AND y = 1 THEN p END) - avg(CASE WHEN grp = 'remote' AND y = 1 THEN p END), 6)
        AS opportunity_gap, round(avg((y = p)::INT), 6) AS concordance FROM d""",
)
def parity_gap(t: Tables) -> DataFrame:
    chosen = fair.select_top(applicants(t), "score", RATE, "id")
    frame = fair.fairness_frame(chosen, ["grp"], F.col("y"), F.col("selected"))
    gaps = fair.group_gaps(frame, [], "grp", "centre", "remote")
    return gaps.select(*[F.round(c, 6).alias(c) for c in ("parity_gap", "opportunity_gap", "concordance")])


@query(
    "agg10_sensitivity_to_references",
    f"""WITH {APPLICANTS_SQL}, r AS (SELECT id, grp, y AS p, {TOP_SQL.format(score='score')} AS r1,
      {TOP_SQL.format(score='hours')} AS r2, {TOP_SQL.format(score='(score / 1000 + hours)')} AS r3 FROM applicants),
    l AS (SELECT grp, p, unnest(['r1', 'r2', 'r3']) AS reference, unnest([r1, r2, r3]) AS truth FROM r),
    g AS (SELECT reference, avg(CASE WHEN grp = 'centre' AND truth = 1 THEN p END)
      - avg(CASE WHEN grp = 'remote' AND truth = 1 THEN p END) AS gap, avg((truth = p)::INT) AS conc FROM l GROUP BY 1)
    SELECT round(min(gap), 6) AS gap_min, round(avg(gap), 6) AS gap_mean, round(max(gap), 6) AS gap_max,
      round(min(conc), 6) AS conc_min, round(avg(conc), 6) AS conc_mean, round(max(conc), 6) AS conc_max,
      round(1 - abs(avg(gap)) / abs(max(gap)), 6) AS share_closed FROM g""",
)
def sensitivity(t: Tables) -> DataFrame:
    rows = applicants(t).withColumn("mix", F.col("score") / 1000 + F.col("hours"))
    for name, score in (("r1", "score"), ("r2", "hours"), ("r3", "mix")):
        rows = fair.select_top(rows, score, RATE, "id", name)
    table = fair.against_references(rows, ["r1", "r2", "r3"], F.col("y"), "grp", "centre", "remote")
    gap, conc = F.col("opportunity_gap"), F.col("concordance")
    out = table.agg(
        F.min(gap).alias("gap_min"), F.avg(gap).alias("gap_mean"), F.max(gap).alias("gap_max"),
        F.min(conc).alias("conc_min"), F.avg(conc).alias("conc_mean"), F.max(conc).alias("conc_max"),
        (1 - F.abs(F.avg(gap)) / F.abs(F.max(gap))).alias("share_closed"),
    )
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def _cramer_sql(a: str, b: str) -> str:
    return f"""(SELECT sqrt(chi2 / n / least(ra - 1, rb - 1)) FROM (SELECT sum(o * o / (sa * sb / n)) - max(n) AS chi2,
      max(n) AS n, count(DISTINCT a) AS ra, count(DISTINCT b) AS rb FROM (SELECT a, b, o, sum(o) OVER (PARTITION BY a) AS sa,
      sum(o) OVER (PARTITION BY b) AS sb, sum(o) OVER () AS n FROM (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o
      FROM applicants GROUP BY ALL))))"""


@query(
    "agg11_association_measures",
    f"""WITH {APPLICANTS_SQL}
    SELECT 'score' AS measure, round(corr(score, remote), 6) AS association FROM applicants
    UNION ALL SELECT 'hours', round(corr(hours, remote), 6) FROM applicants
    UNION ALL SELECT 'program', round({_cramer_sql('program', 'remote')}, 6)
    UNION ALL SELECT 'region', round({_cramer_sql('region', 'remote')}, 6)""",
)
def associations(t: Tables) -> DataFrame:
    rows = applicants(t)
    corr = rows.agg(F.corr("score", "remote").alias("score"), F.corr("hours", "remote").alias("hours"))
    out = corr.select(F.explode(F.create_map(
        F.lit("score"), F.col("score"), F.lit("hours"), F.col("hours"))).alias("measure", "association"))
    for c in ("program", "region"):
        v = fair.cramer_v(fair.crosstab_counts(rows, c, "remote")).select(F.lit(c).alias("measure"), "association")
        out = out.unionByName(v)
    return out.withColumn("association", F.round("association", 6))


@query(
    "agg12_drift_tests",
    """WITH o AS (SELECT o_totalprice AS x, o_orderpriority AS c, o_orderdate < TIMESTAMP '1998-01-01' AS a FROM orders),
    v AS (SELECT x, sum(a::INT) AS na, sum((NOT a)::INT) AS nb FROM o GROUP BY x),
    e AS (SELECT sum(na) OVER (ORDER BY x) / sum(na) OVER () AS fa, sum(nb) OVER (ORDER BY x) / sum(nb) OVER () AS fb FROM v),
    k AS (SELECT c, a, count(*)::DOUBLE AS n FROM o GROUP BY ALL),
    t AS (SELECT n, sum(n) OVER (PARTITION BY c) AS sc, sum(n) OVER (PARTITION BY a) AS sa, sum(n) OVER () AS s FROM k)
    SELECT 'ks' AS test, round(max(abs(fa - fb)), 6) AS statistic FROM e
    UNION ALL SELECT 'chi2', round(sum((n - sc * sa / s) * (n - sc * sa / s) / (sc * sa / s)), 6) FROM t""",
)
def drift_tests(t: Tables) -> DataFrame:
    first = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    rows = t.orders.withColumn("half", first.cast("int"))
    ks = fair.ks_statistic(rows, "o_totalprice", F.col("half") == 1).select(
        F.lit("ks").alias("test"), F.round("d", 6).alias("statistic"))
    chi = fair.chi_square(fair.crosstab_counts(rows, "o_orderpriority", "half")).select(
        F.lit("chi2").alias("test"), F.round("chi2", 6).alias("statistic"))
    return ks.unionByName(chi)


@query(
    "agg12_bonferroni_verdict",
    """WITH o AS (SELECT o_orderdate < TIMESTAMP '1998-01-01' AS a, unnest(['o_totalprice', 'day']) AS measure, unnest([o_totalprice::DOUBLE, dayofyear(o_orderdate)::DOUBLE]) AS x FROM orders),
    v AS (SELECT measure, x, sum(a::INT) AS na, sum((NOT a)::INT) AS nb FROM o GROUP BY ALL),
    e AS (SELECT measure, sum(na) OVER w / sum(na) OVER p AS fa, sum(nb) OVER w / sum(nb) OVER p AS fb, sum(na) OVER p AS na, sum(nb) OVER p AS nb FROM v
      WINDOW w AS (PARTITION BY measure ORDER BY x), p AS (PARTITION BY measure)),
    k AS (SELECT measure, max(abs(fa - fb)) AS d, sqrt(max(na)::DOUBLE * max(nb) / (max(na) + max(nb))) AS en FROM e GROUP BY 1),
    q AS (SELECT measure, d, sum(2 * (-1) ** (j - 1) * exp(-2 * j * j * ((en + 0.12 + 0.11 / en) * d) ** 2)) AS p FROM k, range(1, 20) s(j) GROUP BY ALL)
    SELECT measure, round(d, 6) AS d, round(least(1, greatest(0, p)), 6) AS p_value, p < 0.05 / 2 AS differs FROM q""",
)
def drift_verdict(t: Tables) -> DataFrame:
    """KS p-values of two measures against the threshold divided by the number of tests (p-values are approximate)."""
    first = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    rows = t.orders.withColumn("day", F.dayofyear("o_orderdate"))
    parts = [
        fair.ks_statistic(rows, c, first).select(F.lit(c).alias("measure"), "d", "p_value") for c in ("o_totalprice", "day")
    ]
    tests = parts[0].unionByName(parts[1])
    return tests.select(
        "measure", F.round("d", 6).alias("d"), F.round("p_value", 6).alias("p_value"), (F.col("p_value") < 0.05 / len(parts)).alias("differs")
    )


@query(
    "agg13_standardised_mean_difference",
    """WITH o AS (SELECT *, o_orderdate < TIMESTAMP '1998-01-01' AS a, month(o_orderdate)::DOUBLE AS m FROM orders)
    SELECT 'price' AS measure, round(abs((avg(o_totalprice) FILTER (NOT a) - avg(o_totalprice) FILTER (a))
      / stddev_samp(o_totalprice) FILTER (a)), 6) AS smd FROM o
    UNION ALL SELECT 'month', round(abs((avg(m) FILTER (NOT a) - avg(m) FILTER (a)) / stddev_samp(m) FILTER (a)), 6) FROM o""",
)
def smd(t: Tables) -> DataFrame:
    cut = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    rows = t.orders.select(F.col("o_totalprice").alias("price"), F.month("o_orderdate").cast("double").alias("month"), cut.alias("a"))
    out = fair.mean_difference(rows.where("a"), rows.where("NOT a"), ["price", "month"])
    return out.withColumn("smd", F.round("smd", 6))


@query(
    "agg14_auc_and_balanced_accuracy",
    """WITH j AS (SELECT n_chars AS s, quality AS y, (n_chars > 2000)::INT AS p,
      1 / (1 + exp(-(n_chars - 2000) / 4000.0)) AS prob FROM documents JOIN labels USING (doc_id)),
    v AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM j GROUP BY s),
    c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY s) - neg AS below FROM v),
    a AS (SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM c)
    SELECT round(auc, 6) AS auc, round((avg(CASE WHEN y = 1 THEN p END) + avg(CASE WHEN y = 0 THEN 1 - p END)) / 2, 6) AS ba,
      round(sum(CASE WHEN y = 1 THEN ln(prob) ELSE ln(1 - prob) END), 6) AS loglik,
      round(2 * (sum(CASE WHEN y = 1 THEN ln(prob) ELSE ln(1 - prob) END) - count(*) * ln(0.5)), 6) AS lr_statistic
    FROM j, a GROUP BY auc""",
)
def auc_and_accuracy(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    prob = 1 / (1 + F.exp(-(F.col("n_chars") - 2000) / 4000.0))
    loglik = fair.log_likelihood(F.col("quality"), prob)
    null = fair.log_likelihood(F.col("quality"), F.lit(0.5))
    stats = rows.agg(
        F.round(fair.balanced_accuracy(F.col("quality"), (F.col("n_chars") > 2000).cast("int")), 6).alias("ba"),
        F.round(loglik, 6).alias("loglik"), F.round(2 * (loglik - null), 6).alias("lr_statistic"),
    )
    return fair.auc(rows, "n_chars", "quality").select(F.round("auc", 6).alias("auc")).join(F.broadcast(stats))


CUTS = fair.poisson_steps()


@query(
    "agg15_bootstrap_interval",
    f"""WITH j AS (SELECT doc_id, quality AS y, (n_chars > 2000)::INT AS p FROM documents JOIN labels USING (doc_id)),
    b AS (SELECT b, y, p, ('0x' || substr(md5(doc_id || ':' || b), 1, 8))::BIGINT / 4294967296.0 AS u
      FROM j, (SELECT unnest(range(1, 501)) AS b)),
    w AS (SELECT b, y, p, {" + ".join(f"(u >= {c})::INT" for c in CUTS)} AS w FROM b),
    m AS (SELECT b, sum(w * y * p) / sum(w * y) AS tpr, sum(w * (y = p)::INT) / sum(w) AS acc FROM w GROUP BY b)
    SELECT round(quantile_cont(tpr, 0.025), 6) AS tpr_low, round(quantile_cont(tpr, 0.975), 6) AS tpr_high,
      round(quantile_cont(acc, 0.025), 6) AS acc_low, round(quantile_cont(acc, 0.975), 6) AS acc_high FROM m""",
)
def bootstrap(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").withColumn("p", (F.col("n_chars") > 2000).cast("int"))
    y, p = F.col("quality"), F.col("p")
    out = fair.bootstrap_ci(
        rows, "doc_id", {"tpr": (y * p, y), "acc": ((y == p).cast("int"), F.lit(1))}, 500
    )
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "agg16_expected_rate_band",
    """WITH j AS (SELECT n_name, (o_orderstatus = 'F')::INT AS y, o_orderdate < TIMESTAMP '1998-01-01' AS ref FROM orders
      JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    e AS (SELECT n_name, avg(y) AS p FROM j WHERE ref GROUP BY 1),
    o AS (SELECT n_name, count(*) AS n, avg(y) AS observed FROM j WHERE NOT ref GROUP BY 1)
    SELECT n_name, n, round(observed, 6) AS observed, round(p - 1.959963984540054 * sqrt(p * (1 - p) / n), 6) AS low,
      round(p + 1.959963984540054 * sqrt(p * (1 - p) / n), 6) AS high,
      (NOT observed BETWEEN p - 1.959963984540054 * sqrt(p * (1 - p) / n) AND p + 1.959963984540054 * sqrt(p * (1 - p) / n))::INT
        AS out_of_band FROM o JOIN e USING (n_name)""",
)
def expected_band(t: Tables) -> DataFrame:
    names = fr.customers_with_region(t).select("c_custkey", "n_name")
    rows = t.orders.join(names, F.col("o_custkey") == F.col("c_custkey")).withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    expected = rows.where(old).groupBy("n_name").agg(F.avg("y").alias("expected"))
    band = fair.rate_band(rows.where(~old), expected, "n_name", F.col("y"))
    return band.select("n_name", "n", *[F.round(c, 6).alias(c) for c in ("observed", "low", "high")], "out_of_band")


WEIGHTS = {"z_score": 1.1, "z_hours": 0.3, "remote": -0.9}
INTERCEPT = -0.2
LAMBDAS = [0.0, 0.25, 0.5, 0.75, 1.0]

SCORES_SQL = f"""WITH {APPLICANTS_SQL}, s AS (SELECT avg(score) AS m, stddev_samp(score) AS s, avg(hours) AS mh,
      stddev_samp(hours) AS sh FROM applicants),
    d AS (SELECT a.*, lam, round(-0.2 + 1.1 * (score - m) / s + 0.3 * (hours - mh) / sh - 0.9 * remote * (1 - lam), 6) AS linear
      FROM applicants a, s, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS lam))"""


def _scored(t: Tables) -> DataFrame:
    rows = applicants(t)
    z = fair.standardize(rows, fair.moments(rows, ["score", "hours"]), ["score", "hours"])
    swept = z.withColumn("lam", F.explode(F.array(*[F.lit(v) for v in LAMBDAS])))
    linear = fair.debiased_score(WEIGHTS, INTERCEPT, {"remote"}, F.col("lam"))
    return swept.withColumn("linear", F.round(linear, 6))


@query("ml07_debiased_linear_score", SCORES_SQL + " SELECT id, lam, linear FROM d")
def debiased(t: Tables) -> DataFrame:
    return _scored(t).select("id", "lam", "linear")


@query(
    "ml08_lambda_sweep_front",
    SCORES_SQL + """, c AS (SELECT *, (row_number() OVER (PARTITION BY lam ORDER BY linear DESC, md5(id::VARCHAR))
      <= round_even(0.4 * count(*) OVER (PARTITION BY lam), 0))::INT AS p FROM d)
    SELECT lam, round(avg(CASE WHEN grp = 'centre' THEN p END) - avg(CASE WHEN grp = 'remote' THEN p END), 6) AS parity_gap,
      round(avg(CASE WHEN grp = 'centre' AND y = 1 THEN p END) - avg(CASE WHEN grp = 'remote' AND y = 1 THEN p END), 6)
        AS opportunity_gap, round(avg((y = p)::INT), 6) AS concordance, round(avg(p), 6) AS selection_rate FROM c GROUP BY lam""",
)
def lambda_sweep(t: Tables) -> DataFrame:
    rows = _scored(t)
    quotas = rows.groupBy("lam").agg(F.bround(F.lit(RATE) * F.count(F.lit(1))).cast("long").alias("quota"))
    chosen = fair.select_quota(rows, "lam", "linear", "id", quotas)
    frame = fair.fairness_frame(chosen, ["lam", "grp"], F.col("y"), F.col("selected"))
    gaps = fair.group_gaps(frame, ["lam"], "grp", "centre", "remote")
    return gaps.select("lam", *[F.round(c, 6).alias(c) for c in ("parity_gap", "opportunity_gap", "concordance", "selection_rate")])


def _thresholds_sql(reach: str, base: str) -> str:
    return f"""WITH {APPLICANTS_SQL}, v AS (SELECT grp, score AS s, sum(y) AS p, sum(1 - y) AS q FROM applicants GROUP BY ALL),
    c AS (SELECT grp, s, p, q, sum(p) OVER w AS cp, sum(q) OVER w AS cq, sum(p) OVER g AS tp, sum(q) OVER g AS tq FROM v
      WINDOW w AS (PARTITION BY grp ORDER BY s DESC), g AS (PARTITION BY grp)),
    k AS (SELECT unnest(range(1, 101)) AS k),
    pts AS (SELECT grp, k, max(s) AS threshold, arg_max(cq + tp - cp, s) AS errors FROM c, k
      WHERE ({reach}) * 100 >= k * ({base}) GROUP BY grp, k),
    best AS (SELECT k FROM pts GROUP BY k ORDER BY sum(errors), k LIMIT 1)
    SELECT grp, k AS rate_step, threshold, errors::BIGINT AS errors FROM pts WHERE k = (SELECT k FROM best)"""


@query("ml09_group_thresholds_tpr", _thresholds_sql("cp", "tp"))
def thresholds_tpr(t: Tables) -> DataFrame:
    return fair.group_thresholds(applicants(t), "score", "y", "grp", "tpr")


@query("ml09_group_thresholds_selection", _thresholds_sql("cp + cq", "tp + tq"))
def thresholds_selection(t: Tables) -> DataFrame:
    return fair.group_thresholds(applicants(t), "score", "y", "grp", "selection")
