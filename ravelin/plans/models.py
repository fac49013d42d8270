"""Model queries on the applicant table and on labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators import fairness as fair, fronts, models
from ravelin.operators.panel import yearly_median
from ravelin.plans import fragments as fr
from ravelin.plans.fairness import RATE, SEGMENTS, applicants
from ravelin.plans.registry import query
from ravelin.session import cut_lineage
from ravelin.sources.tables import Tables

REGIONS = ["AMERICA", "EUROPE", "AFRICA", "ASIA", "MIDDLE EAST"]
CRITERIA = ["z_score", "z_hours", *[f"p_{s}" for s in SEGMENTS[1:]]]


def prepared(t: Tables) -> DataFrame:
    """Applicants with standard scores and 0/1 columns; read by every fit, so written once."""
    rows = applicants(t)
    z = fair.standardize(rows, fair.moments(rows, ["score", "hours"]), ["score", "hours"])
    wide = fair.dummies(fair.dummies(z, "program", SEGMENTS, "p"), "region", REGIONS, "r")
    return cut_lineage(wide.withColumn("remote", F.col("remote").cast("double")))


@query("ml01_logit_coefficient_table")
def logit_table(t: Tables) -> DataFrame:
    rows, features = prepared(t), [*CRITERIA, "remote"]
    return models.coefficient_table(rows, models.fit_logit(rows, features, "y"), features)


@query("ml02_region_effects_against_one_indicator")
def nested(t: Tables) -> DataFrame:
    rows = prepared(t)
    one = [*CRITERIA, "remote"]
    many = [*CRITERIA, *[f"r_{r}" for r in REGIONS[1:]]]
    m1, m2 = models.fit_logit(rows, one, "y"), models.fit_logit(rows, many, "y")
    statistic, dof, p = models.lr_test(rows, (m1, one), (m2, many), "y")
    scored = rows.withColumns({"s1": models.linear_score(m1, one, {"remote"}), "s2": models.linear_score(m2, many, {f"r_{r}" for r in REGIONS[1:]})})
    both = fair.select_top(fair.select_top(scored, "s1", RATE, "id", "d1"), "s2", RATE, "id", "d2")
    return both.agg(F.avg((F.col("d1") == F.col("d2")).cast("double")).alias("agreement")).select(
        F.lit(float(statistic)).alias("lr_statistic"), F.lit(dof).alias("dof"), F.lit(float(p)).alias("p_value"), "agreement"
    )


@query("ml03_slopes_per_group_and_interaction")
def slopes(t: Tables) -> DataFrame:
    """Slope of the score per group (two fits) and the interaction test on the pooled rows."""
    rows = prepared(t).withColumn("score_x_remote", F.col("z_score") * F.col("remote"))
    out = None
    for g in ("centre", "remote"):
        part = rows.where(F.col("grp") == g)
        table = models.coefficient_table(part, models.fit_logit(part, CRITERIA, "y"), CRITERIA).where("feature = 'z_score'").withColumn("grp", F.lit(g))
        out = table if out is None else out.unionByName(table)
    base, full = [*CRITERIA, "remote"], [*CRITERIA, "remote", "score_x_remote"]
    statistic, dof, p = models.lr_test(rows, (models.fit_logit(rows, base, "y"), base), (models.fit_logit(rows, full, "y"), full), "y")
    return out.select("grp", "coefficient", "std_error", F.lit(float(statistic)).alias("interaction_lr"), F.lit(float(p)).alias("p_value"))


def labelled(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source", "n_chars", F.size(F.split("text", r"\s+")).cast("double").alias("words")).join(t.labels, "doc_id")
    shaped = rows.withColumns(
        {
            "chars": F.col("n_chars").cast("double"), "is_en": (F.col("lang") == "en").cast("double"),
            "src": F.regexp_extract("source", r"\d+", 0).cast("double"), "grp": fair.group_of(F.col("lang"), ["en"], "en", "other"),
        }
    )
    return cut_lineage(shaped)


@query("ml04_forest_baseline")
def baseline(t: Tables) -> DataFrame:
    features = ["chars", "words", "is_en", "src"]
    train, test = models.split_by_hash(labelled(t), "doc_id", 0.7, "split")
    scored = models.predict(test, models.forest(train, features, "quality", trees=300, leaf=20), features)
    return fair.fairness_frame(scored, ["grp"], F.col("quality"), F.col("pred"))


@query("ml05_column_ablation")
def ablation(t: Tables) -> DataFrame:
    train, test = models.split_by_hash(labelled(t), "doc_id", 0.7, "split")
    sets = {"all": ["chars", "words", "is_en", "src"], "without language": ["chars", "words", "src"], "without language and source": ["chars", "words"]}
    return models.ablate(train, test, sets, "quality", "grp", "en", "other", trees=300)


@query("ml06_proxy_power_of_columns")
def proxies(t: Tables) -> DataFrame:
    rows = prepared(t).withColumn("nation_code", F.col("id") * 0.0 + F.hash("region") % 1000)
    sets = {"place": ["nation_code"], "score and hours": ["z_score", "z_hours"]}
    return models.proxy_power(rows, "id", sets, "remote", folds=5, trees=100)


@query("agg08_gap_decomposition")
def decomposition(t: Tables) -> DataFrame:
    return models.decompose_gap(prepared(t), CRITERIA, "y", "grp", "centre", "remote")


@query("ml10_reduction_with_bound")
def reduction(t: Tables) -> DataFrame:
    rows = prepared(t)
    chosen = models.reduction(rows, [*CRITERIA, "remote"], "y", "grp", bound=0.05)
    return fair.fairness_frame(chosen, ["grp"], F.col("y"), F.col("selected"))


@query("ml10_front_over_bounds")
def front(t: Tables) -> DataFrame:
    """Least error under each bound on the gap of true-positive rates, with the duality gap and what the drawn selection comes to."""
    rows, features = prepared(t), [*CRITERIA, "remote"]
    points = fronts.constrained_front(rows, features, "y", "grp", "remote", [0.01, 0.05, 0.1, 0.2, 0.5])
    drawn = []
    for p in points:
        selected = fronts.mixed_selection(rows, "id", features, p)
        drawn.append(selected.agg(F.avg((F.col("selected") != F.col("y")).cast("double")).alias("drawn_error"), F.avg("selected").alias("rate")).withColumn("bound", F.lit(p.bound)))
    union = drawn[0]
    for part in drawn[1:]:
        union = union.unionByName(part)
    table = [(p.bound, p.error, abs(p.gap), p.lower, p.duality_gap, len(p.mixture)) for p in points]
    return t.spark.createDataFrame(table, "bound double, error double, gap double, lower double, duality_gap double, rules int").join(F.broadcast(union), "bound")


@query("ml11_bootstrap_refits")
def refits(t: Tables) -> DataFrame:
    """Penalty over weighted refits, and how many decisions each refit would turn."""
    rows, features = prepared(t), [*CRITERIA, "remote"]
    model = models.fit_logit(rows, features, "y")
    base = fair.select_top(rows.withColumn("s", models.linear_score(model, features, {"remote"})), "s", RATE, "id")
    beta = models.bootstrap_logit(rows, "id", features, "y", replicates=200)
    flips = models.decision_flips(base, "id", features, beta, {"remote"}, RATE)
    penalty = beta[:, -1]
    return flips.agg(F.median("flips").alias("flips_median"), F.max("flips").alias("flips_max"), F.count(F.lit(1)).alias("replicates")).withColumns(
        {"penalty_mean": F.lit(float(penalty.mean())), "penalty_sd": F.lit(float(penalty.std(ddof=1)))}
    )


def monitored(rows: DataFrame) -> DataFrame:
    """Indicators of applicant decisions against the corrected rule on the same rows."""
    features = [*CRITERIA, "remote"]
    model = models.fit_logit(rows, features, "y")
    fixed = fair.select_top(rows.withColumn("s", models.linear_score(model, features, {"remote"})), "s", RATE, "id")
    expected = fixed.groupBy("region").agg(F.avg("selected").alias("expected"))
    limits = {"rate_low": 0.38, "rate_high": 0.42, "penalty": 0.25, "auc": 0.6}
    made = models.monitor(rows.withColumn("selected", F.col("y")), expected, "region", "selected", CRITERIA, "remote", limits)
    better = models.monitor(fixed, expected, "region", "selected", CRITERIA, "remote", limits)
    return made.withColumn("batch", F.lit("history")).unionByName(better.withColumn("batch", F.lit("corrected")))


@query("ml12_batch_monitoring")
def monitoring(t: Tables) -> DataFrame:
    return monitored(prepared(t))


@query("ml15_unit_regression_forecast")
def unit_forecast(t: Tables) -> DataFrame:
    pairs = cut_lineage(fr.pairs(t).select("o_custkey", "year", "province", "is_renewal", "effective_growth", "prev_conceded", "gap_years"))
    market = yearly_median(pairs, "effective_growth", "lag_growth").select((F.col("year") + 1).alias("year"), "lag_growth")
    shape = lambda df: df.withColumns(
        {"is_renewal": F.col("is_renewal").cast("double"), "is_rule": (F.col("province") == fr.GUIDELINE_PROVINCE).cast("double"),
         "conceded": F.col("prev_conceded").cast("double")}
    )
    history = shape(pairs.join(F.broadcast(market), "year"))
    last = fr.leases(t).groupBy("o_custkey").agg(
        F.max_by(F.struct("province", "conceded"), F.struct("o_orderdate", "o_orderkey")).alias("l")
    )
    latest_growth = market.agg(F.max_by("lag_growth", "year").alias("lag_growth"))
    expiring = shape(last.select(F.lit(True).alias("is_renewal"), F.col("l.province").alias("province"), F.col("l.conceded").alias("prev_conceded")).join(F.broadcast(latest_growth)))
    return models.unit_regression(history, expiring, ["is_renewal", "is_rule", "conceded", "lag_growth"], "is_renewal", "effective_growth")
