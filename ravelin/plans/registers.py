"""Registers and reshaped tables: projections, crosstabs, facets, histograms, actions, invoices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.functions import text
from ravelin.functions.binding import lookup
from ravelin.operators import quality as dq, reshape
from ravelin.operators.ordering import global_rank, top_per_key
from ravelin.plans import fragments as fr
from ravelin.plans.registry import query
from ravelin.sources.tables import Tables

DAY = "yyyy-MM-dd"


@query(
    "prj01_rename_drop_recode",
    """SELECT c_custkey AS unit_id, c_name AS unit_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE '?' END AS code,
      (c_acctbal > 2500)::INT AS is_large, c_acctbal AS balance FROM customer""",
)
def rename_recode(t: Tables) -> DataFrame:
    """Rename by a spec, drop constant columns found in one pass, recode and flag."""
    rows = t.customer.withColumns({"const": F.lit("x"), "flag": (F.col("c_acctbal") > 2500).cast("int")})
    constant = [r.column_name for r in dq.constant_columns(rows, "customer").collect()]  # one row per column at most
    spec = {"c_custkey": "unit_id", "c_name": "unit_name", "c_mktsegment": "code", "flag": "is_large", "c_acctbal": "balance"}
    named = rows.drop(*constant, "c_nationkey").withColumnsRenamed(spec)
    return named.withColumn("code", lookup({"BUILDING": "B", "MACHINERY": "M"}, F.col("code"), "?"))


@query(
    "prj02_derived_measures",
    """WITH l AS (SELECT l_orderkey, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY 1)
    SELECT o_custkey || ':' || strftime(o_orderdate, '%Y-%m-%d') || ':' || o_orderkey AS row_id, year(o_orderdate) AS year,
      round((1 - o_totalprice * (1 - coalesce(d, 0)) / o_totalprice) * 100, 4) AS discount_pct FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def derived(t: Tables) -> DataFrame:
    return fr.leases(t).select(
        F.concat_ws(":", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", DAY), F.col("o_orderkey").cast("string")).alias("row_id"),
        "year", F.round((1 - F.col("effective") / F.col("contract")) * 100, 4).alias("discount_pct"),
    )


@query(
    "prj08_faceted_filter_and_sort",
    """WITH d AS (SELECT doc_id, lang, source, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars END AS size, [lang, source] AS tags,
      lower(strip_accents(text)) AS h FROM documents),
    f AS (SELECT * FROM d WHERE lang IN ('fr', 'en') AND (list_contains(tags, 'src1') OR list_contains(tags, 'src2') OR list_contains(tags, 'fr')) AND contains(h, 're') AND contains(h, 'en'))
    SELECT doc_id, size, row_number() OVER (ORDER BY size DESC NULLS LAST, md5(doc_id::VARCHAR)) AS position FROM f""",
)
def faceted_filter(t: Tables) -> DataFrame:
    """The whole sorted list, nulls last, ties by the hash of the id; a page of it is a range of positions."""
    rows = t.documents.select(
        "doc_id", "lang", "source", F.when(F.col("n_chars") % 7 != 0, F.col("n_chars")).alias("size"),
        F.array("lang", "source").alias("tags"), text.plain(F.col("text")).alias("h"),
    )
    found = reshape.faceted(rows, {"lang": ["fr", "en"], "source": []}, {"tags": ["src1", "src2", "fr"]}, F.col("h"), "re en")
    return global_rank(found.select("doc_id", "size"), "size", F.col("doc_id"), "position")


@query(
    "prj13_confidence_caps_and_retained_gaps",
    """WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, 1 - l_tax * 8 AS plan_conf, 1 - l_discount * 4 AS shop_conf, l_returnflag, l_linestatus, l_quantity FROM lineitem),
    c AS (SELECT *, round(least(plan_conf, shop_conf), 2) AS base FROM p),
    k AS (SELECT *, least(base, CASE WHEN l_returnflag = 'N' THEN 0.4 ELSE 1 END, CASE WHEN l_linestatus = 'O' THEN 0.5 ELSE 1 END) AS conf FROM c)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, round(conf, 2) AS confidence, CASE WHEN conf >= 0.5 AND l_quantity > 25 THEN 1 ELSE 0 END AS n_gaps,
      array_to_string(list_filter([CASE WHEN l_linestatus = 'O' THEN 'approximate' END, CASE WHEN l_returnflag = 'N' THEN 'unread' END,
        CASE WHEN conf < 0.5 THEN 'weak' END, CASE WHEN conf < 0.5 AND l_quantity > 25 THEN 'gap not kept' END], lambda x: x IS NOT NULL), '; ') AS note FROM k""",
)
def retained_gaps(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        (1 - F.col("l_tax") * 8).alias("plan_conf"), (1 - F.col("l_discount") * 4).alias("shop_conf"),
        (F.col("l_returnflag") == "N").alias("unread"), (F.col("l_linestatus") == "O").alias("approximate"),
        F.when(F.col("l_quantity") > 25, F.array(F.lit("quantity"))).otherwise(F.array().cast("array<string>")).alias("gaps"),
    )
    from ravelin.operators.reconcile import retain_gaps

    out = retain_gaps(rows, "plan_conf", "shop_conf", F.col("unread"), F.col("approximate"), "gaps")
    return out.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "confidence",
        F.size("kept").alias("n_gaps"), "note",
    )


@query(
    "prj14_scope_split",
    """WITH k AS (SELECT DISTINCT o_orderstatus, month(o_orderdate) AS m FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000)
    SELECT o.o_orderstatus, month(o.o_orderdate) AS month, count(*) FILTER (k.m IS NOT NULL) AS in_scope, count(*) FILTER (k.m IS NULL) AS out_of_scope
    FROM orders o LEFT JOIN k ON k.o_orderstatus = o.o_orderstatus AND k.m = month(o.o_orderdate) GROUP BY ALL""",
)
def scope_split(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("month", F.month("o_orderdate").cast("long"))
    plan = rows.where("o_orderpriority = '1-URGENT' AND o_totalprice > 450000").select("o_orderstatus", "month").distinct()
    inside = rows.join(plan, ["o_orderstatus", "month"], "left_semi").withColumn("inside", F.lit(1))
    outside = rows.join(plan, ["o_orderstatus", "month"], "left_anti").withColumn("inside", F.lit(0))
    return inside.unionByName(outside).groupBy("o_orderstatus", "month").agg(
        F.count_if(F.col("inside") == 1).alias("in_scope"), F.count_if(F.col("inside") == 0).alias("out_of_scope")
    )


@query(
    "agg03_crosstab_with_margins",
    "SELECT coalesce(o_orderstatus, 'total') AS o_orderstatus, " + ", ".join(
        f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    ) + ", count(*) AS total FROM orders GROUP BY ROLLUP (o_orderstatus)",
)
def crosstab(t: Tables) -> DataFrame:
    return reshape.crosstab(t.orders, "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


YEARS = list(range(1995, 2002))


@query(
    "agg04_pivot_and_melt",
    "SELECT o_orderstatus, 'y' || year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL",
)
def pivot_and_melt(t: Tables) -> DataFrame:
    wide = (
        t.orders.withColumn("o_year", F.concat(F.lit("y"), F.year("o_orderdate").cast("string")))
        .groupBy("o_orderstatus").pivot("o_year", [f"y{y}" for y in YEARS]).agg(F.round(F.sum("o_totalprice"), 2))
    )
    return reshape.melt(wide, ["o_orderstatus"], [f"y{y}" for y in YEARS], "year", "total")


@query(
    "agg19_counts_per_sheet_with_total",
    """SELECT coalesce(n_name, 'all') AS n_name, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
      count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) FILTER (o_orderstatus = 'X') AS "X", count(*) AS n
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_name)""",
)
def sheet_counts(t: Tables) -> DataFrame:
    names = fr.customers_with_region(t).select("c_custkey", "n_name")
    rows = t.orders.join(names, F.col("o_custkey") == F.col("c_custkey"))
    return reshape.status_counts(rows, "n_name", "o_orderstatus", ["F", "O", "P", "X"])


@query(
    "agg20_recall_precision",
    """WITH j AS (SELECT quality = 1 AS expected, n_chars > 1500 AS flagged FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT count(*) FILTER (expected) AS n_expected, count(*) FILTER (expected AND flagged) AS n_found, count(*) FILTER (flagged) AS n_flagged,
      count(*) FILTER (flagged AND expected) AS n_true FROM j)
    SELECT round(n_found / n_expected, 3) AS recall, round(n_true / n_flagged, 3) AS precision, n_expected, n_found, n_flagged, n_flagged - n_true AS off_truth FROM c""",
)
def recall_precision(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    expected, flagged = F.col("quality") == 1, F.col("n_chars") > 1500
    return reshape.scores(rows, expected, flagged, flagged, expected)


@query(
    "agg25_work_per_owner",
    """WITH o AS (SELECT c_mktsegment AS owner, o_orderpriority AS type, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'
      UNION ALL SELECT n_name, o_orderpriority, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'F')
    SELECT owner, count(*) FILTER (type = '1-URGENT') AS documented, count(*) FILTER (type <> '1-URGENT') AS recommended, count(*) AS total, min(o_orderkey) AS first_id FROM o GROUP BY owner""",
)
def owner_load(t: Tables) -> DataFrame:
    """Open actions per owner; an order belongs to a segment and a nation, counted before they are spread."""
    rows = fr.customers_with_region(t).join(t.orders.where("o_orderstatus <> 'F'"), F.col("o_custkey") == F.col("c_custkey"))
    owners = rows.select(F.explode(F.array("c_mktsegment", "n_name")).alias("owner"), "o_orderpriority", "o_orderkey")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return owners.groupBy("owner").agg(
        F.count_if(urgent).alias("documented"), F.count_if(~urgent).alias("recommended"),
        F.count(F.lit(1)).alias("total"), F.min("o_orderkey").alias("first_id"),
    )


@query(
    "agg26_invoice_portfolio",
    """WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS billed, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END) AS paid,
      sum(CASE WHEN l_linestatus <> 'F' THEN l_extendedprice ELSE 0 END) AS pending, sum(CASE WHEN l_linestatus <> 'F' AND l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS disputed,
      max((l_returnflag = 'R')::INT) AS has_disputed_line FROM lineitem GROUP BY 1)
    SELECT l_orderkey, round(billed, 2) AS billed, round(paid, 2) AS paid, round(pending, 2) AS pending, round(disputed, 2) AS disputed, has_disputed_line,
      round(greatest(0, pending - disputed), 2) AS admissible, round(greatest(0, coalesce(o_totalprice, 0) - billed), 2) AS open FROM s LEFT JOIN orders ON o_orderkey = l_orderkey""",
)
def portfolio(t: Tables) -> DataFrame:
    authorized = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("authorized"))
    out = reshape.portfolio(
        t.lineitem, "l_orderkey", "l_extendedprice", F.col("l_linestatus") == "F", F.col("l_returnflag") == "R", authorized
    )
    amounts = ["billed", "paid", "pending", "disputed", "admissible", "open"]
    return out.select("l_orderkey", "has_disputed_line", *[F.round(c, 2).alias(c) for c in amounts])


@query(
    "agg27_dense_day_histogram",
    """WITH e AS (SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts::DATE END AS day, event_type FROM events),
    s AS (SELECT unnest(generate_series(date_trunc('month', min(day))::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM e),
    c AS (SELECT day, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors FROM e GROUP BY 1)
    SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(views, 0) AS views, coalesce(errors, 0) AS errors FROM s LEFT JOIN c ON c.day = s.day
    UNION ALL SELECT NULL, views, errors FROM c WHERE day IS NULL""",
)
def day_histogram(t: Tables) -> DataFrame:
    rows = t.events
    day = F.when(F.col("event_id") % 50 != 0, F.to_date("ts"))
    out = reshape.day_histogram(rows, day, {"views": F.col("event_type") == "view", "errors": F.col("event_type") == "error"})
    return out.withColumn("day", F.date_format("day", DAY))


@query(
    "agg28_facet_counts",
    """SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
    UNION ALL SELECT 'size', CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END, count(*) FROM documents GROUP BY 2""",
)
def facet_counts(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("size", F.when(F.col("n_chars") > 2000, "long").otherwise("short"))
    return reshape.facets(rows, ["lang", "source", "size"])


@query(
    "agg29_text_coverage_ratio",
    """SELECT source, round(sum(CASE WHEN lang = 'en' AND n_chars > 1000 THEN 1 ELSE 0 END) / nullif(sum((lang = 'en')::INT), 0), 6) AS en,
      round(sum(CASE WHEN lang = 'fr' AND n_chars > 1000 THEN 1 ELSE 0 END) / nullif(sum((lang = 'fr')::INT), 0), 6) AS fr,
      round(sum(CASE WHEN lang = 'de' AND n_chars > 1000 THEN 1 ELSE 0 END) / nullif(sum((lang = 'de')::INT), 0), 6) AS de,
      round(sum(CASE WHEN lang = 'es' AND n_chars > 1000 THEN 1 ELSE 0 END) / nullif(sum((lang = 'es')::INT), 0), 6) AS es FROM documents GROUP BY source""",
)
def coverage(t: Tables) -> DataFrame:
    pages, covered = F.count(F.lit(1)), F.count_if(F.col("n_chars") > 1000)
    ratio = F.round(F.try_divide(covered, pages), 6)
    return t.documents.groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(ratio)


@query(
    "agg33_fill_rates_and_conformity",
    """SELECT l_returnflag, count(*) AS n, round(avg((CASE WHEN l_quantity > 10 THEN l_quantity END IS NOT NULL)::INT), 6) AS fill_quantity,
      round(avg((o_orderkey IS NOT NULL)::INT), 6) AS fill_order, round(avg((l_linenumber BETWEEN 1 AND 5)::INT), 6) AS conform,
      round(avg((coalesce(l_extendedprice <= o_totalprice, FALSE))::INT), 6) AS inside FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def fill_rates(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumns(
        {"quantity": F.when(F.col("l_quantity") > 10, F.col("l_quantity")), "order": F.col("o_orderkey")}
    )
    inside = F.coalesce(F.col("l_extendedprice") <= F.col("o_totalprice"), F.lit(False))
    out = dq.quality_profile(rows, ["l_returnflag"], ["quantity", "order"], F.col("l_linenumber").between(1, 5), inside)
    return out.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("fill_quantity", "fill_order", "conform", "inside")])


@query(
    "win09_number_repeated_ids",
    """WITH i AS (SELECT o_orderkey, o_custkey || '-' || o_orderstatus AS id FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderkey) AS k FROM i)
    SELECT o_orderkey, id || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS finding_id FROM n""",
)
def repeated_ids(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderstatus").alias("id"))
    out = reshape.number_duplicates(rows, "id", ["o_orderkey"], F.floor(F.col("o_orderkey") / 65536), "finding_id")
    return out.select("o_orderkey", "finding_id")


@query(
    "win10_key_collisions",
    """WITH c AS (SELECT c_mktsegment, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 50)) > 1 AS collides FROM customer)
    SELECT c_mktsegment, count(*) AS units, count(*) FILTER (collides) AS colliding FROM c GROUP BY 1""",
)
def key_collisions(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("band", F.floor(F.col("c_acctbal") / 50))
    marked = reshape.collisions(rows, ["c_nationkey", "c_mktsegment", "band"])
    return marked.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("units"), F.count_if("collides").alias("colliding"))


@query(
    "win14_decision_spans",
    """WITH s AS (SELECT l_orderkey, min(l_shipdate) AS proposed, max(l_shipdate) AS decided FROM lineitem GROUP BY 1),
    b AS (SELECT min(proposed) AS lo, max(decided) AS hi FROM s)
    SELECT l_orderkey, strftime(proposed, '%Y-%m-%d') AS proposed, strftime(decided, '%Y-%m-%d') AS decided,
      round(datediff('day', lo, proposed) / datediff('day', lo, hi), 6) AS start, round(datediff('day', lo, decided) / datediff('day', lo, hi), 6) AS stop FROM s, b""",
)
def decision_spans(t: Tables) -> DataFrame:
    """Dates named in a text per order, their first and last, placed between the overall bounds."""
    note = F.concat(F.lit("proposé le "), F.date_format("l_shipdate", DAY), F.lit(", revu le "), F.date_format("l_shipdate", DAY))
    dated = t.lineitem.select("l_orderkey", F.regexp_extract_all(note, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0)).alias("ds"))
    spans = dated.groupBy("l_orderkey").agg(F.min(F.array_min("ds")).alias("proposed"), F.max(F.array_max("ds")).alias("decided"))
    bounds = spans.agg(F.min("proposed").alias("lo"), F.max("decided").alias("hi"))
    share = lambda c: F.round(F.datediff(F.col(c).cast("date"), F.col("lo").cast("date")) / F.datediff(F.col("hi").cast("date"), F.col("lo").cast("date")), 6)
    return spans.join(F.broadcast(bounds)).select("l_orderkey", "proposed", "decided", share("proposed").alias("start"), share("decided").alias("stop"))


@query(
    "win15_countdown_and_conditions",
    """SELECT datediff('day', DATE '2001-01-01', max(o_orderdate)::DATE) AS days_left, count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS unmet,
      count(*) FILTER (o_orderstatus = 'F') AS met, count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS to_confirm FROM orders""",
)
def countdown(t: Tables) -> DataFrame:
    as_of = F.lit("2001-01-01").cast("date")
    unmet = F.col("o_orderstatus") != "F"
    return t.orders.agg(
        F.datediff(F.max("o_orderdate"), as_of).cast("long").alias("days_left"), F.count(F.lit(1)).alias("total"),
        F.count_if(unmet).alias("unmet"), F.count_if(~unmet).alias("met"), F.count_if(F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("to_confirm"),
    )


@query(
    "win16_neighbour_days",
    """WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events)
    SELECT strftime(day, '%Y-%m-%d') AS day, strftime(lag(day) OVER (ORDER BY day), '%Y-%m-%d') AS previous, strftime(lead(day) OVER (ORDER BY day), '%Y-%m-%d') AS next,
      strftime((SELECT max(day) FROM d WHERE day <= DATE '2024-01-20'), '%Y-%m-%d') AS last_before FROM d""",
)
def neighbour_days(t: Tables) -> DataFrame:
    days = t.events.select(F.to_date("ts").alias("day")).distinct()
    order = W.orderBy("day")  # one row per calendar day
    last = days.where(F.col("day") <= F.lit("2024-01-20").cast("date")).agg(F.max("day").alias("last_before"))
    text_of = lambda c: F.date_format(c, DAY)
    return days.withColumns({"previous": F.lag("day").over(order), "next": F.lead("day").over(order)}).join(F.broadcast(last)).select(
        text_of("day").alias("day"), text_of("previous").alias("previous"), text_of("next").alias("next"), text_of("last_before").alias("last_before")
    )


@query(
    "top12_priority_actions_and_top_risks",
    """WITH a AS (SELECT 'action' AS kind, o_orderkey AS id, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 99 END,
      (o_orderpriority <> '1-URGENT')::INT, o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderstatus <> 'F'),
    r AS (SELECT 'risk' AS kind, o_orderkey AS id, row_number() OVER (ORDER BY (6 - substr(o_orderpriority, 1, 1)::INT) * CASE WHEN o_totalprice > 300000 THEN 3 ELSE 1 END DESC, o_orderkey) AS position FROM orders)
    SELECT * FROM a WHERE position <= 20 UNION ALL SELECT * FROM r WHERE position <= 10""",
)
def priority(t: Tables) -> DataFrame:
    place = lambda df, order, k, kind: df.orderBy(*order).limit(k).select(
        F.lit(kind).alias("kind"), F.col("o_orderkey").alias("id"), F.row_number().over(W.orderBy(*order)).alias("position")
    )
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(99)
    actions = [rank, (F.col("o_orderpriority") != "1-URGENT"), F.col("o_orderdate"), F.col("o_orderkey")]
    severity = (6 - F.substring("o_orderpriority", 1, 1).cast("int")) * F.when(F.col("o_totalprice") > 300000, 3).otherwise(1)
    return place(t.orders.where("o_orderstatus <> 'F'"), actions, 20, "action").unionByName(
        place(t.orders, [severity.desc(), F.col("o_orderkey")], 10, "risk")
    )


@query(
    "top14_chains_and_recent_strip",
    """WITH n AS (SELECT l_orderkey, l_partkey, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem
      JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT')
    SELECT 'chain' AS kind, l_orderkey::VARCHAR AS id, string_agg(l_partkey || ':' || CASE l_linestatus WHEN 'F' THEN 'positive' ELSE 'warning' END, ' > ' ORDER BY pos) AS detail
      FROM n WHERE pos <= 4 GROUP BY l_orderkey
    UNION ALL SELECT 'day', strftime(d.day, '%Y-%m-%d'), coalesce(c.n, 0)::VARCHAR FROM (SELECT unnest(generate_series(m - INTERVAL 6 DAY, m, INTERVAL 1 DAY))::DATE AS day
      FROM (SELECT max(ts::DATE)::TIMESTAMP AS m FROM events)) d LEFT JOIN (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) c ON c.day = d.day""",
)
def chains(t: Tables) -> DataFrame:
    """First four actions of each urgent condition, and the last seven days with their counts."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    nodes = top_per_key(
        t.lineitem.join(urgent, "l_orderkey", "left_semi"), ["l_orderkey"],
        [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")], 4, "pos",
    )
    tone = F.when(F.col("l_linestatus") == "F", "positive").otherwise("warning")
    label = F.concat(F.col("l_partkey").cast("string"), F.lit(":"), tone)
    lists = nodes.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", label.alias("label")))).alias("ns"))
    chain = lists.select(
        F.lit("chain").alias("kind"), F.col("l_orderkey").cast("string").alias("id"), F.array_join(F.transform("ns", lambda n: n["label"]), " > ").alias("detail")
    )
    last = t.events.agg(F.max(F.to_date("ts")).alias("m"))
    days = last.select(F.explode(F.sequence(F.date_sub("m", 6), "m")).alias("day"))
    counts = t.events.where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    strip = days.join(counts, "day", "left").select(
        F.lit("day").alias("kind"), F.date_format("day", DAY).alias("id"), F.coalesce("n", F.lit(0)).cast("string").alias("detail")
    )
    return chain.unionByName(strip)


@query(
    "joi25_truth_joined_to_findings",
    """WITH g AS (SELECT doc_id, quality = 1 AS expected FROM labels),
    f AS (SELECT doc_id, 'F' || doc_id || '-' || k AS finding, CASE WHEN (n_chars + k) % 3 = 0 THEN 'non_conforme' ELSE 'conforme' END AS status FROM documents, (SELECT unnest([1, 2, 3]) AS k) WHERE lang <> 'es'),
    j AS (SELECT g.*, finding, status, row_number() OVER (PARTITION BY g.doc_id ORDER BY (status = 'non_conforme') DESC, finding) AS rn FROM g LEFT JOIN f USING (doc_id))
    SELECT doc_id, finding, status, CASE WHEN expected THEN (coalesce(status, '') = 'non_conforme')::INT END AS found FROM j WHERE rn = 1""",
)
def truth_to_findings(t: Tables) -> DataFrame:
    from ravelin.operators.reconcile import eval_join

    truth = t.labels.select(F.concat(F.lit("L "), F.col("doc_id").cast("string")).alias("location"), "doc_id", (F.col("quality") == 1).alias("expected"))
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")
    found = t.documents.where("lang <> 'es'").select("doc_id", "n_chars", k).select(
        F.concat(F.lit("l"), F.col("doc_id").cast("string")).alias("element"),
        F.concat_ws("-", F.concat(F.lit("F"), F.col("doc_id").cast("string")), F.col("k").cast("string")).alias("finding"),
        F.when((F.col("n_chars") + F.col("k")) % 3 == 0, "non_conforme").otherwise("conforme").alias("status"),
    )
    return eval_join(truth, found).select("doc_id", "finding", "status", "found")


@query(
    "joi29_version_overlay",
    """WITH e AS (SELECT event_id, user_id, event_type AS subject, value, CASE WHEN day(ts) <= 20 THEN 0 ELSE day(ts) - 20 END AS version FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, subject ORDER BY version DESC, event_id DESC) AS rn FROM e WHERE version <= 5),
    t AS (SELECT DISTINCT subject FROM e WHERE version BETWEEN 1 AND 5 AND value > 80)
    SELECT user_id, r.subject, event_id, version, (t.subject IS NOT NULL)::INT AS to_review FROM r LEFT JOIN t USING (subject) WHERE rn = 1""",
)
def version_overlay(t: Tables) -> DataFrame:
    day = F.dayofmonth("ts")
    rows = t.events.select(
        F.struct("user_id", "event_type").alias("key"), F.col("event_type").alias("subject"), "event_id", "value", "user_id",
        F.when(day <= 20, 0).otherwise(day - 20).alias("version"),
    )
    # one row per key and version before the overlay
    newest = rows.groupBy("key", "subject", "user_id", "version").agg(F.max("event_id").alias("event_id"))
    flags = rows.where((F.col("version") > 0) & (F.col("value") > 80)).select("subject", "version")
    out = reshape.version_overlay(newest.where("version = 0").drop("version"), newest.where("version > 0"), "key", 5, flags)
    return out.select("user_id", "subject", "event_id", "version", "to_review")


@query(
    "joi35_model_assembly",
    """WITH d AS (SELECT doc_id, source, lang FROM documents), s AS (SELECT DISTINCT source FROM documents WHERE source NOT IN ('src3', 'src7')),
    a AS (SELECT doc_id, quality FROM labels)
    SELECT d.source, (s.source IS NULL)::INT AS synthesised, count(*) AS passages, count(*) FILTER (lang = 'es') AS noise, count(a.doc_id) AS answered,
      string_agg(DISTINCT lang, ',' ORDER BY lang) AS subjects FROM d LEFT JOIN s ON s.source = d.source LEFT JOIN a ON a.doc_id = d.doc_id GROUP BY ALL""",
)
def model_assembly(t: Tables) -> DataFrame:
    """Passages with their source row (made up when missing), noise flag, answers, and source-subject links."""
    passages = t.documents.select("doc_id", "source", "lang")
    known = passages.where(~F.col("source").isin("src3", "src7")).select("source").distinct().withColumn("synthesised", F.lit(0))
    missing = passages.select("source").distinct().join(known, "source", "left_anti").withColumn("synthesised", F.lit(1))
    answered = passages.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    stats = answered.groupBy("source").agg(
        F.count(F.lit(1)).alias("passages"), F.count_if(F.col("lang") == "es").alias("noise"), F.count("quality").alias("answered"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("subjects"),
    )
    return stats.join(known.unionByName(missing), "source")
