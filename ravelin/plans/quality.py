"""Data-quality and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators import quality as dq
from ravelin.plans import fragments as fr
from ravelin.plans.registry import query
from ravelin.sources.tables import Tables

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "dq01_schema_battery",
    r"""SELECT 'no nulls' AS rule, sum((c_custkey IS NULL OR c_name IS NULL OR c_acctbal IS NULL)::INT)::BIGINT AS failures FROM customer
    UNION ALL SELECT 'name pattern', sum((NOT regexp_full_match(c_name, 'Customer#\d{9}'))::INT)::BIGINT FROM customer
    UNION ALL SELECT 'known segment', sum((c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))::INT)::BIGINT FROM customer
    UNION ALL SELECT 'balance in range', sum((NOT c_acctbal BETWEEN 0 AND 5000)::INT)::BIGINT FROM customer
    UNION ALL SELECT 'c_custkey unique', count(*) - count(DISTINCT c_custkey) FROM customer
    UNION ALL SELECT 'c_mktsegment unique', count(*) - count(DISTINCT c_mktsegment) FROM customer""",
)
def battery(t: Tables) -> DataFrame:
    rules = {
        "no nulls": F.col("c_custkey").isNotNull() & F.col("c_name").isNotNull() & F.col("c_acctbal").isNotNull(),
        "name pattern": F.col("c_name").rlike(r"^Customer#\d{9}$"), "known segment": F.col("c_mktsegment").isin(SEGMENTS),
        "balance in range": F.col("c_acctbal").between(0, 5000),
    }
    return dq.check_battery(t.customer, rules, ["c_custkey", "c_mktsegment"])


_COLUMNS = {
    "documents": ["doc_id", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"],
    "orders": ["o_orderkey", "o_orderstatus", "o_orderpriority"],
}


def _constants_sql() -> str:
    parts = []
    for table, columns in _COLUMNS.items():
        for c in [*columns, "flag", "empty"]:
            parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name FROM (SELECT *, 'x' AS flag, NULL AS empty FROM {table}) HAVING "
                         f"(count({c}) = count(*) AND count(DISTINCT {c}) = 1) OR count({c}) = 0")
    return " UNION ALL ".join(parts)


@query("dq02_constant_columns", _constants_sql())
def constants(t: Tables) -> DataFrame:
    out = None
    for table, columns in _COLUMNS.items():
        rows = getattr(t, table).select(*columns, F.lit("x").alias("flag"), F.lit(None).cast("string").alias("empty"))
        found = dq.constant_columns(rows, table)
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "dq03_column_meaning_evidence",
    """SELECT 'price = quantity x unit' AS claim, round(avg((abs(l_extendedprice / l_quantity - p_retailprice) < 1000)::INT) * 100, 6) AS share_pct
      FROM lineitem JOIN part ON p_partkey = l_partkey
    UNION ALL SELECT 'returned is final', round(avg((l_returnflag <> 'R' OR l_linestatus = 'F')::INT) * 100, 6) FROM lineitem JOIN part ON p_partkey = l_partkey
    UNION ALL SELECT 'discount over tax', round(avg((l_discount > l_tax)::INT) * 100, 6) FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def evidence(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    claims = {
        "price = quantity x unit": F.abs(F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")) < 1000,
        "returned is final": (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F"),
        "discount over tax": F.col("l_discount") > F.col("l_tax"),
    }
    return dq.evidence(rows, claims).withColumn("share_pct", F.round("share_pct", 6))


@query(
    "dq05_functional_dependency",
    """SELECT 'customer nation -> region' AS rule, count(*) AS keys, sum((k > 1)::INT)::BIGINT AS violations FROM (SELECT n_name, count(DISTINCT r_name) AS k FROM customer
      JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1)
    UNION ALL SELECT 'nation -> segment', count(*), sum((k > 1)::INT)::BIGINT FROM (SELECT n_name, count(DISTINCT c_mktsegment) AS k FROM customer
      JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)""",
)
def dependency(t: Tables) -> DataFrame:
    rows = fr.customers_with_region(t)
    first = dq.functional_dependency(rows, "n_name", "r_name").withColumn("rule", F.lit("customer nation -> region"))
    return first.unionByName(dq.functional_dependency(rows, "n_name", "c_mktsegment").withColumn("rule", F.lit("nation -> segment")))


@query(
    "dq06_announced_values_reproduced",
    """WITH v AS (SELECT avg((o_orderstatus = 'F')::INT) AS share_f, count(*)::DOUBLE AS n FROM orders)
    SELECT 'share_f' AS name, (abs(share_f - 0.33) <= pow(10.0, -2))::INT AS matches FROM v
    UNION ALL SELECT 'n', (abs(n - 15000) <= pow(10.0, 0))::INT FROM v UNION ALL SELECT 'absent', 0 FROM v""",
)
def announced(t: Tables) -> DataFrame:
    one = t.orders.agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share_f"), F.count(F.lit(1)).cast("double").alias("n"))
    values = one.unpivot([], ["share_f", "n"], "name", "value")
    said = t.spark.createDataFrame([("share_f", 0.33, 2), ("n", 15000.0, 0), ("absent", 1.0, 0)], "name string, expected double, digits int")
    return dq.matches_announced(values, said)


@query(
    "joi06_id_disjointness",
    """SELECT count(DISTINCT c_custkey) AS shared FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2500)
    UNION ALL SELECT count(DISTINCT c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""",
)
def disjointness(t: Tables) -> DataFrame:
    building = t.customer.where("c_mktsegment = 'BUILDING'")
    overlap = dq.disjoint(building, t.customer.where("c_acctbal > 2500"), "c_custkey")
    return overlap.unionByName(dq.disjoint(building, t.customer.where("c_mktsegment <> 'BUILDING'"), "c_custkey"))


@query(
    "joi07_inventory_discrepancies",
    """WITH m AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN n_chars + 1 ELSE n_chars END AS n FROM documents WHERE source <> 'src3'),
    f AS (SELECT doc_id, n_chars AS n FROM documents WHERE source <> 'src5')
    SELECT coalesce(m.doc_id, f.doc_id) AS doc_id, m.n AS expected, f.n AS found,
      CASE WHEN f.n IS NULL THEN 'missing' WHEN m.n IS NULL THEN 'extra' ELSE 'size mismatch' END AS problem
    FROM m FULL JOIN f ON m.doc_id = f.doc_id WHERE m.n IS DISTINCT FROM f.n""",
)
def inventory_discrepancies(t: Tables) -> DataFrame:
    said = t.documents.where("source <> 'src3'").select(
        "doc_id", F.when(F.col("lang") == "fr", F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n")
    )
    found = t.documents.where("source <> 'src5'").select("doc_id", F.col("n_chars").alias("n"))
    return dq.discrepancies(said, found, "doc_id", "n")


@query(
    "set01_stack_with_relabelled_columns",
    """SELECT 'customer' AS side, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""",
)
def stack(t: Tables) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("side"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("side"))
    return a.unionByName(b)


@query(
    "set02_missing_and_extra_keys",
    """SELECT 'no urgent order' AS side, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    UNION ALL SELECT 'unknown part key', k FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'SMALL'))""",
)
def missing_and_extra(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    a = t.customer.select(F.lit("no urgent order").alias("side"), F.col("c_custkey").alias("id")).join(urgent, "id", "left_anti")
    parts = t.part.where("p_type <> 'SMALL'").select(F.col("p_partkey").alias("id"))
    b = t.lineitem.select(F.col("l_partkey").alias("id")).join(parts, "id", "left_anti").distinct().withColumn("side", F.lit("unknown part key"))
    return a.unionByName(b)


@query(
    "set04_order_preserving_distinct",
    """WITH f AS (SELECT l_partkey, l_suppkey, min(l_shipdate) AS first FROM lineitem GROUP BY ALL)
    SELECT l_partkey, l_suppkey, strftime(first, '%Y-%m-%d') AS first_day FROM f""",
)
def distinct_keep_first(t: Tables) -> DataFrame:
    """First row of each (part, supplier) by ship date: a map-side minimum, not a sort of the group."""
    first = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min("l_shipdate").alias("first"))
    return first.select("l_partkey", "l_suppkey", F.date_format("first", "yyyy-MM-dd").alias("first_day"))


@query(
    "set05_items_touched_by_subjects",
    """WITH s AS (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')), n AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (SELECT * FROM s))
    SELECT 'nation' AS kind, n_nationkey::BIGINT AS id FROM n UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)
    UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)
    UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n))""",
)
def touched(t: Tables) -> DataFrame:
    subjects = t.region.where(F.col("r_name").isin("ASIA", "EUROPE"))
    nations = t.nation.join(subjects, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customers = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    suppliers = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    orders = t.orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    item = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"))
    return (
        item(nations, "nation", "n_nationkey").unionByName(item(customers, "customer", "c_custkey"))
        .unionByName(item(suppliers, "supplier", "s_suppkey")).unionByName(item(orders, "order", "o_orderkey"))
    )
