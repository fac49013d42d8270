"""Source and sink queries. Files are written from the tables into the shared scratch folder first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions import text
from ravelin.operators import fairness as fair
from ravelin.plans import fragments as fr
from ravelin.plans.registry import query
from ravelin.sources import files, runs
from ravelin.sources.tables import Tables

CUSTOMER = T.StructType(
    [
        T.StructField("c_code", T.StringType()), T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    ]
)


def _customer_csv(t: Tables) -> str:
    path = files.scratch(t.spark, "customer-csv")
    rows = t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("c_code"), "c_name", "c_nationkey", "c_acctbal")
    rows.write.option("header", True).csv(path)
    return path


@query("src01_typed_csv_scan",
       "SELECT lpad(c_custkey::VARCHAR, 8, '0') AS c_code, c_nationkey, c_acctbal FROM customer")
def typed_csv(t: Tables) -> DataFrame:
    return files.scan_csv(t.spark, _customer_csv(t), CUSTOMER).select("c_code", "c_nationkey", "c_acctbal")


@query("src02_csv_scan_with_header_check",
       "SELECT count(*) AS n, count(DISTINCT c_name) AS names, round(sum(c_acctbal), 2) AS balance FROM customer")
def checked_csv(t: Tables) -> DataFrame:
    rows = files.load_checked(t.spark, _customer_csv(t), CUSTOMER)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_name").alias("names"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(
    "src03_rule_tables_as_lookup",
    f"""SELECT o_orderkey, rule_pct FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey LEFT JOIN {fr.rule_values_sql()}
    ON v.target_year = year(o_orderdate) AND v.regime = CASE WHEN r_name = '{fr.GUIDELINE_PROVINCE}' THEN 'guideline' ELSE 'reference_rate' END""",
)
def rule_lookup(t: Tables) -> DataFrame:
    path = files.scratch(t.spark, "rules-csv")
    fr.rules(t).write.option("header", True).csv(path)
    rules = files.scan_csv(t.spark, path, "regime string, target_year long, rule_pct double")
    places = fr.customers_with_region(t).select("c_custkey", "r_name")
    rows = t.orders.join(places, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.year("o_orderdate").cast("long").alias("target_year"),
        F.when(F.col("r_name") == fr.GUIDELINE_PROVINCE, "guideline").otherwise("reference_rate").alias("regime"),
    )
    return rows.join(F.broadcast(rules), ["regime", "target_year"], "left").select("o_orderkey", "rule_pct")


@query("src04_series_scan_few_columns",
       "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, value FROM events WHERE event_type IN ('view', 'purchase')")
def series_scan(t: Tables) -> DataFrame:
    path = files.scratch(t.spark, "events-csv")
    t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value", "user_id").write.option("header", True).csv(path)
    rows = files.scan_csv(t.spark, path, "event_id long, day string, event_type string, value double, user_id long")
    return files.scan_series(rows, ["view", "purchase"], "event_type", ["event_type", "day", "value"])


def _cells(t: Tables) -> DataFrame:
    """Cell grid per region: a header row holding Total, one row per nation, values and marks to its right."""
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    cell = lambda col, body: F.struct(col.cast("int").alias("col"), body.alias("text"))
    head = F.col("r_regionkey") + 2
    total = F.col("r_regionkey") % 2 + 3
    key = F.col("n_nationkey")
    value = lambda k: F.when((key + k) % 4 == 0, "**").otherwise((key * 1.5 + k).cast("string"))
    line = F.array(
        cell(F.lit(0), F.concat(F.lit(" "), "n_name")), cell(total, value(0)), cell(total + 1, F.lit("a")),
        cell(total + 2, value(1)), cell(total + 3, F.lit("b")), cell(F.lit(1), F.lit("Total partiel")),
    )
    rows = places.select(F.col("r_name").alias("sheet"), (head + 1 + key).alias("row"), F.explode(line).alias("c"))
    heads = t.region.select(
        F.col("r_name").alias("sheet"), head.alias("row"), F.explode(F.array(cell(total, F.lit("Total")), cell(F.lit(0), F.lit("Pays")))).alias("c")
    )
    return rows.unionByName(heads).select("sheet", "row", "c.col", "c.text")


@query(
    "src05_cell_grid_unpivot",
    """WITH y AS (SELECT unnest([2023, 2024]) AS year, unnest([0, 1]) AS k)
    SELECT r_name AS sheet, n_name AS name, year, CASE WHEN (n_nationkey + k) % 4 <> 0 THEN (n_nationkey * 1.5 + k)::DOUBLE END AS value,
      CASE WHEN (n_nationkey + k) % 4 = 0 THEN '**' WHEN k = 0 THEN 'a' ELSE 'b' END AS note
    FROM nation JOIN region ON n_regionkey = r_regionkey, y""",
)
def cell_grid(t: Tables) -> DataFrame:
    return files.read_cells(_cells(t), "Total", {2023: 0, 2024: 2}, 1)


FOLDERS = {"en": "email", "fr": "contract", "de": "meeting"}
EXTENSIONS = {".png": "image", ".csv": "csv"}


@query(
    "src06_file_inventory",
    r"""WITH p AS (SELECT page_id, split_part(regexp_replace(url, '^https?://[^/]+/', ''), '?', 1) AS a FROM pages),
    q AS (SELECT page_id, split_part(a, '#', 1) AS path FROM p),
    r AS (SELECT page_id, path || CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.CSV' ELSE '.txt' END AS path,
      CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS folder, regexp_extract(path, '([^/]*)$', 1) AS stem FROM q)
    SELECT page_id, CASE WHEN regexp_matches(stem, '^[EM]\d{2}_') THEN substr(stem, 1, 3) ELSE stem END AS source_id,
      CASE WHEN page_id % 5 = 0 THEN 'image' WHEN page_id % 5 = 1 THEN 'csv' WHEN folder = 'en' THEN 'email'
        WHEN folder = 'fr' THEN 'contract' WHEN folder = 'de' THEN 'meeting' ELSE 'archive' END AS kind FROM r""",
)
def inventory(t: Tables) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+/", ""), "[?#].*$", "")
    ending = F.when(F.col("page_id") % 5 == 0, ".png").when(F.col("page_id") % 5 == 1, ".CSV").otherwise(".txt")
    path = F.concat(bare, ending)
    return t.pages.select("page_id", files.source_id(path).alias("source_id"), files.file_kind(path, FOLDERS, EXTENSIONS).alias("kind"))


@query(
    "src06_inventory_of_written_files",
    r"""WITH p AS (SELECT page_id, html, ['en', 'fr', 'de', 'other', ''][(page_id % 5 + 1)::INT] AS folder,
      CASE page_id % 4 WHEN 0 THEN 'E' || lpad((page_id % 100)::VARCHAR, 2, '0') || '_mail' WHEN 1 THEN 'INV-' ELSE 'page' END || '-' || page_id AS stem,
      ['.txt', '.png', '.CSV'][(page_id % 3 + 1)::INT] AS ending FROM pages)
    SELECT CASE WHEN folder = '' THEN '' ELSE folder || '/deep/' END || stem || ending AS path, coalesce(strlen(html), 0) AS bytes,
      CASE WHEN page_id % 4 = 0 THEN substr(stem, 1, 3) ELSE stem END AS source_id,
      CASE ending WHEN '.png' THEN 'image' WHEN '.CSV' THEN 'csv' ELSE CASE folder WHEN 'en' THEN 'email' WHEN 'fr' THEN CASE WHEN page_id % 4 = 1 THEN 'invoice' ELSE 'contract' END
        WHEN 'de' THEN 'meeting' ELSE 'archive' END END AS kind FROM p""",
)
def written_inventory(t: Tables) -> DataFrame:
    """Pages written as files below folders, beside files that are left out, then listed."""
    n = F.col("page_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    folder = pick(["en/deep/", "fr/deep/", "de/deep/", "other/deep/", ""])
    stem = F.when(n % 4 == 0, F.concat(F.lit("E"), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("_mail"))).when(n % 4 == 1, "INV-").otherwise("page")
    path = F.concat(folder, stem, F.lit("-"), n.cast("string"), pick([".txt", ".png", ".CSV"]))
    root = files.scratch(t.spark, "inventory")
    runs.write_files(t.pages.select(path.alias("path"), "html"), root, "path", "html")
    runs.write_files(t.region.select(F.concat(F.lit("en/"), "r_name", F.lit("/manifest.csv")).alias("path"), "r_name"), root, "path", "r_name")
    return runs.inventory(t.spark, root, FOLDERS, EXTENSIONS, ["manifest.csv"])


@query("src07_json_lines_round_trip",
       "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def jsonl(t: Tables) -> DataFrame:
    path = files.scratch(t.spark, "conversations-jsonl")
    files.write_jsonl(t.conversations, path)
    return files.read_jsonl(t.spark, path, "conv_id long, turn long, role string, text string").select(
        "conv_id", "turn", "role", F.md5("text").alias("digest")
    )


@query(
    "src08_nested_result_json",
    """WITH g AS (SELECT n_name, o_orderstatus, count(*) AS n, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS urgent FROM orders
      JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
    k AS (SELECT n_name, string_agg('{"status":"' || o_orderstatus || '","n":' || n || ',"urgent":' || CASE WHEN n >= 200 AND urgent IS NOT NULL
      THEN round(urgent / 1000)::BIGINT::VARCHAR ELSE 'null' END || '}', ',' ORDER BY o_orderstatus) AS body FROM g GROUP BY 1)
    SELECT n_name, '{"nation":"' || n_name || '","rows":[' || body || ']}' AS result FROM k""",
)
def nested_results(t: Tables) -> DataFrame:
    names = fr.customers_with_region(t).select("c_custkey", "n_name")
    rows = t.orders.join(names, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("urgent")
    )
    value = F.when(F.col("n") >= 200, files.clean_number(F.col("urgent") / 1000, 0).cast("long"))
    # one entry per status: a short list
    lists = rows.select("n_name", F.struct(F.col("o_orderstatus").alias("status"), "n", value.alias("urgent")).alias("e")).groupBy("n_name").agg(
        F.array_sort(F.collect_list("e")).alias("rows")
    )
    out = F.to_json(F.struct(F.col("n_name").alias("nation"), "rows"), {"ignoreNullFields": "false"})
    return lists.select("n_name", out.alias("result"))


@query(
    "src09_decisions_written_and_validated",
    """SELECT count(*) AS n, round_even(0.4 * count(*), 0)::BIGINT AS selected, 1 AS rows_ok, (count(*) = count(DISTINCT c_custkey))::INT AS ids_unique,
      1 AS binary, 1 AS total_ok, (round_even(0.4 * count(*), 0) / count(*) BETWEEN 0.38 AND 0.42)::INT AS rate_ok FROM customer""",
)
def decisions(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("id"), "c_acctbal")
    chosen = fair.select_top(rows, "c_acctbal", 0.4, "id", "decision")
    path = files.scratch(t.spark, "decisions-csv")
    files.write_decisions(chosen, path, ["id", "decision"], "id")
    again = files.scan_csv(t.spark, path, "id long, decision int")
    n = rows.count()
    return files.validate_decisions(again, "id", "decision", n, round(0.4 * n), (0.38, 0.42))


@query(
    "src10_strict_annex_export",
    """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS own,
      (SELECT 1) AS one FROM orders),
    f AS (SELECT DISTINCT l_orderkey AS o_orderkey, TRUE AS has FROM lineitem),
    j AS (SELECT o.*, coalesce(own, CASE WHEN has THEN 'sheet' END) AS sheet FROM o LEFT JOIN f USING (o_orderkey))
    SELECT o_orderkey AS item_id, sheet, k::INT AS n_bars, CASE WHEN k = 0 THEN '' ELSE (SELECT string_agg(i || '-20M', ',' ORDER BY i) FROM range(1, k + 1) r(i)) END AS bars
    FROM j WHERE sheet IS NOT NULL""",
)
def annex(t: Tables) -> DataFrame:
    bar = lambda i: F.struct(F.lit("20M").alias("size"), i.cast("int").alias("qty"), F.lit("x").alias("extra"))
    k = (F.col("o_orderkey") % 4).cast("int")
    numbers = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    items = t.orders.select(
        F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("sheet"),
        F.transform(numbers, bar).alias("bars"),
    )
    findings = t.lineitem.select(F.col("l_orderkey").alias("item_id"), F.lit("sheet").alias("sheet"))
    valid, _ = files.to_annex(items, findings, ["item_id", "sheet"], ["size", "qty"])
    label = F.array_join(F.transform("bars", lambda b: F.concat(b["qty"].cast("string"), F.lit("-"), b["size"])), ",")
    return valid.select("item_id", "sheet", F.size("bars").alias("n_bars"), label.alias("bars"))


@query(
    "src10_annex_counts",
    """WITH o AS (SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem) AS ok FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 3 = 0)
    SELECT 'valid' AS kind, count(*) FILTER (ok) AS n FROM o UNION ALL SELECT 'invalid', count(*) FILTER (NOT ok) FROM o""",
)
def annex_counts(t: Tables) -> DataFrame:
    """How many records the export keeps and drops; some items have no finding here, so some are dropped."""
    k = F.col("o_orderkey")
    rows = t.orders.where((k % 7 != 0) | (k % 3 == 0))
    items = rows.select(k.alias("item_id"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("sheet"), F.array(F.struct(F.lit("20M").alias("size"), F.lit(1).alias("qty"))).alias("bars"))
    findings = t.lineitem.select(F.col("l_orderkey").alias("item_id"), F.lit("sheet").alias("sheet"))
    run = runs.Run(t.spark)
    valid, invalid = files.to_annex(items, findings, ["item_id", "sheet"], ["size", "qty"])
    run.output("valid", valid, files.scratch(t.spark, "annex"))
    run.output("invalid", invalid, files.scratch(t.spark, "annex-invalid"))
    return run.manifest().where("metric = 'rows'").select(F.col("name").alias("kind"), F.col("value").cast("long").alias("n"))


@query(
    "src11_manifest_of_a_run",
    r"""WITH d AS (SELECT * FROM documents), f AS (SELECT d.*, l.quality, n_chars > 400 AS said FROM d JOIN labels l USING (doc_id) WHERE length(trim(text)) > 0),
    m AS (SELECT 'input' AS section, 'documents' AS name, 'rows' AS metric, count(*)::DOUBLE AS value FROM d UNION ALL SELECT 'input', 'documents', 'bytes', sum(strlen(text))::DOUBLE FROM d
      UNION ALL SELECT 'input', 'documents', 'digest', sum(('0x' || left(md5(text), 8))::BIGINT)::DOUBLE FROM d
      UNION ALL SELECT 'stage', 'with text', 'rows', count(*)::DOUBLE FROM d WHERE length(trim(text)) > 0 UNION ALL SELECT 'stage', 'labelled', 'rows', count(*)::DOUBLE FROM f
      UNION ALL SELECT 'stage', 'labelled', 'good', sum(quality)::DOUBLE FROM f UNION ALL SELECT 'output', 'findings', 'rows', count(*)::DOUBLE FROM f WHERE said
      UNION ALL SELECT 'evaluation', 'all', 'recall', round(sum((said AND quality = 1)::INT) / sum(quality), 6) FROM f
      UNION ALL SELECT 'evaluation', 'all', 'precision', round(sum((said AND quality = 1)::INT) / sum(said::INT), 6) FROM f)
    SELECT * FROM m""",
)
def manifest_of_a_run(t: Tables) -> DataFrame:
    """One run from documents to written findings; sizes of the written files are in the manifest, but not in this comparison."""
    run = runs.Run(t.spark)
    docs = run.stage("with text", run.input("documents", t.spark.read.parquet(t.path("documents")), "text").where(F.length(F.trim("text")) > 0))
    labelled = run.stage("labelled", docs.join(t.labels.select("doc_id", "quality"), "doc_id"), good=F.sum("quality"))
    path = files.scratch(t.spark, "findings")
    run.output("findings", labelled.where(F.col("n_chars") > 400).select("doc_id", "quality"), path)
    found = files.read_jsonl(t.spark, path, "doc_id long, quality int").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good")).first()
    good = dict((r["metric"], r["value"]) for r in run.manifest().where("name = 'labelled'").collect())["good"]
    run.evaluation(recall=round((found["good"] or 0) / good, 6), precision=round((found["good"] or 0) / found["n"], 6))
    return run.manifest().where("NOT (section = 'output' AND metric = 'bytes')")


@query(
    "src11_run_manifest",
    """SELECT lang, source, count(*) AS pages, sum(strlen(text))::BIGINT AS bytes, sum((length(trim(text)) > 0)::INT)::BIGINT AS with_text, min(sha256(text)) AS first_sha
    FROM documents GROUP BY ROLLUP (lang, source)""",
)
def manifest(t: Tables) -> DataFrame:
    return files.run_manifest(t.documents, ["lang", "source"], "text")


@query(
    "src12_attachment_registry",
    r"""WITH d AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h,
      sha256(lower(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')))) AS f FROM documents),
    a AS (SELECT doc_id AS container, 'whole' AS name, h AS sha256 FROM d UNION ALL SELECT doc_id, 'first line', f FROM d),
    k AS (SELECT h AS sha256, min(doc_id) AS same_as FROM d GROUP BY 1)
    SELECT container, name, same_as FROM a LEFT JOIN k USING (sha256)""",
)
def attachment_registry(t: Tables) -> DataFrame:
    whole, first = text.content_hash(F.col("text")), text.content_hash(F.get(F.split("text", "\n"), 0))
    part = lambda name, h: F.struct(F.lit(name).alias("name"), h.alias("sha256"))
    containers = t.documents.select(F.col("doc_id").alias("container"), F.array(part("whole", whole), part("first line", first)).alias("attachments"))
    registry = t.documents.select(F.col("doc_id").alias("id"), whole.alias("sha256"))
    return files.attachments(containers, registry).select("container", "name", "same_as")


@query(
    "src13_truth_table_by_header_prefix",
    """SELECT 'D' || doc_id AS sheet, doc_id AS location, (quality <> toxic)::INT AS gap_expected FROM labels""",
)
def truth_table(t: Tables) -> DataFrame:
    table = t.labels.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("Feuillet no"), F.col("doc_id").alias("Localisation (axe)"),
        F.concat(F.lit("va leur "), F.col("quality").cast("string")).alias("Plan"), F.concat(F.lit("VALEUR "), F.col("toxic").cast("string")).alias("Dessin atelier"),
    )
    picked = files.pick_by_prefix(table, {"FEUILLET": "sheet", "LOCALISATION": "location", "PLAN": "plan", "DESSIN": "shop"})
    return picked.select("sheet", "location", (files.compact(F.col("plan")) != files.compact(F.col("shop"))).cast("int").alias("gap_expected"))


@query(
    "src14_latest_run_and_merge",
    """WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
    n AS (SELECT o_custkey, o_orderkey, 0.0::DOUBLE AS o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT o_custkey, o_orderkey, o_totalprice FROM l WHERE rn = 1 AND o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT * FROM n""",
)
def latest_and_merge(t: Tables) -> DataFrame:
    cols = ["o_custkey", "o_orderkey", "o_totalprice"]
    old = files.latest_run(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select(*cols)
    urgent = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    new = files.latest_run(urgent, "o_custkey", ["o_orderdate", "o_orderkey"]).withColumn("o_totalprice", F.lit(0.0)).select(*cols)
    return files.merge_runs(old, new, ["o_custkey"])


@query(
    "src15_summary_fallback",
    """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(n, 0) ELSE 7 END AS total FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def summary_fallback(t: Tables) -> DataFrame:
    stored = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.lit(7).cast("long")).alias("total"))
    return files.ensure_summary(stored, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "total")
