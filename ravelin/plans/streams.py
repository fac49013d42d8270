"""Streaming and plug-in queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import bars, plugins
from ravelin.operators import corpus
from ravelin.operators.ordering import top_per_key
from ravelin.plans import corpus as bound
from ravelin.plans.registry import query
from ravelin.plans.text import REFERENCES_SQL, with_references
from ravelin.sources.files import scratch
from ravelin.sources.tables import Tables
from ravelin.streaming import events, incremental, lots

EVENT_GROUPS = [["src17", "src18"], [bound.NEW_SOURCE]]


def corpus_store(t: Tables) -> events.CorpusStore:
    """Documents as passages; copies are marked over everything stored so far."""

    def mark(rows: DataFrame) -> DataFrame:
        base = rows.drop("duplicate_of")
        return base.join(corpus.text_copies(base), "id", "left")

    strongest = lambda rows: bound.with_entities(corpus.strongest_per_source(corpus.pair_statements(rows)))
    return events.CorpusStore(t.spark, scratch(t.spark, "corpus"), mark, strongest, bound.judged)


def run_corpus(t: Tables) -> events.CorpusStore:
    """The corpus arrives in a folder as a base and two events, each run taking the files that wait."""
    folder, state = scratch(t.spark, "inbox"), scratch(t.spark, "inbox-state")
    rows = bound.passage_rows(t)
    late = [s for group in EVENT_GROUPS for s in group]
    steps = [rows.where(~F.col("source_id").isin(late))] + [rows.where(F.col("source_id").isin(g)) for g in EVENT_GROUPS]
    store = corpus_store(t)
    for part in steps:
        part.write.mode("append").parquet(folder)
        events.run_events(store, folder, rows.schema, state)
    return store


def _events_sql(changed: str = "::INT") -> str:
    """Diffs of the two events; a pair judged by an earlier step stays as it was judged."""
    steps = ["source NOT IN ('src17', 'src18', 'src19')", "source <> 'src19'", "TRUE"]
    parts = []
    for k, where in enumerate(steps):
        parts += [bound.statements_sql(where, f"st{k}"), bound.pairs_sql(f"st{k}", f"_n{k}")]
        stay = f"SELECT * FROM pairs_n{k}" if not k else f"SELECT * FROM pairs_{k - 1} UNION ALL SELECT * FROM pairs_n{k} WHERE (a, b) NOT IN (SELECT (a, b) FROM pairs_{k - 1})"
        parts += [f"pairs_{k} AS ({stay})", bound.guards_sql(f"st{k}", f"_{k}"), bound.snapshot_sql(f"st{k}", f"_{k}")]
    counts = incremental.COUNTS
    moved = " OR ".join(f"n.{c} <> coalesce(o.{c}, 0)" for c in counts)
    deltas = ", ".join(f"n.{c} - coalesce(o.{c}, 0) AS d_{c}" for c in counts)
    diffs = [
        f"""SELECT {k} AS version, n.subject, o.current_id AS current_v1, n.current_id AS current_v2, (o.current_id IS DISTINCT FROM n.current_id){changed} AS current_changed, {deltas}
        FROM snap_{k} n LEFT JOIN snap_{k - 1} o USING (subject) WHERE o.current_id IS DISTINCT FROM n.current_id OR {moved}"""
        for k in (1, 2)
    ]
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(diffs)}"


@query("str01_new_file_events", _events_sql(""))
def new_files(t: Tables) -> DataFrame:
    """Changed subjects after each event."""
    diffs = f"{run_corpus(t).root}/diffs"
    return t.spark.read.option("basePath", diffs).parquet(diffs)


def decided_rows(t: Tables) -> DataFrame:
    """Decided passages without their texts, with the entities that their texts name."""
    rows = bound.passage_rows(t).withColumn("n_text", F.length("text"))
    return bound.with_entities(rows).withColumn("authority", F.col("authority").cast("double"))


def run_incremental(t: Tables) -> incremental.IncrementalCorpus:
    """Base and two events, each run taking the files that wait, with work in proportion to them."""
    folder, state = scratch(t.spark, "inbox"), scratch(t.spark, "inbox-state")
    rows = decided_rows(t)
    late = [s for group in EVENT_GROUPS for s in group]
    steps = [rows.where(~F.col("source_id").isin(late))] + [rows.where(F.col("source_id").isin(g)) for g in EVENT_GROUPS]
    store = incremental.IncrementalCorpus(t.spark, scratch(t.spark, "incremental"), bound.judged, buckets=16)
    for part in steps:
        part.write.mode("append").parquet(folder)
        events.run_files(t.spark, store.on_event, folder, rows.schema, state)
    return store


@query("str01_incremental_events", _events_sql())
def incremental_events(t: Tables) -> DataFrame:
    """Changed subjects after each event, from stored indexes and the new rows only."""
    return run_incremental(t).diffs().where("version > 0").withColumn("current_changed", F.col("current_changed").cast("int"))


@query(
    "str02_as_of_of_a_batch",
    """SELECT event_type, coalesce(CASE WHEN event_type = 'signup' THEN '2024-02-15' END, strftime(max(ts), '%Y-%m-%d')) AS as_of FROM events GROUP BY event_type""",
)
def as_of(t: Tables) -> DataFrame:
    plain = t.events.where("event_type <> 'signup'").groupBy("event_type").agg(events.event_as_of(F.col("ts")).alias("as_of"))
    given = t.events.where("event_type = 'signup'").groupBy("event_type").agg(events.event_as_of(F.col("ts"), "2024-02-15").alias("as_of"))
    return plain.unionByName(given)


def _measure(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.size(F.split("text", r"\s+")))


@query(
    "str03_decision_cache",
    r"""WITH d AS (SELECT doc_id, source, lang || chr(0) || text AS k FROM documents), c AS (SELECT DISTINCT k FROM d WHERE source <> 'src19')
    SELECT 'first' AS run, count(*) AS misses FROM c UNION ALL SELECT 'second', count(DISTINCT d.k) FROM d WHERE k NOT IN (SELECT k FROM c)
    UNION ALL SELECT 'answered', count(*) FROM d""",
)
def decision_cache(t: Tables) -> DataFrame:
    cache = scratch(t.spark, "cache")
    rows = t.documents.select("doc_id", "source", "lang", "text")
    _, first = events.cached_apply(rows.where(F.col("source") != "src19"), cache, ["lang", "text"], _measure)
    everything, second = events.cached_apply(rows, cache, ["lang", "text"], _measure)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("misses")).select(F.lit(name).alias("run"), "misses")
    return count(first, "first").unionByName(count(second, "second")).unionByName(count(everything.where("value IS NOT NULL"), "answered"))


@query(
    "str04_compute_once_per_text",
    r"SELECT doc_id, lang, len(string_split_regex(text, '\s+')) AS value FROM documents",
)
def once_per_text(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "text")
    return events.dedup_apply(rows, ["lang", "text"], _measure).select("doc_id", "lang", F.col("value").cast("long").alias("value"))


@query(
    "str05_checked_lots_on_a_stream",
    """SELECT strftime(ts, '%Y-%m-%d') AS lot, event_type, count(*) AS n, round(sum(value), 2) AS total, (sum(value) / count(*) BETWEEN 40 AND 60)::INT AS published FROM events GROUP BY ALL""",
)
def checked_lots(t: Tables) -> DataFrame:
    out, state = scratch(t.spark, "lots"), scratch(t.spark, "lots-state")
    schema = t.events.schema
    events.monitor_stream(t.spark, t.root, "events.parquet", schema, out, state, "ts", "1 day", "2 hours", 40.0, 60.0)
    # every batch that touched a lot wrote it again; the last one counts
    rows = top_per_key(t.spark.read.parquet(out), ["lot", "event_type"], [F.desc("batch")])
    return rows.select(F.date_format("lot.start", "yyyy-MM-dd").alias("lot"), "event_type", "n", F.round("total", 2).alias("total"), "published")


# Arrival of the events in six files: five days each, some rows one file late, some two files late.
ARRIVALS = 6
ARRIVAL_SQL = """floor(datediff('day', DATE '2024-01-01', ts::DATE) / 5)::INT + CASE WHEN event_id % 40 = 3 THEN 1 WHEN event_id % 40 = 5 THEN 2 ELSE 0 END"""
LOTS = lots.LotRules("ts", "1 day", "2 days", "event_type", 48.0, 52.0)
# Watermark of a batch: latest time of the files before it, less the delay. A lot closes in the first batch whose watermark has passed its end.
LOTS_SQL = f"""WITH e AS (SELECT *, least({ARRIVAL_SQL}, {ARRIVALS - 1}) AS file, ts::DATE + INTERVAL 1 DAY AS lot_end FROM events),
    w AS (SELECT k.batch, (SELECT date_trunc('milliseconds', max(ts)) FROM e WHERE file < k.batch) - INTERVAL 2 DAY AS mark FROM (SELECT unnest(range({ARRIVALS})) AS batch) k),
    c AS (SELECT lot_end, min(batch) AS batch FROM (SELECT DISTINCT lot_end FROM e) JOIN w ON lot_end <= mark GROUP BY lot_end),
    r AS (SELECT e.*, c.batch, coalesce(c.batch < e.file, FALSE) AS late FROM e LEFT JOIN c USING (lot_end)),
    l AS (SELECT lot_end - INTERVAL 1 DAY AS lot, event_type, batch, count(*) AS n, round(sum(value), 2) AS total, (sum(value) / count(*) BETWEEN 48 AND 52)::INT AS published
      FROM r WHERE NOT late AND batch IS NOT NULL GROUP BY ALL)"""


def arriving_events(t: Tables) -> str:
    """Folder with the events in files, in the order of their arrival."""
    folder = scratch(t.spark, "arrivals")
    day = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 5)
    behind = F.when(F.col("event_id") % 40 == 3, 1).when(F.col("event_id") % 40 == 5, 2).otherwise(0)
    rows = t.events.withColumn("file", F.least(day + behind, F.lit(ARRIVALS - 1)).cast("int"))
    for file in range(ARRIVALS):
        rows.where(F.col("file") == file).drop("file").coalesce(1).write.mode("append").parquet(folder)
    return folder


def closed_lots(t: Tables) -> DataFrame:
    out = scratch(t.spark, "closed-lots")
    lots.publish_lots(t.spark, arriving_events(t), t.events.schema, out, scratch(t.spark, "closed-lots-state"), LOTS)
    return lots.read_batches(t.spark, out)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(F.date_format("lot.start", "yyyy-MM-dd").alias("lot"), "event_type", "batch", "n", F.round("total", 2).alias("total"), "published")


@query("str05_lots_closed_by_watermark", f"{LOTS_SQL} SELECT strftime(lot, '%Y-%m-%d') AS lot, event_type, batch, n, total, published FROM l")
def lots_closed_by_watermark(t: Tables) -> DataFrame:
    """Each lot once, in the batch that closed it, with the rows that came in time."""
    return _shown(closed_lots(t))


@query("str05_late_rows_side_table", f"{LOTS_SQL} SELECT event_id, event_type, file AS batch, strftime(lot_end - INTERVAL 1 DAY, '%Y-%m-%d') AS lot FROM r WHERE late")
def late_rows(t: Tables) -> DataFrame:
    out = scratch(t.spark, "late-rows")
    lots.route_late_rows(t.spark, arriving_events(t), t.events.schema, out, scratch(t.spark, "late-log"), scratch(t.spark, "late-state"), LOTS)
    return lots.read_batches(t.spark, out).select("event_id", "event_type", "batch", F.date_format("ts", "yyyy-MM-dd").alias("lot"))


@query(
    "str05_escalated_lots",
    f"""{LOTS_SQL}, p AS (SELECT *, lag(published) OVER o AS before, lag(lot) OVER o AS day_before FROM l WINDOW o AS (PARTITION BY event_type ORDER BY lot))
    SELECT strftime(lot, '%Y-%m-%d') AS lot, event_type, batch, n, total, published FROM p WHERE published = 0 AND before = 0 AND day_before + INTERVAL 1 DAY = lot""",
)
def escalated_lots(t: Tables) -> DataFrame:
    """Lots outside the band for the second time in a row."""
    return _shown(lots.escalations(closed_lots(t), "event_type"))


LEXICON_SQL = [f"regexp_extract_all(lower(body), '{p}')" for p in plugins.LEXICON.values()]


@query(
    "udf01_decision_engine_lexicon",
    f"""WITH b AS (SELECT doc_id, {REFERENCES_SQL} AS body FROM documents), c AS (SELECT doc_id, [{', '.join(f'len({x})' for x in LEXICON_SQL)}] AS n FROM b),
    w AS (SELECT doc_id, n, list_sum(n) AS total, list_position(list_transform(n, lambda x: x > 0), TRUE) AS first FROM c)
    SELECT doc_id, CASE WHEN total = 0 THEN 'noise' ELSE {list(plugins.LEXICON)}[first] END AS choice, round(CASE WHEN total = 0 THEN 1 ELSE list_max(n) / total END, 6) AS confidence FROM w""",
)
def lexicon(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", with_references(F.col("text"), F.col("doc_id")).alias("text"))
    out = plugins.ask(rows, identifier="doc_id")
    return out.select("doc_id", "answer.choice", F.round("answer.confidence", 6).alias("confidence"))


def _extractor(kind: str, plan: str, shop: str):
    def extract(df: DataFrame) -> DataFrame:
        rows = df.where(F.col("p_type").isin(plan, shop))
        side = F.when(F.col("p_type") == plan, "plan").otherwise("shop")
        label = F.concat(F.col("p_size").cast("string"), F.lit("-20M"))
        return rows.select("p_partkey", side.alias("side"), bars.parse_bars(label)[0]["qty"].alias("qty"))

    return extract


EXTRACTORS = {"beam": _extractor("beam", "ECONOMY", "SMALL"), "wall": _extractor("wall", "LARGE", "STANDARD"), "slab": _extractor("slab", "MEDIUM", "PROMO")}


@query(
    "udf03_extractor_registry",
    """SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 'plan' ELSE 'shop' END AS side, p_size AS qty,
      CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'beam' WHEN p_type IN ('LARGE', 'STANDARD') THEN 'wall' ELSE 'slab' END AS element_type FROM part""",
)
def extractors(t: Tables) -> DataFrame:
    return plugins.run_extractors(t.part, EXTRACTORS)


@query(
    "udf04_splitters_by_format",
    r"""WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'csv' WHEN 'de' THEN 'eml' ELSE 'bin' END AS fmt, string_split_regex(text, '\r?\n') AS ls, text FROM documents),
    e AS (SELECT doc_id, fmt, unnest(CASE fmt WHEN 'txt' THEN ls WHEN 'csv' THEN ls[2:] ELSE string_split_regex(text, '\n\s*\n') END) AS s,
      unnest(range(1, len(CASE fmt WHEN 'txt' THEN ls WHEN 'csv' THEN ls[2:] ELSE string_split_regex(text, '\n\s*\n') END) + 1)) AS i FROM d WHERE fmt <> 'bin')
    SELECT doc_id, fmt, CASE fmt WHEN 'txt' THEN 'L' WHEN 'csv' THEN 'R' ELSE 'b' END || i AS locator, md5(trim(s)) AS digest FROM e WHERE trim(s) <> ''""",
)
def splitters(t: Tables) -> DataFrame:
    fmt = F.when(F.col("lang") == "en", "txt").when(F.col("lang") == "fr", "csv").when(F.col("lang") == "de", "eml").otherwise("bin")
    rows = t.documents.select("doc_id", fmt.alias("fmt"), F.col("text").alias("raw"))
    return plugins.split_by_format(rows, "fmt", "raw").select("doc_id", "fmt", "locator", F.md5("text").alias("digest"))


def word_client(texts: list[str]) -> list[str]:
    """Stand-in for a remote service: first and last word, no JSON for texts of odd length."""
    return ["?" if len(x) % 2 else json.dumps([x.split()[0], x.split()[-1]] + (["zzz-absent"] if len(x) % 3 == 0 else [])) for x in texts]


@query(
    "udf05_batched_calls_with_checks",
    """WITH d AS (SELECT doc_id, length(text) % 2 = 1 AS odd, length(text) % 3 = 0 AS loose FROM documents WHERE length(trim(text)) > 0)
    SELECT count(*) AS n, sum((NOT odd)::INT)::BIGINT AS valid_first, sum((odd OR loose)::INT)::BIGINT AS retried, sum(odd::INT)::BIGINT AS failed, sum((NOT odd AND loose)::INT)::BIGINT AS ungrounded FROM d""",
)
def batched_calls(t: Tables) -> DataFrame:
    rows = t.documents.where(F.length(F.trim("text")) > 0).select("doc_id", "text")
    out = plugins.call_batches(rows, word_client, "doc_id", "text")
    return out.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("valid_first", "retried", "failed", "ungrounded")])
