"""Corpus queries. Statements are documents; subject, nature and the other answers follow fixed rules of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import passages as cut
from ravelin.functions import text
from ravelin.functions.binding import lookup
from ravelin.operators import corpus
from ravelin.operators.ordering import lag_in_chunks
from ravelin.plans.registry import query
from ravelin.session import cut_lineage
from ravelin.plans.text import ENTITIES_SQL, REFERENCES_SQL, with_references
from ravelin.sources.tables import Tables

NATURES = list(corpus.STATE_NATURE_RANK)
KINDS = list(corpus.KIND_RANK)
SUBJECTS = {"en": "security", "fr": "go_live_date", "de": "vendor_contract", "es": "status_reporting"}
NEW_SOURCE = "src19"


def _pick(values: list[str], at) -> "F.Column":
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def passage_rows(t: Tables) -> DataFrame:
    """Documents as decided passages with their texts."""
    n, d = F.col("n_chars"), F.col("doc_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rows = t.documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.lit(None).cast("string").alias("attachment_of"),
        F.concat("source", F.lit("/"), F.lpad(d.cast("string"), 12, "0")).alias("path"),
        lookup(SUBJECTS, F.col("lang"), "noise").alias("subject"), _pick(NATURES, n).alias("nature"),
        _pick(KINDS, n + d).alias("kind"), ((n % 31) / 10).alias("authority"),
        F.concat(F.lit("2026-"), two(d % 3 + 8), F.lit("-"), two(d % 28 + 1)).alias("date"),
        ((n % 10) / 10).alias("flags_risk"), ((d % 10) / 10).alias("has_deadline"),
        with_references(F.col("text"), d).alias("text"), text.content_hash(F.col("text")).alias("sha256"),
    )
    return rows


def narrow_rows(t: Tables) -> DataFrame:
    """Decided passages with the length and hash of the text in place of the text; written once per run of a query."""
    if "narrow" not in t.__dict__:
        t.narrow = cut_lineage(passage_rows(t).withColumn("n_text", F.length("text")).drop("text"))
    return t.narrow


def statements(t: Tables, sources=None) -> DataFrame:
    """Narrow passages, of some sources if a condition is given, with copies marked."""
    rows = narrow_rows(t) if sources is None else narrow_rows(t).where(sources)
    return rows.join(corpus.text_copies(rows), "id", "left")


def with_entities(rows: DataFrame) -> DataFrame:
    found = text.entities(F.concat("text", F.lit(" "), "source_id"))
    return rows.withColumn("found", F.filter(found, lambda e: e != "owner")).drop("text")


def strong(t: Tables, sources=None) -> DataFrame:
    """Strongest statements with entities: one row per subject and source, read by every pair builder, so written once.

    Texts are read for these rows only.
    """
    rows = cut_lineage(corpus.strongest_per_source(corpus.pair_statements(statements(t, sources))))
    texts = t.documents.select(F.col("doc_id").alias("id"), with_references(F.col("text"), F.col("doc_id")).alias("text"))
    return cut_lineage(with_entities(rows.join(texts, "id")))


def judged(pairs: DataFrame) -> DataFrame:
    """Pair answers by a fixed rule of the two ids."""
    return pairs.withColumns(
        {"contradicts": ((F.col("a") + F.col("b") * 17) % 10) / 10, "supersedes": ((F.col("a") * 31 + F.col("b")) % 10) / 10}
    )


_LIST = lambda vs: "[" + ", ".join(f"'{v}'" for v in vs) + "]"
_RANK = lambda table, col: "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


def statements_sql(where: str = "TRUE", name: str = "st") -> str:
    return f"""{name}0 AS (
  SELECT doc_id AS id, source AS source_id, source || '/' || lpad(doc_id::VARCHAR, 12, '0') AS path,
    CASE lang WHEN 'en' THEN 'security' WHEN 'fr' THEN 'go_live_date' WHEN 'de' THEN 'vendor_contract'
      WHEN 'es' THEN 'status_reporting' ELSE 'noise' END AS subject,
    {_LIST(NATURES)}[n_chars % {len(NATURES)} + 1] AS nature, {_LIST(KINDS)}[(n_chars + doc_id) % {len(KINDS)} + 1] AS kind,
    (n_chars % 31) / 10 AS authority, '2026-' || lpad((doc_id % 3 + 8)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS date,
    (n_chars % 10) / 10 AS flags_risk, (doc_id % 10) / 10 AS has_deadline, {REFERENCES_SQL} AS body,
    sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS sha256
  FROM documents WHERE {where}),
{name}c AS (SELECT sha256, arg_min(id, path) AS cid, arg_min(source_id, path) AS csource FROM {name}0 WHERE length(body) >= 40 GROUP BY 1),
{name} AS (SELECT s.*, CASE WHEN length(body) >= 40 AND cid <> id AND csource <> source_id THEN cid END AS duplicate_of
  FROM {name}0 s LEFT JOIN {name}c USING (sha256))"""


def pairs_sql(st: str = "st", p: str = "") -> str:
    both = "FROM strong{p} l JOIN strong{p} r ON l.id < r.id AND l.source_id <> r.source_id".format(p=p)
    sides = """CASE WHEN l.date > r.date THEN r.id ELSE l.id END AS a, CASE WHEN l.date > r.date THEN l.id ELSE r.id END AS b"""
    topics = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in corpus.STATUS_TOPICS.items())
    return f"""strong{p} AS (SELECT *, list_filter({ENTITIES_SQL.replace("lower(body)", "lower(body || ' ' || source_id)")}, lambda e: e <> 'owner') AS found FROM (
    SELECT *, row_number() OVER (PARTITION BY subject, source_id ORDER BY authority DESC, date DESC,
      {_RANK(corpus.PAIR_NATURE_RANK, 'nature')} DESC, flags_risk DESC, id) AS rn FROM {st}
    WHERE duplicate_of IS NULL AND subject <> 'noise' AND nature <> 'noise' AND authority >= 1 AND length(body) >= 25) WHERE rn = 1),
  same{p} AS (SELECT {sides}, l.subject {both} AND l.subject = r.subject
    WHERE l.subject <> 'status_reporting' AND len(list_intersect(l.found, r.found)) > 0),
  status{p} AS (SELECT DISTINCT {sides}, l.subject FROM (SELECT *, unnest(found) AS e FROM strong{p}) l
    JOIN (SELECT *, unnest(found) AS e FROM strong{p} WHERE subject = 'status_reporting') r
    ON l.e = r.e AND l.subject = CASE r.e {topics} END AND l.source_id <> r.source_id
    WHERE abs(datediff('day', l.date::DATE, r.date::DATE)) <= 21),
  crossed{p} AS (SELECT {sides}, least(l.subject, r.subject) || '|' || greatest(l.subject, r.subject) AS subject {both} AND l.subject <> r.subject
    WHERE len(list_filter(list_intersect(l.found, r.found), lambda e: regexp_matches(e, '^(cr|inv)-'))) > 0),
  cand{p} AS (SELECT a, b, arg_min(subject, k) AS subject FROM (SELECT *, 0 AS k FROM same{p} UNION ALL SELECT *, 1 FROM status{p}
    UNION ALL SELECT *, 2 FROM crossed{p}) GROUP BY a, b),
  pairs{p} AS (SELECT *, ((a + b * 17) % 10) / 10 AS contradicts, ((a * 31 + b) % 10) / 10 AS supersedes FROM cand{p})"""


def guards_sql(st: str = "st", p: str = "") -> str:
    return f"""sup{p} AS (SELECT x.a, x.b, x.subject, CASE WHEN nb.nature = 'proposal' AND na.nature IN ('decision', 'approval') THEN 'R2'
    WHEN nb.nature = 'delivery' AND na.nature IN ('finding', 'risk', 'validation') THEN 'R3' END AS rule
    FROM pairs{p} x JOIN {st} na ON na.id = x.a JOIN {st} nb ON nb.id = x.b WHERE supersedes >= 0.5),
  repl{p} AS (SELECT a AS id, b AS "by" FROM sup{p} WHERE rule IS NULL),
  sts{p} AS (SELECT * FROM {st} WHERE duplicate_of IS NULL AND nature NOT IN ('information', 'noise') AND authority >= 1 AND subject <> 'noise'),
  live{p} AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY (nature <> 'proposal') DESC, authority DESC, date DESC,
    {_RANK(corpus.STATE_NATURE_RANK, 'nature')} DESC, length(body) DESC, {_RANK(corpus.KIND_RANK, 'kind')} DESC, id) AS pos
    FROM sts{p} WHERE id NOT IN (SELECT id FROM repl{p})),
  cur{p} AS (SELECT * FROM live{p} WHERE pos = 1)"""


BASE_SQL = f"WITH {statements_sql()}, {pairs_sql()}"
STATE_SQL = f"{BASE_SQL}, {guards_sql()}"


def _state_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    strongest_rows = strong(t)
    pairs = judged(corpus.candidate_pairs(strongest_rows))
    return statements(t), pairs, corpus.replaced_by(corpus.supersessions(pairs, strongest_rows))


# ---- duplicates ---------------------------------------------------------------------------------


def _document_lines(t: Tables) -> DataFrame:
    rows = t.documents.select(
        "doc_id", "source", F.posexplode(cut.lines_of(F.col("text"))).alias("line", "line_text")
    ).where(F.trim("line_text") != "")
    return rows.withColumn("sha256", text.content_hash(F.col("line_text")))


@query(
    "agg22_source_copies_by_signature",
    r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS s, unnest(range(0, len(string_split_regex(text, '\r?\n')))) AS i FROM documents),
    g AS (SELECT doc_id, string_agg(i || ':' || lower(trim(regexp_replace(s, '\s+', ' ', 'g'))), '|' ORDER BY i) AS sig FROM l WHERE trim(s) <> '' GROUP BY 1),
    m AS (SELECT sig, min(doc_id) AS first FROM g GROUP BY sig)
    SELECT doc_id, first AS copy_of FROM g JOIN m USING (sig) WHERE doc_id <> first""",
)
def source_copies(t: Tables) -> DataFrame:
    lines = _document_lines(t).withColumn("path", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return corpus.source_copies(lines, "doc_id", "path", "line", "sha256")


@query(
    "agg23_text_copies_other_origin",
    r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS s, unnest(range(0, len(string_split_regex(text, '\r?\n')))) AS i FROM documents),
    p AS (SELECT lpad(doc_id::VARCHAR, 12, '0') || ':' || lpad(i::VARCHAR, 6, '0') AS id, doc_id, lower(trim(regexp_replace(s, '\s+', ' ', 'g'))) AS h
      FROM l WHERE trim(s) <> '' AND length(trim(s)) >= 40),
    c AS (SELECT h, arg_min(id, id) AS cid, arg_min(doc_id, id) AS cdoc FROM p GROUP BY h)
    SELECT id, cid AS duplicate_of FROM p JOIN c USING (h) WHERE id <> cid AND doc_id <> cdoc""",
)
def text_copies(t: Tables) -> DataFrame:
    doc = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    rows = _document_lines(t).select(
        F.concat(doc, F.lit(":"), F.lpad(F.col("line").cast("string"), 6, "0")).alias("id"),
        F.col("doc_id").alias("source_id"), F.lit(None).cast("string").alias("attachment_of"), doc.alias("path"),
        F.trim("line_text").alias("text"), "sha256",
    )
    return corpus.text_copies(rows)


@query(
    "agg24_document_already_known",
    rf"""WITH l AS (SELECT doc_id, source, lower(trim(regexp_replace(unnest(string_split_regex(text, '\r?\n')), '\s+', ' ', 'g'))) AS h FROM documents),
    k AS (SELECT DISTINCT h FROM l WHERE source <> '{NEW_SOURCE}' AND h <> '')
    SELECT doc_id, count(*) AS passages, bool_and(k.h IS NOT NULL)::INT AS is_known FROM l LEFT JOIN k ON l.h = k.h
    WHERE source = '{NEW_SOURCE}' AND l.h <> '' GROUP BY doc_id""",
)
def already_known(t: Tables) -> DataFrame:
    lines = _document_lines(t)
    new = F.col("source") == NEW_SOURCE
    out = corpus.known_documents(lines.where(new), lines.where(~new), "doc_id", "sha256")
    return out.withColumn("is_known", F.col("is_known").cast("int"))


@query(
    "joi17_duplicate_roots",
    r"""WITH d AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS root FROM d QUALIFY doc_id <> min(doc_id) OVER (PARTITION BY h)""",
)
def duplicate_roots(t: Tables) -> DataFrame:
    """Every copy points to the copy before it; the chains are followed to their first document."""
    rows = t.documents.select("doc_id", text.content_hash(F.col("text")).alias("h"))
    chain = lag_in_chunks(rows, ["h"], ["doc_id"], F.floor(F.col("doc_id") / 4096), ["doc_id"])
    return corpus.roots(chain.where(F.col("prev_doc_id").isNotNull()), "doc_id", "prev_doc_id")


@query(
    "joi18_connected_groups",
    r"""WITH RECURSIVE l AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(unnest(string_split_regex(text, '\r?\n')), '\s+', ' ', 'g'))) AS h FROM documents),
    f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS m FROM l WHERE length(h) >= 40),
    e AS (SELECT DISTINCT doc_id AS u, m AS v FROM f WHERE doc_id <> m UNION SELECT DISTINCT m, doc_id FROM f WHERE doc_id <> m),
    r(id, reach) AS (SELECT u, u FROM e UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.reach)
    SELECT id, min(reach) AS "group" FROM r GROUP BY id""",
)
def connected(t: Tables) -> DataFrame:
    """Documents joined by shared long lines; each line links its documents to the first one only."""
    lines = _document_lines(t).where(F.length(F.trim("line_text")) >= 40).select("doc_id", "sha256")
    first = lines.groupBy("sha256").agg(F.min("doc_id").alias("first"))
    links = lines.join(first, "sha256").where(F.col("doc_id") != F.col("first")).select("doc_id", "first")
    return corpus.connected_groups(links, "doc_id", "first")


# ---- pairs --------------------------------------------------------------------------------------


@query("win08_strongest_per_source", f"{BASE_SQL} SELECT subject, source_id, id FROM strong")
def strongest(t: Tables) -> DataFrame:
    return corpus.strongest_per_source(corpus.pair_statements(statements(t))).select("subject", "source_id", "id")


@query("joi12_same_subject_pairs", f"{BASE_SQL} SELECT a, b, subject FROM same")
def same_subject(t: Tables) -> DataFrame:
    return corpus.same_subject_pairs(strong(t))


@query("joi13_status_pairs", f"{BASE_SQL} SELECT a, b, subject FROM status")
def status(t: Tables) -> DataFrame:
    return corpus.status_pairs(strong(t))


@query("joi14_cross_subject_pairs", f"{BASE_SQL} SELECT a, b, subject FROM cand")
def cross_subject(t: Tables) -> DataFrame:
    return corpus.candidate_pairs(strong(t))


@query(
    "joi15_fresh_pairs",
    f"""WITH {statements_sql()}, {pairs_sql()}, {statements_sql(f"source <> '{NEW_SOURCE}'", 'old')}, {pairs_sql('old', '_old')}
    SELECT a, b, subject FROM cand WHERE (a, b) NOT IN (SELECT (a, b) FROM cand_old)""",
)
def fresh(t: Tables) -> DataFrame:
    known = corpus.candidate_pairs(strong(t, before()))
    return corpus.fresh_pairs(corpus.candidate_pairs(strong(t)), known)


def before():
    """Condition on the sources before the newest one came."""
    return F.col("source_id") != NEW_SOURCE


@query("joi16_supersession_guards", f"{STATE_SQL} SELECT a, b, subject, rule FROM sup")
def guarded(t: Tables) -> DataFrame:
    rows = strong(t)
    pairs = judged(corpus.candidate_pairs(rows))
    return corpus.supersessions(pairs, rows).select("a", "b", "subject", "rule")


# ---- state --------------------------------------------------------------------------------------


@query("top03_current_statement", f"{STATE_SQL} SELECT subject, id, nature, authority FROM cur")
def current(t: Tables) -> DataFrame:
    rows, _, replaced = _state_inputs(t)
    return corpus.current(corpus.subject_statements(rows), replaced).select("subject", "id", "nature", "authority")


@query(
    "top04_supporting_other_sources",
    STATE_SQL + """, dec AS (SELECT subject, bool_or(nature <> 'proposal') AS d FROM live GROUP BY 1),
    ps AS (SELECT l.subject, l.source_id, min(pos) AS pos FROM live l JOIN dec USING (subject) WHERE NOT d OR nature <> 'proposal' GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY pos) AS n FROM ps)
    SELECT o.subject, (n - 1) AS position, l.id FROM o JOIN live l ON l.subject = o.subject AND l.pos = o.pos WHERE n BETWEEN 2 AND 5""",
)
def supporting(t: Tables) -> DataFrame:
    rows, _, replaced = _state_inputs(t)
    return corpus.supporting(corpus.subject_statements(rows), replaced).select("subject", "position", "id")


@query(
    "top05_history_of_replaced",
    STATE_SQL + """ SELECT s.subject, s.id, s.date, string_agg(DISTINCT "by"::VARCHAR, ',' ORDER BY "by"::VARCHAR) AS superseded_by
    FROM sts s JOIN repl USING (id) GROUP BY ALL""",
)
def history(t: Tables) -> DataFrame:
    rows, _, replaced = _state_inputs(t)
    listed = corpus.history(corpus.subject_statements(rows), replaced)
    ids = F.array_sort(F.transform("superseded_by", lambda v: v.cast("string")))
    return listed.select("subject", "id", "date", F.array_join(ids, ",").alias("superseded_by"))


@query(
    "top06_contradiction_winner",
    STATE_SQL + """, c AS (SELECT x.a, x.b, unnest(string_split(x.subject, '|')) AS in_subject FROM pairs x WHERE contradicts >= 0.5),
    j AS (SELECT c.*, na.authority AS aa, nb.authority AS ba, na.date AS ad, nb.date AS bd,
      c.a IN (SELECT id FROM repl) AS ag, c.b IN (SELECT id FROM repl) AS bg, cur.id AS cid
      FROM c JOIN st na ON na.id = c.a JOIN st nb ON nb.id = c.b LEFT JOIN cur ON cur.subject = c.in_subject),
    w AS (SELECT *, CASE WHEN ag AND bg THEN NULL WHEN ag <> bg THEN CASE WHEN ag THEN 'b' ELSE 'a' END
      WHEN aa <> ba THEN CASE WHEN aa > ba THEN 'a' ELSE 'b' END WHEN ad <> bd THEN CASE WHEN ad > bd THEN 'a' ELSE 'b' END END AS won FROM j)
    SELECT in_subject, a, b, coalesce(CASE won WHEN 'a' THEN a WHEN 'b' THEN b END, cid) AS winner,
      CASE won WHEN 'a' THEN b WHEN 'b' THEN a END AS loser,
      CASE WHEN (ag AND bg) OR ag <> bg THEN 'R1' WHEN won IS NOT NULL THEN 'R4' ELSE 'unresolved' END AS rule FROM w""",
)
def contradictions(t: Tables) -> DataFrame:
    rows, pairs, replaced = _state_inputs(t)
    now = corpus.current(corpus.subject_statements(rows), replaced)
    return corpus.resolve(pairs, rows, replaced, now)


@query(
    "agg18_counters_per_subject",
    STATE_SQL + """ SELECT subject, nature, count(*) AS passages, count(*) FILTER (duplicate_of IS NULL) AS independent,
      count(DISTINCT source_id) AS sources, count(*) FILTER (duplicate_of IS NULL AND flags_risk >= 0.5) AS flags_risk
    FROM st WHERE subject <> 'noise' GROUP BY ALL""",
)
def counters_by_nature(t: Tables) -> DataFrame:
    own = F.col("duplicate_of").isNull()
    return statements(t).where(F.col("subject") != "noise").groupBy("subject", "nature").agg(
        F.count(F.lit(1)).alias("passages"), F.count_if(own).alias("independent"),
        F.count_distinct("source_id").alias("sources"), F.count_if(own & (F.col("flags_risk") >= corpus.YES)).alias("flags_risk"),
    )


def snapshot_sql(st: str, p: str) -> str:
    return f"""snap{p} AS (SELECT c.*, cur{p}.id AS current_id, coalesce(g.superseded, 0) AS superseded, coalesce(f.contradictions, 0) AS contradictions
    FROM (SELECT subject, count(*) AS passages, count(*) FILTER (duplicate_of IS NULL) AS independent, count(DISTINCT source_id) AS sources,
      count(*) FILTER (duplicate_of IS NULL AND flags_risk >= 0.5) AS flags_risk, count(*) FILTER (duplicate_of IS NULL AND has_deadline >= 0.5) AS has_deadline
      FROM {st} WHERE subject <> 'noise' GROUP BY 1) c LEFT JOIN cur{p} ON cur{p}.subject = c.subject
    LEFT JOIN (SELECT subject, count(*) AS superseded FROM sts{p} WHERE id IN (SELECT id FROM repl{p}) GROUP BY 1) g ON g.subject = c.subject
    LEFT JOIN (SELECT subject, count(*) AS contradictions FROM (SELECT unnest(string_split(subject, '|')) AS subject FROM pairs{p} WHERE contradicts >= 0.5) GROUP BY 1) f
      ON f.subject = c.subject)"""


@query(
    "set03_state_diff",
    f"""WITH {statements_sql()}, {pairs_sql()}, {guards_sql()}, {snapshot_sql('st', '')},
    {statements_sql(f"source <> '{NEW_SOURCE}'", 'old')}, {pairs_sql('old', '_old')}, {guards_sql('old', '_old')}, {snapshot_sql('old', '_old')},
    d AS (SELECT n.subject, o.current_id AS current_v1, n.current_id AS current_v2, (o.current_id IS DISTINCT FROM n.current_id)::INT AS current_changed,
      n.passages - coalesce(o.passages, 0) AS d_passages, n.independent - coalesce(o.independent, 0) AS d_independent,
      n.sources - coalesce(o.sources, 0) AS d_sources, n.flags_risk - coalesce(o.flags_risk, 0) AS d_flags_risk,
      n.has_deadline - coalesce(o.has_deadline, 0) AS d_has_deadline, n.superseded - coalesce(o.superseded, 0) AS d_superseded,
      n.contradictions - coalesce(o.contradictions, 0) AS d_contradictions FROM snap n LEFT JOIN snap_old o USING (subject))
    SELECT * FROM d WHERE current_changed = 1 OR d_passages <> 0 OR d_independent <> 0 OR d_sources <> 0 OR d_flags_risk <> 0 OR d_has_deadline <> 0
      OR d_superseded <> 0 OR d_contradictions <> 0""",
)
def state_diff(t: Tables) -> DataFrame:
    def snap(sources=None) -> DataFrame:
        rows = strong(t, sources)
        return corpus.snapshot(statements(t, sources), judged(corpus.candidate_pairs(rows)), rows)

    diff = corpus.diff_snapshots(snap(before()), snap())
    return diff.withColumn("current_changed", F.col("current_changed").cast("int"))
