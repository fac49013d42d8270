"""Search, vector, vote, citation and answer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import answers, passages as cut, text
from ravelin.functions.binding import lookup
from ravelin.operators import search, vectors
from ravelin.plans.registry import query
from ravelin.plans.text import TOKENS_SQL
from ravelin.session import cut_lineage
from ravelin.sources.tables import Tables

COPY_SQL = r"""d AS (SELECT doc_id, source, text, min(doc_id) OVER (PARTITION BY lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS first FROM documents)"""


def _with_copies(t: Tables) -> DataFrame:
    """doc_id, source, duplicate_of; texts stay in the scan and are hashed once, only their hashes are joined."""
    rows = cut_lineage(t.documents.select("doc_id", "source", text.content_hash(F.col("text")).alias("h")))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "h").withColumn("duplicate_of", F.when(F.col("first") != F.col("doc_id"), F.col("first"))).drop("h", "first")


def _index(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), text.tokens(F.concat_ws(" ", "text", "source")).alias("tokens"))


def _weights(copies: DataFrame) -> DataFrame:
    weight = F.when(F.col("duplicate_of").isNotNull(), search.COPY_WEIGHT).otherwise(1.0)
    return copies.select(F.col("doc_id").alias("id"), weight.alias("weight"))


def _queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query"), text.tokens(F.col("text")).alias("tokens"))


BM25_SQL = f"""WITH {COPY_SQL},
    i AS (SELECT doc_id AS id, CASE WHEN first <> doc_id THEN 0.6 ELSE 1.0 END AS weight, {TOKENS_SQL.format(c="text || ' ' || source")} AS ts FROM d),
    s AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM i),
    p AS (SELECT id, weight, len, term, count(*) AS tf FROM (SELECT id, weight, len(ts) AS len, unnest(ts) AS term FROM i) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    q AS (SELECT item_id AS query, unnest(list_distinct({TOKENS_SQL.format(c="text")})) AS term FROM benchmark),
    sc AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.28 + 0.72 * len / avg_len))) * weight, 9) AS score
      FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY query, id, weight),
    top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS position FROM sc WHERE score > 0)"""


@query("top07_bm25_ranking", BM25_SQL + " SELECT query, position, id, round(score, 6) AS score FROM top WHERE position <= 10")
def bm25(t: Tables) -> DataFrame:
    hits = search.bm25(_index(t), _queries(t), 10, _weights(_with_copies(t)))
    return hits.select("query", "position", "id", F.round("score", 6).alias("score"))


@query(
    "top09_hits_grouped_by_source",
    BM25_SQL + """, c AS (SELECT query, position, first AS canonical, source, doc_id FROM top JOIN d ON d.doc_id = top.id WHERE position <= 60),
    m AS (SELECT query, canonical, min(position) AS position, coalesce(string_agg(DISTINCT CASE WHEN doc_id <> canonical THEN source END, ',' ORDER BY CASE WHEN doc_id <> canonical THEN source END), '') AS also_in
      FROM c GROUP BY ALL),
    g AS (SELECT m.*, d.source, min(position) OVER (PARTITION BY query, d.source) AS best,
      row_number() OVER (PARTITION BY query, d.source ORDER BY position) AS passage_rank FROM m JOIN d ON d.doc_id = m.canonical),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY query ORDER BY best) AS source_rank FROM g)
    SELECT query, source_rank, source, passage_rank, canonical, also_in FROM r WHERE source_rank <= 6 AND passage_rank <= 3""",
)
def grouped_hits(t: Tables) -> DataFrame:
    copies = _with_copies(t)
    hits = search.bm25(_index(t), _queries(t), search.CANDIDATES, _weights(copies))
    known = copies.select(F.col("doc_id").alias("id"), "source", "duplicate_of")
    out = search.group_hits(hits, known)
    return out.withColumn("also_in", F.array_join("also_in", ","))


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("id"), search.unit(F.col("embedding")).alias("vector"), F.lit(1.0).alias("weight"), "label"
    )


def _centroids(t: Tables) -> DataFrame:
    """Mean vector of each label, as the query set: one row per label."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "v"))
    mean = parts.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("v"))
    whole = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("vs"))
    return whole.select(F.col("label").cast("long").alias("query"), search.unit(F.transform("vs", lambda x: x["v"])).alias("vector"))


VECTOR_SQL = """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1),
    u AS (SELECT v.vec_id, v.label, i, x / norm AS x FROM v JOIN n USING (vec_id)),
    c AS (SELECT label AS query, i, round(avg(x), 9) AS x FROM v GROUP BY ALL),
    cn AS (SELECT query, sqrt(sum(x * x)) AS norm FROM c GROUP BY 1),
    sc AS (SELECT c.query::BIGINT AS query, u.vec_id AS id, u.label, round(sum(u.x * c.x / norm), 9) AS score FROM u JOIN c USING (i) JOIN cn ON cn.query = c.query GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS position FROM sc)"""


@query("top08_vector_top_k", VECTOR_SQL + " SELECT query, position, id, round(score, 6) AS score FROM top WHERE position <= 10")
def vector_top(t: Tables) -> DataFrame:
    hits = vectors.search(vectors.build(_vectors(t)), _centroids(t), 10)
    return hits.select("query", "position", "id", F.round("score", 6).alias("score"))


@query(
    "top10_knn_label_vote",
    VECTOR_SQL + """, k AS (SELECT query, label, count(*) AS votes, sum(score) AS total FROM top WHERE position <= 5 GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, round(total, 9) DESC, label) AS rn FROM k)
    SELECT query, CASE WHEN votes >= 3 THEN label END AS label, votes, CASE WHEN votes >= 3 THEN round(total / votes, 6) END AS score FROM b WHERE rn = 1""",
)
def knn(t: Tables) -> DataFrame:
    index = _vectors(t)
    hits = vectors.search(vectors.build(index), _centroids(t), search.NEIGHBORS)
    return search.knn_vote(hits, index.select("id", "label")).withColumn("score", F.round("score", 6))


# Queries: every vector whose id is divisible by 50, against all others.
NEAREST_SQL = """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    sc AS (SELECT q.vec_id AS query, u.vec_id AS id, u.label, round(list_dot_product(u.v, q.v), 9) AS score FROM u JOIN u q ON q.vec_id % 50 = 0 AND q.vec_id <> u.vec_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS position FROM sc)"""


def _asked(t: Tables) -> DataFrame:
    return _vectors(t).where(F.col("id") % 50 == 0).select(F.col("id").alias("query"), "vector")


@query("top08_metric_index_top_k", NEAREST_SQL + " SELECT query, position, id, round(score, 6) AS score FROM top WHERE position <= 10")
def metric_top(t: Tables) -> DataFrame:
    hits = vectors.search(vectors.build(_vectors(t)), _asked(t), 10, exclude_self=True)
    return hits.select("query", "position", "id", F.round("score", 6).alias("score"))


@query("top08_metric_index_scored_share")
def metric_share(t: Tables) -> DataFrame:
    """Pairs that the bounds leave to be scored, of all pairs, for the searches of the two queries beside."""
    index = vectors.build(_vectors(t))
    shares = [("ten nearest", 10, None), ("nearest of 0.8 or more", 1, search.PREPARED_SEMANTIC)]
    parts = [vectors.scored_share(index, _asked(t), k, True, floor).withColumn("search", F.lit(name)) for name, k, floor in shares]
    return parts[0].unionByName(parts[1])


@query(
    "top10_metric_index_vote",
    NEAREST_SQL + """, k AS (SELECT query, label, count(*) AS votes, sum(score) AS total FROM top WHERE position <= 5 GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY votes DESC, round(total, 9) DESC, label) AS rn FROM k)
    SELECT query, CASE WHEN votes >= 3 THEN label END AS label, votes, CASE WHEN votes >= 3 THEN round(total / votes, 6) END AS score FROM b WHERE rn = 1""",
)
def metric_vote(t: Tables) -> DataFrame:
    index = _vectors(t)
    hits = vectors.search(vectors.build(index), _asked(t), search.NEIGHBORS, exclude_self=True)
    return search.knn_vote(hits, index.select("id", "label")).withColumn("score", F.round("score", 6))


@query(
    "ml18_int8_vector_index",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1),
    u AS (SELECT vec_id, i, x / norm AS x FROM v JOIN n USING (vec_id)),
    s AS (SELECT vec_id, max(abs(x)) / 127 AS scale FROM u GROUP BY 1)
    SELECT vec_id, count(*) AS dim, round(max(scale), 9) AS scale, sum(abs(round_even(x / scale, 0)))::BIGINT AS mass,
      sum(round_even(x / scale, 0) * (i + 1))::BIGINT AS moment FROM u JOIN s USING (vec_id) GROUP BY vec_id""",
)
def int8_index(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", search.quantize(search.unit(F.col("embedding"))).alias("q"))
    add = lambda arr: F.aggregate(arr, F.lit(0).cast("long"), lambda s, v: s + v)
    return rows.select(
        "vec_id", F.size("q.levels").cast("long").alias("dim"), F.round("q.scale", 9).alias("scale"),
        add(F.transform("q.levels", lambda v: F.abs(v.cast("long")))).alias("mass"),
        add(F.transform("q.levels", lambda v, i: v.cast("long") * (i + 1))).alias("moment"),
    )


PREPARED_SQL = f"""WITH p AS (SELECT item_id AS id, 'Q' || lpad(item_id::VARCHAR, 2, '0') AS code, list_distinct({TOKENS_SQL.format(c='text')}) AS ts FROM benchmark),
    qq AS (SELECT item_id AS query, CASE WHEN item_id % 5 = 0 THEN 'voir Q' || lpad(((item_id + 1) % 40)::VARCHAR, 2, '0') || ' ' ELSE '' END || regexp_replace(text, '^\\S+\\s', '') AS body FROM benchmark
      UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations),
    q AS (SELECT query, body, list_distinct({TOKENS_SQL.format(c='body')}) AS ts FROM qq)"""


@query(
    "top11_prepared_answer_match",
    PREPARED_SQL + r""", lex AS (SELECT query, id, len(list_intersect(q.ts, p.ts)) / sqrt(len(q.ts) * len(p.ts)) AS score FROM q, p WHERE len(q.ts) > 0 AND len(p.ts) > 0),
    named AS (SELECT query, id, 2.0::DOUBLE AS score FROM q JOIN p ON p.code = upper(regexp_extract(body, '(?i)\b(Q\d{2}|EX\d)\b', 1))),
    b AS (SELECT * FROM lex WHERE score >= 0.75 UNION ALL SELECT * FROM named),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rn FROM b)
    SELECT query, id, round(score, 6) AS score FROM r WHERE rn = 1""",
)
def prepared(t: Tables) -> DataFrame:
    asked, known = _asked_and_prepared(t)
    return search.match_prepared(asked, known).withColumn("score", F.round("score", 6))


def _asked_and_prepared(t: Tables) -> tuple[DataFrame, DataFrame]:
    code = F.concat(F.lit("Q"), F.lpad(F.col("item_id").cast("string"), 2, "0"))
    known = t.benchmark.select(F.col("item_id").alias("id"), code.alias("code"), text.tokens(F.col("text")).alias("tokens"))
    named = F.concat(F.lit("voir Q"), F.lpad(((F.col("item_id") + 1) % 40).cast("string"), 2, "0"), F.lit(" "))
    asked = t.benchmark.select(
        F.col("item_id").alias("query"),
        F.concat(F.when(F.col("item_id") % 5 == 0, named).otherwise(""), F.regexp_replace("text", r"^\S+\s", "")).alias("body"),
    ).unionByName(
        t.conversations.select((F.lit(1000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("query"), F.col("text").alias("body"))
    )
    return asked.withColumn("tokens", text.tokens(F.col("body"))), known


# Prepared entries carry the vector of their id; a question that has one leans from its entry's vector towards the next by 0, 0.4, 0.7 or 1.
LEANS = [0.0, 0.4, 0.7, 1.0]


@query(
    "top11_prepared_answer_tiers",
    PREPARED_SQL + rf""", e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    pv AS (SELECT p.*, e.v FROM p LEFT JOIN e ON e.vec_id = p.id),
    qv AS (SELECT q.*, CASE WHEN query % 2 = 0 AND a.v IS NOT NULL AND b.v IS NOT NULL THEN list_transform(list_zip(a.v, b.v), lambda z: z[1] + [{', '.join(map(str, LEANS))}][(query // 2 % 4 + 1)::INT] * z[2]) END AS w
      FROM q LEFT JOIN e a ON a.vec_id = q.query LEFT JOIN e b ON b.vec_id = q.query + 1),
    named AS (SELECT query, min(id) AS id FROM q JOIN p ON p.code = upper(regexp_extract(body, '(?i)\b(Q\d{{2}}|EX\d)\b', 1)) GROUP BY query),
    sem AS (SELECT query, id, round(list_dot_product(w, v) / sqrt(list_dot_product(w, w)), 9) AS score FROM qv, pv WHERE w IS NOT NULL AND v IS NOT NULL),
    lex AS (SELECT query, id, len(list_intersect(qv.ts, p.ts)) / sqrt(len(qv.ts) * len(p.ts)) AS score FROM qv, p WHERE w IS NULL AND len(qv.ts) > 0 AND len(p.ts) > 0),
    b AS (SELECT query, 'semantic' AS tier, id, score FROM sem WHERE score >= 0.8 UNION ALL SELECT query, 'lexical', id, score FROM lex WHERE score >= 0.75),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rn FROM b WHERE query NOT IN (SELECT query FROM named))
    SELECT query, tier, id, round(score, 6) AS score FROM r WHERE rn = 1 UNION ALL SELECT query, 'named', id, NULL FROM named""",
)
def prepared_tiers(t: Tables) -> DataFrame:
    asked, known = _asked_and_prepared(t)
    own = t.embeddings.select(F.col("vec_id").alias("id"), search.unit(F.col("embedding")).alias("vector"))
    known = known.join(own, "id", "left")
    follower = own.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    lean = F.element_at(F.array(*[F.lit(x) for x in LEANS]), (F.floor(F.col("id") / 2) % 4 + 1).cast("int"))
    between = search.unit(F.zip_with("vector", "other", lambda a, b: a + lean * b))
    leaning = own.join(follower, "id").where(F.col("id") % 2 == 0).select(F.col("id").alias("query"), between.alias("vector"))
    out = vectors.match_in_tiers(asked.join(leaning, "query", "left"), known)
    return out.withColumn("score", F.round("score", 6))


CMP_SQL = r"lower(trim(regexp_replace(replace(replace(replace({c}, '**', ''), ' | ', ' '), '\"', ''), '\s+', ' ', 'g')))"


@query(
    "joi23_citation_resolution",
    f"""WITH r AS (SELECT item_id AS ref, CASE WHEN item_id % 4 = 0 THEN item_id END AS passage_id, CASE WHEN item_id % 4 >= 2 THEN 'src' || (item_id % 20) END AS source,
      CASE WHEN item_id % 4 = 1 THEN text ELSE '' END AS quote, CASE WHEN item_id % 4 = 2 THEN item_id % 50 + 1 END AS line,
      CASE WHEN item_id % 4 = 3 THEN 'partie' || (item_id % 7) END AS word FROM benchmark),
    p AS (SELECT doc_id AS id, source, {CMP_SQL.format(c='text')} AS h, doc_id % 50 + 1 AS line, 'section partie' || (doc_id % 7) || ' ' || lang AS locator FROM documents),
    w AS (SELECT ref, 0 AS way, id FROM r JOIN p ON p.id = r.passage_id
      UNION ALL SELECT ref, 1, id FROM r JOIN p ON contains(p.h, {CMP_SQL.format(c='r.quote')}) WHERE r.quote <> ''
      UNION ALL SELECT ref, 2, id FROM r JOIN p ON p.source = r.source AND p.line = r.line
      UNION ALL SELECT ref, 3, id FROM r JOIN p ON p.source = r.source AND contains(p.locator, r.word)),
    m AS (SELECT ref, min(way) AS way FROM w GROUP BY 1)
    SELECT ref, way, count(*) AS n, min(id) AS first FROM w JOIN m USING (ref, way) GROUP BY ALL""",
)
def citation_resolution(t: Tables) -> DataFrame:
    i = F.col("item_id")
    refs = t.benchmark.select(
        i.alias("ref"), F.when(i % 4 == 0, i).alias("passage_id"),
        F.when(i % 4 >= 2, F.concat(F.lit("src"), (i % 20).cast("string"))).alias("source"),
        F.when(i % 4 == 1, F.col("text")).otherwise("").alias("quote"),
        text.parse_locator(F.when(i % 4 == 2, F.concat(F.lit("ligne "), (i % 50 + 1).cast("string"))).otherwise(""), F.lit(False))["lines"].alias("lines"),
        F.when(i % 4 == 3, F.array(F.concat(F.lit("partie"), (i % 7).cast("string")))).otherwise(F.array().cast("array<string>")).alias("words"),
    )
    d = F.col("doc_id")
    rows = t.documents.select(
        d.alias("id"), "source", "text", (d % 50 + 1).alias("line"),
        F.concat(F.lit("section partie"), (d % 7).cast("string"), F.lit(" "), F.col("lang")).alias("locator"),
    )
    out = search.resolve_refs(refs, rows)
    return out.groupBy("ref", "way").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query(
    "joi24_citation_fields_and_cell",
    """SELECT p_partkey, 'part!p_brand' AS locator, 'p_brand: ' || p_brand AS quote FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 'ligne ' || (p_partkey + 2), 'p_' FROM part WHERE p_partkey % 2 = 1""",
)
def citation_fields(t: Tables) -> DataFrame:
    """A quote held by exactly one cell gets that cell as locator, else the row locator stays."""
    columns = ["p_name", "p_brand", "p_type"]
    _, cells = cut.row_passage(columns)
    cites = t.part.select(
        "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("p_brand: "), "p_brand")).otherwise("p_").alias("quote")
    )
    rows = t.part.select("p_partkey", cells.alias("cells"), F.concat(F.lit("ligne "), (F.col("p_partkey") + 2).cast("string")).alias("row"))
    joined = cites.join(rows, "p_partkey")
    cell = search.cell_of_quote(F.col("cells"), F.col("quote"))
    return joined.select("p_partkey", F.coalesce(F.concat(F.lit("part!"), cell), "row").alias("locator"), "quote")


@query(
    "joi36_reverse_citations",
    f"""WITH p AS (SELECT doc_id AS id, source, {CMP_SQL.format(c='text')} AS h FROM documents),
    c AS (SELECT source, 'answer' AS kind, item_id FROM benchmark JOIN p ON contains(h, {CMP_SQL.format(c='benchmark.text')})
      UNION ALL SELECT source, 'label', doc_id FROM labels JOIN documents USING (doc_id) WHERE toxic = 1)
    SELECT source, kind, count(DISTINCT item_id) AS n, min(item_id) AS first FROM c GROUP BY ALL""",
)
def reverse_citations(t: Tables) -> DataFrame:
    quotes = t.benchmark.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    hits = search.find_quotes(quotes, t.documents.select(F.col("doc_id").alias("id"), "text"))
    sources = t.documents.select("doc_id", "source")
    cited = hits.join(sources, F.col("id") == F.col("doc_id")).select("source", F.lit("answer").alias("kind"), F.col("quote_id").alias("item"))
    toxic = t.labels.where("toxic = 1").join(sources, "doc_id").select("source", F.lit("label").alias("kind"), F.col("doc_id").alias("item"))
    return cited.unionByName(toxic).groupBy("source", "kind").agg(
        F.count_distinct("item").alias("n"), F.min("item").alias("first")
    )


@query(
    "dq07_knowledge_integrity",
    f"""WITH c AS (SELECT doc_id, doc_id % 5 AS k, {CMP_SQL.format(c='text')} AS h, {CMP_SQL.format(c='substr(trim(text), 1, 30)')} AS q FROM documents)
    SELECT doc_id AS "where", CASE WHEN k = 0 THEN 'unknown passage' WHEN k = 1 THEN 'empty quote' WHEN k = 2 THEN 'quote too long'
      WHEN k = 3 OR NOT contains(h, q) THEN 'quote not found' END AS problem FROM c""",
)
def knowledge_integrity(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    quote = (
        F.when(k == 1, " ").when(k == 2, F.repeat(F.lit("mot "), 100)).when(k == 3, "§ absent §")
        .otherwise(F.substring(F.trim("text"), 1, 30))
    )
    cites = t.documents.select(
        F.col("doc_id").alias("where"), F.when(k == 0, -1).otherwise(F.col("doc_id")).alias("passage"), quote.alias("quote")
    )
    rows = t.documents.select(F.col("doc_id").alias("id"), "text")
    return search.citation_problems(cites, rows).select("where", "problem")


# ---- typed answers ------------------------------------------------------------------------------


@query(
    "prj09_alias_tolerant_read",
    """SELECT event_id, coalesce(nullif(json_extract_string(props, '$.key'), ''), nullif(json_extract_string(props, '$.k'), '')) AS k,
      coalesce(nullif(CASE WHEN event_type = 'error' THEN '' ELSE event_type END, ''), user_id::VARCHAR) AS who FROM events""",
)
def alias_read(t: Tables) -> DataFrame:
    rows = t.events.withColumn("kind", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")))
    return rows.select("event_id", answers.json_field(F.col("props"), "key", "k").alias("k"), answers.field("kind", "user_id").alias("who"))


@query(
    "prj10_typed_answers",
    """WITH e AS (SELECT event_id, event_type, round((event_id % 7 + 1) / 10, 1) AS p, event_id % 3 AS k FROM events)
    SELECT event_id, CASE k WHEN 0 THEN event_type WHEN 1 THEN NULL ELSE NULL END AS choice, CASE WHEN k = 1 THEN round(2 * p + (1 - p), 4) END AS score,
      CASE WHEN k = 2 THEN p END AS noul, CASE WHEN k = 2 THEN NULL ELSE greatest(p, 1 - p) END AS confidence,
      CASE k WHEN 0 THEN p WHEN 1 THEN greatest(p, 1 - p) ELSE p END AS probability FROM e""",
)
def typed_answers(t: Tables) -> DataFrame:
    k, p = F.col("event_id") % 3, F.round((F.col("event_id") % 7 + 1) / 10, 1)
    options = (
        F.when(k == 0, F.create_map(F.col("event_type"), p, F.lit("other"), 1 - p))
        .when(k == 1, F.create_map(F.lit("2"), p, F.lit("1"), 1 - p))
        .otherwise(F.create_map(F.lit("true"), p, F.lit("false"), 1 - p))
    )
    kind = F.when(k == 0, "choice").when(k == 1, "score").otherwise("noul")
    rows = t.events.select("event_id", answers.build_answer(kind, F.col("event_type"), options, "rules").alias("a"))
    return rows.select("event_id", "a.choice", "a.score", "a.noul", "a.confidence", answers.answer_probability(F.col("a")).alias("probability"))


@query(
    "prj11_option_probabilities",
    """WITH e AS (SELECT event_id, exp(-value / 100) AS a, exp(-(event_id % 9) / 3.0) AS b, exp(-2.0) AS c, event_id % 2 = 0 AS chosen_purchase FROM events),
    m AS (SELECT event_id, a + CASE WHEN chosen_purchase THEN c ELSE 0 END AS purchase, b + CASE WHEN NOT chosen_purchase THEN c ELSE 0 END AS push FROM e)
    SELECT event_id, round(purchase / (purchase + push), 4) AS purchase, round(push / (purchase + push), 4) AS push FROM m""",
)
def option_probabilities(t: Tables) -> DataFrame:
    pair = lambda token, lp: F.struct(F.lit(token).alias("token"), lp.alias("logprob"))
    alternatives = F.array(
        pair('purchase"', -F.col("value") / 100), pair("push", -(F.col("event_id") % 9) / 3.0), pair("pu", F.lit(-2.0)),
        pair("zzz", F.lit(-0.1)), pair('"}', F.lit(-0.1)),
    )
    chosen = F.when(F.col("event_id") % 2 == 0, "purchase").otherwise("push")
    mass = answers.option_mass(alternatives, ["purchase", "push"], chosen)
    return t.events.select("event_id", mass["purchase"].alias("purchase"), mass["push"].alias("push"))


STATUS = {"1-URGENT": "en retard — relance", "2-HIGH": "en cours (lot 2)", "3-MEDIUM": "realise; clos", "4-NOT SPECIFIED": "a faire", "5-LOW": "inconnu"}
RISKS = {"1-URGENT": "Probabilité elevee / Impact critique", "2-HIGH": "Probabilité moyenne / Impact eleve",
         "3-MEDIUM": "Probabilité faible / Impact moyen", "4-NOT SPECIFIED": "Probabilité faible / Impact faible", "5-LOW": "absent"}


@query(
    "prj12_status_and_risk_flags",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'warning' WHEN '3-MEDIUM' THEN 'positive'
      WHEN '4-NOT SPECIFIED' THEN 'info' ELSE 'neutral' END AS tone, (o_orderpriority <> '3-MEDIUM')::INT AS open,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'en retard' WHEN '2-HIGH' THEN 'en cours' WHEN '3-MEDIUM' THEN 'realise' WHEN '4-NOT SPECIFIED' THEN 'a faire' ELSE 'inconnu' END AS short,
      CASE o_orderpriority WHEN '1-URGENT' THEN 12 WHEN '2-HIGH' THEN 6 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS severity FROM orders""",
)
def status_flags(t: Tables) -> DataFrame:
    status = lookup(STATUS, F.col("o_orderpriority"), "inconnu")
    risk = answers.risk_level(lookup(RISKS, F.col("o_orderpriority"), ""))
    tone = answers.action_tone(status)
    return t.orders.select(
        "o_orderkey", tone.alias("tone"), (tone != "positive").cast("int").alias("open"), answers.short_status(status).alias("short"),
        answers.risk_severity(risk["probability"], risk["impact"]).alias("severity"),
    )
