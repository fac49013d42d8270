"""Text queries over whole documents; block marks, dates and references are written into the texts by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import composition, dates, passages, text
from ravelin.plans.registry import query
from ravelin.sources.tables import Tables

NL = "chr(10)"
SIGNS_SQL = "translate(text, '’‘`«»“”–—−', '''''''\"\"\"\"---')"


def structured(col: Column) -> Column:
    """Text with blank lines, lone headings and bullets put after lines that end in certain letters."""
    spaced = F.regexp_replace(col, r"([a-m]\.)\n", "$1\n\n")
    return F.regexp_replace(spaced, r"([n-s]\.)\n", "$1\n\nSuite\n\n- ")


STRUCTURED_SQL = (
    r"regexp_replace(regexp_replace(text, '([a-m]\.)\n', '\1' || chr(10) || chr(10), 'g'), '([n-s]\.)\n', "
    r"'\1' || chr(10) || chr(10) || 'Suite' || chr(10) || chr(10) || '- ', 'g')"
)
LINES_SQL = f"""s AS (SELECT doc_id, string_split_regex({STRUCTURED_SQL}, '\\r?\\n') AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM s),
    b AS (SELECT *, sum((trim(line) = '')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS blk FROM l)"""
BLOCKS_SQL = f"""{LINES_SQL},
    k AS (SELECT doc_id, blk, min(i) AS first, max(i) AS last, string_agg(rtrim(line), {NL} ORDER BY i) AS text
      FROM b WHERE trim(line) <> '' GROUP BY doc_id, blk)"""
ITEM_SQL = "(trim({c}) LIKE '- %' OR trim({c}) LIKE '* %' OR regexp_matches(trim({c}), '^\\d{{1,2}}:\\d{{2}}\\s') OR regexp_matches(trim({c}), '^\\d+\\.\\s'))"


@query(
    "txt01_numbered_lines",
    r"""WITH s AS (SELECT doc_id, string_split_regex(text, '\r?\n') AS ls FROM documents)
    SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, md5(unnest(ls)) AS digest FROM s""",
)
def numbered_lines(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(passages.lines_of(F.col("text"))).alias("pos", "line_text"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line"), F.md5("line_text").alias("digest"))


def _blocks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", passages.blocks(passages.lines_of(structured(F.col("text")))).alias("found"))


@query("txt02_blocks_by_blank_line",
       f"WITH {BLOCKS_SQL} SELECT doc_id, first, last, md5(text) AS digest FROM k")
def blocks(t: Tables) -> DataFrame:
    return _blocks(t).select("doc_id", F.explode("found").alias("b")).select(
        "doc_id", "b.first", "b.last", F.md5("b.text").alias("digest")
    )


HEADING_SQL = (
    "((trim({c}) LIKE '#%' OR (length(trim({c})) <= 40 AND trim({c}) NOT LIKE '%.' AND "
    "strpos(substr(trim({c}), 1, greatest(length(trim({c})) - 1, 0)), ':') = 0)) AND NOT {item})"
)


@query(
    "txt03_heading_carried_to_next_block",
    f"""WITH {BLOCKS_SQL}, f AS (SELECT *, string_split(text, {NL})[1] AS fl,
      row_number() OVER (PARTITION BY doc_id ORDER BY blk) AS n FROM k),
    g AS (SELECT *, {HEADING_SQL.format(c='fl', item=ITEM_SQL.format(c='fl'))} AS h, first = last AS lone_line,
      {ITEM_SQL.format(c='fl')} AS item FROM f),
    c AS (SELECT *, lag(CASE WHEN h AND lone_line AND n > 1 THEN rtrim(ltrim(trim(fl), '# '), ' :') END) OVER (PARTITION BY doc_id ORDER BY n) AS carried FROM g)
    SELECT doc_id, first, last, (n = 1 AND NOT item)::INT AS header,
      CASE WHEN NOT (n = 1 AND NOT item) THEN coalesce(CASE WHEN h THEN nullif(rtrim(ltrim(trim(fl), '# '), ' :'), '') END, carried) END AS heading
    FROM c WHERE (n = 1 AND NOT item) OR NOT (h AND lone_line)""",
)
def headed(t: Tables) -> DataFrame:
    rows = _blocks(t).select("doc_id", F.explode(passages.headed_blocks(F.col("found"))).alias("b"))
    return rows.select("doc_id", "b.first", "b.last", F.col("b.header").cast("int").alias("header"), "b.heading")


def _marked(role: Column, body: Column, turn: Column) -> Column:
    clock = F.concat(F.lpad((turn % 24).cast("string"), 2, "0"), F.lit(":05"))
    return (
        F.when(role == "user", F.concat(clock, F.lit(" "), role, F.lit(" : "), body))
        .when(role == "assistant", F.concat(F.lit("12 octobre 2026 "), clock, F.lit(" - "), role, F.lit(" : "), body))
        .otherwise(F.concat(F.lit("2026-10-12T08:00:00Z "), body))
    )


@query(
    "txt04_line_classification",
    """WITH l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS body,
      unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations),
    c AS (SELECT *, lpad((turn % 24)::VARCHAR, 2, '0') || ':05' AS clock FROM l)
    SELECT conv_id, turn, i AS line, CASE role WHEN 'user' THEN 'transcript' WHEN 'assistant' THEN 'ticket' ELSE 'log' END AS kind,
      CASE role WHEN 'user' THEN clock WHEN 'assistant' THEN '12 octobre 2026 ' || clock ELSE '2026-10-12T08:00:00Z' END AS stamp,
      CASE WHEN role IN ('user', 'assistant') THEN role END AS author, md5(trim(body)) AS body FROM c""",
)
def classified_lines(t: Tables) -> DataFrame:
    lines = t.conversations.select(
        "conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("pos", "body")
    )
    marked = lines.withColumn("k", passages.line_kind(_marked(F.col("role"), F.col("body"), F.col("turn"))))
    return marked.select(
        "conv_id", "turn", (F.col("pos") + 1).alias("line"), "k.kind", "k.stamp", "k.author",
        F.md5(F.coalesce("k.body", F.lit(""))).alias("body"),
    )


@query(
    "txt05_itemized_blocks",
    f"""WITH {LINES_SQL}, m AS (SELECT *, {ITEM_SQL.format(c='line')} AS item FROM b WHERE trim(line) <> ''),
    p AS (SELECT *, CASE WHEN item OR coalesce(lag(item) OVER w, TRUE) THEN 1 ELSE 0 END AS opens,
      lead(item) OVER w AS next_item FROM m WINDOW w AS (PARTITION BY doc_id, blk ORDER BY i)),
    r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
    q AS (SELECT doc_id, run, min(i) AS first, max(i) AS last, bool_or(item) AS item, arg_max(next_item, i) AS before_item,
      string_agg(rtrim(line), {NL} ORDER BY i) AS text FROM r GROUP BY doc_id, run)
    SELECT doc_id, first, last, item::INT AS item, md5(text) AS digest FROM q
    WHERE item OR NOT (coalesce(before_item, FALSE) AND first = last AND {HEADING_SQL.format(c='text', item=ITEM_SQL.format(c='text'))})""",
)
def itemized(t: Tables) -> DataFrame:
    lines = passages.lines_of(structured(F.col("text")))
    rows = t.documents.select("doc_id", F.explode(passages.itemized(lines)).alias("b"))
    return rows.select(
        "doc_id", "b.first", "b.last", F.col("b.item").cast("int").alias("item"), F.md5("b.text").alias("digest")
    )


def _message(col: Column) -> Column:
    spaced = F.regexp_replace(col, r"([a-m]\.)\n", "$1\n\n")
    return F.regexp_replace(spaced, r"([n-t]\.)\n", "$1\n\n> Le 12 octobre 2026, Anna Roy écrivait :\n> ")


@query(
    "txt06_message_paragraphs",
    r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([a-m]\.)\n', '\1' || chr(10) || chr(10), 'g'),
      '([n-t]\.)\n', '\1' || chr(10) || chr(10) || '> Le 12 octobre 2026, Anna Roy écrivait :' || chr(10) || '> ', 'g') AS body FROM documents),
    p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(body, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM s),
    e AS (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS n FROM p),
    q AS (SELECT *, len(list_filter(string_split(p, chr(10)), lambda r: NOT starts_with(r, '>'))) = 0 AS quoted FROM e)
    SELECT doc_id, n, quoted::INT AS quoted, CASE WHEN quoted THEN 'Anna Roy' END AS author,
      CASE WHEN quoted THEN '2026-10-12' END AS quoted_date,
      md5(CASE WHEN quoted THEN array_to_string(list_transform(string_split(p, chr(10)), lambda r: rtrim(ltrim(r, '> '))), chr(10)) ELSE p END) AS digest FROM q""",
)
def message_paragraphs(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(passages.message_paragraphs(_message(F.col("text")))).alias("pos", "p"))
    return rows.select(
        "doc_id", (F.col("pos") + 1).alias("n"), F.col("p.quoted").cast("int").alias("quoted"), "p.author",
        dates.first_date(F.col("p.dated")).alias("quoted_date"), F.md5("p.text").alias("digest"),
    )


PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]


@query(
    "txt07_table_row_passages",
    """SELECT p_partkey, concat_ws(' | ', 'p_partkey: ' || p_partkey, 'p_name: ' || p_name, 'p_brand: ' || p_brand,
      'p_type: ' || p_type, 'p_size: ' || p_size) AS text, 5 AS n_cells, 'p_brand: ' || p_brand AS brand_cell,
      'part!A' || (p_partkey + 2) || ':F' || (p_partkey + 2) || ' (ligne ' || (p_partkey + 2) || ')' AS locator,
      CASE WHEN p_size > 25 THEN '2026-10-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') ELSE '2026-09' END AS date FROM part""",
)
def row_passages(t: Tables) -> DataFrame:
    rows = t.part.withColumn(
        "note", F.when(F.col("p_size") > 25, F.concat(F.lit("vu le "), (F.col("p_size") % 28 + 1).cast("string"), F.lit(" octobre")))
    )
    body, cells = passages.row_passage(PART_COLUMNS)
    row = (F.col("p_partkey") + 2).cast("string")
    document = dates.date_from_stem(F.lit("stock_septembre"))
    return rows.withColumn("cells", cells).select(
        "p_partkey", body.alias("text"), F.size("cells").alias("n_cells"), F.col("cells")["p_brand"].alias("brand_cell"),
        F.concat(F.lit("part!A"), row, F.lit(":F"), row, F.lit(" (ligne "), row, F.lit(")")).alias("locator"),
        F.coalesce(dates.first_date(F.col("note")), document).alias("date"),
    )


@query(
    "txt08_cell_comment_passages",
    """WITH r AS (SELECT 'R' || (n_nationkey + 2) AS id, concat_ws(' | ', 'n_nationkey: ' || n_nationkey, 'n_name: ' || n_name) AS text,
        NULL::VARCHAR AS author, '2026-09' AS date FROM nation),
    c AS (SELECT 'CB' || (n_nationkey + 2) AS id, 'Commentaire sur B' || (n_nationkey + 2) || ' (' || n_name || ') : revu le '
        || (n_nationkey + 1) || ' mai' AS text, r_name AS author, '2026-05-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') AS date
        FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT * FROM r UNION ALL SELECT * FROM c""",
)
def comment_passages(t: Tables) -> DataFrame:
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    number = (F.col("n_nationkey") + 2).cast("string")
    document = dates.date_from_stem(F.lit("pays_septembre"))
    body, _ = passages.row_passage(["n_nationkey", "n_name"])
    rows = places.select(
        F.concat(F.lit("R"), number).alias("id"), body.alias("text"), F.lit(None).cast("string").alias("author"), document.alias("date")
    )
    note = F.concat(F.lit("revu le "), (F.col("n_nationkey") + 1).cast("string"), F.lit(" mai"))
    cell = F.concat(F.lit("B"), number)
    comments = places.select(
        F.concat(F.lit("C"), cell).alias("id"),
        F.concat(F.lit("Commentaire sur "), cell, F.lit(" ("), F.col("n_name"), F.lit(") : "), note).alias("text"),
        F.col("r_name").alias("author"), F.coalesce(dates.first_date(note), document).alias("date"),
    )
    return rows.unionByName(comments)


@query(
    "txt09_page_chunks",
    rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS ls FROM documents),
    w AS (SELECT doc_id, array_to_string(ls, ' | ') AS whole FROM d), l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
    r AS (SELECT doc_id, i, length(line) AS held, 0 AS chunk FROM l WHERE i = 1
      UNION ALL SELECT l.doc_id, l.i, CASE WHEN r.held > {passages.CHUNK_SIZE} THEN 0 ELSE r.held END + length(l.line), r.chunk + (r.held > {passages.CHUNK_SIZE})::INT FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1),
    c AS (SELECT doc_id, chunk, string_agg(line, ' | ' ORDER BY i) AS body FROM r JOIN l USING (doc_id, i) GROUP BY ALL),
    o AS (SELECT doc_id, 0 AS chunk, whole AS body FROM w WHERE length(whole) <= {passages.PAGE_LIMIT} UNION ALL SELECT c.* FROM c JOIN w USING (doc_id) WHERE length(whole) > {passages.PAGE_LIMIT})
    SELECT doc_id, chunk, length(body) AS n_chars, md5(body) AS digest FROM o""",
)
def page_chunks(t: Tables) -> DataFrame:
    """Greedy chunks of whole lines; the order-dependent reset is a recursion in the check SQL."""
    return t.documents.select("doc_id", F.posexplode(passages.page_chunks(F.col("text"))).alias("chunk", "body")).select(
        "doc_id", "chunk", F.length("body").alias("n_chars"), F.md5("body").alias("digest")
    )


@query(
    "txt10_first_date_in_text",
    r"""WITH d AS (SELECT doc_id, doc_id % 28 + 1 AS day, regexp_extract(text, '\b(\d{4})[-.](\d{2})[-.](\d{2})', ['y', 'm', 'd']) AS i FROM documents)
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '2026-08-' || lpad(day::VARCHAR, 2, '0')
      WHEN 1 THEN '2025-02-' || lpad(day::VARCHAR, 2, '0') || 'T14:05:00-04:00' WHEN 2 THEN '2024-12-' || lpad(day::VARCHAR, 2, '0') || 'T08:30:00-04:00'
      WHEN 3 THEN '2026-05-' || lpad(day::VARCHAR, 2, '0')
      ELSE strftime(try_cast(i.y || '-' || i.m || '-' || i.d AS DATE), '%Y-%m-%d') END AS found FROM d""",
)
def first_dates(t: Tables) -> DataFrame:
    """A date is written in front of four texts in five; the fifth keeps what its text says."""
    day = (F.col("doc_id") % 28 + 1).cast("string")
    case = F.col("doc_id") % 5
    dated = (
        F.when(case == 0, F.concat(F.lit(" le "), day, F.lit(" août puis 2026-12-01 ")))
        .when(case == 1, F.concat(F.lit(" le "), day, F.lit(" février 2025 à 14h05 ")))
        .when(case == 2, F.concat(F.lit(" 2024-12-"), F.lpad(day, 2, "0"), F.lit("T08:30 et le 3 mai ")))
        .when(case == 3, F.concat(F.lit(" 31 chats, "), day, F.lit(" mai. ")))
        .otherwise(F.lit(" 31 maisons "))
    )
    return t.documents.select("doc_id", dates.first_date(F.concat(dated, F.col("text"))).alias("found"))


@query(
    "txt11_normalised_text",
    rf"""SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(replace({SIGNS_SQL}, '…', '...'))),
      '\s+', ' ', 'g'))) AS digest FROM documents""",
)
def normalised(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.normalize(F.col("text"))).alias("digest"))


@query("txt11_composed_text", "SELECT doc_id, md5(nfc_normalize(replace(text, 'oi', 'fi'))) AS digest FROM documents")
def composed_text(t: Tables) -> DataFrame:
    """Texts taken apart (accents as marks, a ligature) come back composed."""
    apart = F.replace(F.col("text"), F.lit("oi"), F.lit("\ufb01"))
    for whole, letter, mark in (("é", "e", "\u0301"), ("è", "e", "\u0300"), ("ê", "e", "\u0302"), ("ç", "c", "\u0327")):
        apart = F.replace(apart, F.lit(whole), F.lit(letter + mark))
    return t.documents.select("doc_id", apart.alias("text")).select("doc_id", F.md5(composition.composed(F.col("text"))).alias("digest"))


@query(
    "txt12_content_hash_and_fingerprint",
    r"""SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS content_hash,
      sha256(lang || chr(0) || source || chr(0)) AS fingerprint FROM documents""",
)
def hashes(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", text.content_hash(F.col("text")).alias("content_hash"),
        text.fingerprint(F.col("lang"), F.col("source")).alias("fingerprint"),
    )


@query(
    "txt13_ordered_quote_containment",
    rf"""WITH c AS (SELECT doc_id, trim(lower(regexp_replace(replace(replace(replace(replace({SIGNS_SQL}, '…', '...'),
        '**', ''), ' | ', ' '), '"', ''), '\s+', ' ', 'g'))) AS h FROM documents),
    f AS (SELECT doc_id, h, trim(left(h, 20)) AS a, trim(right(h, 20)) AS b FROM c),
    p AS (SELECT doc_id, strpos(h, a) AS pa, length(a) AS la, strpos(h, b) AS pb, length(b) AS lb, h, a, b FROM f)
    SELECT doc_id, (h <> '' AND strpos(substr(h, pa + la), b) > 0)::INT AS in_order,
      (h <> '' AND strpos(substr(h, pb + lb), a) > 0)::INT AS reversed, 0 AS empty FROM p""",
)
def quote_containment(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("h", text.comparable(F.col("text")))
    head, tail = F.trim(F.left("h", F.lit(20))), F.trim(F.right("h", F.lit(20)))
    mark = F.lit(" [...] ")
    check = lambda quote: text.contains_quote(F.col("text"), quote).cast("int")
    return rows.select(
        "doc_id", check(F.concat(head, mark, tail)).alias("in_order"), check(F.concat(tail, F.lit(" … "), head)).alias("reversed"),
        check(F.lit(" ... ")).alias("empty"),
    )


STOPS_SQL = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
TOKENS_SQL = (
    "list_transform(list_filter(string_split_regex(lower(strip_accents({c})), '[^a-z0-9]+'), lambda w: length(w) > 1 AND NOT "
    f"list_contains({STOPS_SQL}, w)), lambda w: CASE WHEN regexp_full_match(w, '\\d+') THEN w ELSE substr(regexp_replace(w, '[sx]$', ''), 1, 6) END)"
)


@query(
    "txt14_search_tokens",
    f"WITH k AS (SELECT doc_id, {TOKENS_SQL.format(c='text')} AS ts FROM documents) "
    "SELECT doc_id, len(ts) AS n, md5(array_to_string(ts, ' ')) AS digest FROM k",
)
def search_tokens(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", text.tokens(F.col("text")).alias("ts"))
    return rows.select("doc_id", F.size("ts").alias("n"), F.md5(F.array_join("ts", " ")).alias("digest"))


def with_references(col: Column, key: Column) -> Column:
    """Text with references put in front, by key."""
    n = F.lpad((key % 7 + 1).cast("string"), 2, "0")
    front = (
        F.when(key % 4 == 0, F.concat(F.lit("CR-"), n, F.lit(" au 15 octobre, audit. ")))
        .when(key % 4 == 1, F.concat(F.lit("INV-"), n, F.lit(" 18 000 $ budget; ACC-30"), (key % 3).cast("string"), F.lit(". ")))
        .when(key % 4 == 2, F.concat(F.lit("Runbook et connecteur, CR-"), n, F.lit(" le 22. ")))
        .otherwise(F.lit("Accessibilité mobile, doublon. "))
    )
    return F.concat(front, col)


REFERENCES_SQL = """(CASE doc_id % 4 WHEN 0 THEN 'CR-' || lpad((doc_id % 7 + 1)::VARCHAR, 2, '0') || ' au 15 octobre, audit. '
  WHEN 1 THEN 'INV-' || lpad((doc_id % 7 + 1)::VARCHAR, 2, '0') || ' 18 000 $ budget; ACC-30' || (doc_id % 3) || '. '
  WHEN 2 THEN 'Runbook et connecteur, CR-' || lpad((doc_id % 7 + 1)::VARCHAR, 2, '0') || ' le 22. '
  ELSE 'Accessibilité mobile, doublon. ' END || text)"""


def _entities_sql(c: str) -> str:
    parts = []
    for pattern, label in text.ENTITY_RULES:
        p = pattern.replace(r"(?!\s*\d)", r"([^0-9 ]|\s+[^0-9 ]|\s*$)").replace("'", "''").replace(r")\b([^", r")([^")
        if label is None:
            parts.append(f"regexp_extract_all(lower({c}), '{p}')")
        else:
            parts.append(f"CASE WHEN regexp_matches(lower({c}), '{p}') THEN ['{label}'] ELSE [] END")
    return f"list_sort(list_distinct(flatten([{', '.join(parts)}])))"


ENTITIES_SQL = _entities_sql("body")


@query(
    "txt15_entities_by_rules",
    f"""WITH b AS (SELECT doc_id, {REFERENCES_SQL} AS body FROM documents)
    SELECT doc_id, array_to_string({ENTITIES_SQL}, ',') AS found FROM b""",
)
def entities(t: Tables) -> DataFrame:
    found = text.entities(with_references(F.col("text"), F.col("doc_id")))
    return t.documents.select("doc_id", F.array_join(F.array_sort(found), ",").alias("found"))


@query(
    "txt16_locator_parsing",
    """WITH d AS (SELECT doc_id, doc_id % 50 + 1 AS a, doc_id % 50 + 1 + n_chars % 90 AS z FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN a || '-' || z WHEN doc_id % 3 = 1 THEN a || '-' || a ELSE '' END AS lines,
      CASE WHEN doc_id % 3 = 0 THEN '14:05' ELSE '' END AS times, CASE WHEN doc_id % 3 = 1 THEN a || '-' || a ELSE '' END AS pages,
      CASE WHEN doc_id % 3 = 2 THEN a || '-' || (a + 2) ELSE '' END AS paragraphs,
      (doc_id % 3 = 2)::INT AS header FROM d""",
)
def locators(t: Tables) -> DataFrame:
    a, case = F.col("doc_id") % 50 + 1, F.col("doc_id") % 3
    z = a + F.col("n_chars") % 90
    s = lambda c: c.cast("string")
    locator = (
        F.when(case == 0, F.concat(F.lit("L"), s(a), F.lit("-L"), s(z), F.lit(" [14h05]")))
        .when(case == 1, F.concat(F.lit("p. "), s(a), F.lit(", ligne "), s(a)))
        .otherwise(F.concat(F.lit("en-tête §"), s(a), F.lit("-"), s(a + 2)))
    )
    rows = t.documents.withColumn("p", text.parse_locator(locator, F.lit(False)))
    join = lambda c: F.array_join(F.transform(F.col(f"p.{c}"), lambda v: F.concat_ws("-", v["first"].cast("string"), v["last"].cast("string"))), ",").alias(c)
    return rows.select("doc_id", *[join(c) for c in ("lines", "pages", "paragraphs")], F.array_join("p.times", ",").alias("times"), F.col("p.header").cast("int").alias("header"))


@query(
    "txt17_owner_split",
    """WITH o AS (SELECT c_custkey, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
    p AS (SELECT c_custkey, unnest([n_name || ' (chef)', c_mktsegment || ' (appui)', 'NATION_1 et NATION_24']) AS part FROM o),
    k AS (SELECT c_custkey, part, n.n_name FROM p LEFT JOIN nation n ON strpos(part, n.n_name) > 0)
    SELECT DISTINCT c_custkey, coalesce(n_name, trim(string_split(part, '(')[1])) AS owner FROM k""",
)
def owners(t: Tables) -> DataFrame:
    names = t.nation.agg(F.array_sort(F.collect_list("n_name")).alias("names"))  # closed list of names, one row
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).withColumn(
        "owner", F.concat(F.col("n_name"), F.lit(" (chef) / "), F.col("c_mktsegment"), F.lit(" (appui) avec NATION_1 et NATION_24"))
    )
    return rows.join(F.broadcast(names)).select(
        "c_custkey", F.explode(text.split_owners(F.col("owner"), F.col("names"))).alias("owner")
    )


@query(
    "txt18_natural_sort_key",
    r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_brand || '-' || p_size || p_type, '\d+|\D+'),
      lambda r: CASE WHEN regexp_matches(r, '^\d') THEN lpad(length(coalesce(nullif(ltrim(r, '0'), ''), '0'))::VARCHAR, 10, '0') || coalesce(nullif(ltrim(r, '0'), ''), '0') ELSE r END), '') AS sort_key FROM part""",
)
def natural_keys(t: Tables) -> DataFrame:
    label = F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string"), F.col("p_type"))
    return t.part.select("p_partkey", text.natural_key(label).alias("sort_key"))
