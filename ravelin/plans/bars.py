"""Queries on bar call-outs, levels and labels written from the part, supplier and nation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import bars
from ravelin.operators.ordering import lag_in_chunks, running_sum_in_chunks
from ravelin.operators.quantiles import grouped_quantile
from ravelin.plans.registry import query
from ravelin.sources.tables import Tables

S = lambda c: c.cast("string")


def callout() -> Column:
    n, k = S(F.col("p_size")), F.col("p_partkey") % 5
    return (
        F.when(k == 0, F.concat(n, F.lit("-20M et "), n, F.lit("-99M")))
        .when(k == 1, F.concat(F.lit("15M @ "), S(F.col("p_size") * 10), F.lit(" mm c/c")))
        .when(k == 2, F.concat(F.lit("Arm. : "), n, F.lit(' 25M 25A12 @ 12"')))
        .when(k == 3, F.concat(n, F.lit("(3)-15M"))).otherwise(F.concat(F.lit("ÉTR : "), n, F.lit("-10M 10M@1'-6\"")))
    )


@query(
    "txt19_bar_callouts",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '||20M|' || p_size || '|' WHEN 1 THEN '||15M||' || (p_size * 10) || '.0'
      WHEN 2 THEN 'VERT|25A12|25M|' || p_size || '|304.8' WHEN 3 THEN 'INTEG|INTEG|15M|' || p_size || '|'
      ELSE 'LIG|LIG|10M|' || p_size || '|;LIG|LIG|10M||457.2' END AS found FROM part""",
)
def callouts(t: Tables) -> DataFrame:
    show = lambda b: F.concat_ws("|", *[F.coalesce(S(b[f]), F.lit("")) for f in ("role", "mark", "size", "qty", "spacing")])
    found = F.array_join(F.transform(bars.parse_bars(callout()), show), ";")
    return t.part.select("p_partkey", found.alias("found"))


@query(
    "txt20_lengths_to_mm",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 1000.0 WHEN 2 THEN round((p_size * 12 + 3) * 25.4, 1)
      WHEN 3 THEN round(p_size * 25.4, 1) END AS length, CASE p_partkey % 5 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN round((p_size * 12 + 3) * 25.4, 1)
      WHEN 3 THEN round(p_size * 25.4, 1) END AS spacing FROM part""",
)
def lengths(t: Tables) -> DataFrame:
    n, k = S(F.col("p_size")), F.col("p_partkey") % 5
    body = (
        F.when(k == 0, F.concat(n, F.lit(" mm"))).when(k == 1, F.concat(n, F.lit(" m"))).when(k == 2, F.concat(n, F.lit("'-3\"")))
        .when(k == 3, F.concat(n, F.lit('"'))).otherwise(F.lit("environ"))
    )
    return t.part.select("p_partkey", bars.length_to_mm(body).alias("length"), bars.spacing_to_mm(F.concat(F.lit("@ "), body)).alias("spacing"))


@query(
    "txt21_levels_and_element_types",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'NIVEAU ' || p_size WHEN 'SMALL' THEN 'RDC' WHEN 'LARGE' THEN 'SOUS-SOL ' || (p_size % 9 + 1) WHEN 'STANDARD' THEN 'FONDATION' WHEN 'PROMO' THEN 'TOIT' END AS level,
      CASE WHEN p_type = 'STANDARD' THEN 'fondation' ELSE CASE WHEN p_size % 10 IN (0, 1, 2) THEN 'fondation' WHEN p_size % 10 = 3 THEN 'poutre' WHEN p_size % 10 = 4 THEN 'mur' WHEN p_size % 10 = 5 THEN 'colonne'
      WHEN p_size % 10 = 6 THEN 'dalle' WHEN p_type = 'ECONOMY' THEN 'dalle' END END AS element FROM part""",
)
def levels(t: Tables) -> DataFrame:
    n = S(F.col("p_size"))
    title = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("Plan de la dalle Niv. "), n)).when(F.col("p_type") == "SMALL", "Plan du rez-de-chaussée")
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("Sous-sol SS"), S(F.col("p_size") % 9 + 1))).when(F.col("p_type") == "STANDARD", "Plan des semelles")
        .when(F.col("p_type") == "PROMO", "Plan du toit").otherwise(F.lit("Notes"))
    )
    return t.part.select(
        "p_partkey", bars.normalize_level(title).alias("level"), bars.element_type(S(F.col("p_size") % 10), title).alias("element")
    )


@query(
    "txt22_misread_label_correction",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 AND (s_suppkey % 7) IN (0, 2) THEN CASE s_suppkey % 7 WHEN 0 THEN 'S' ELSE 'B' END
      WHEN s_suppkey % 3 = 0 THEN substr('SABGTZO', (s_suppkey % 7 + 1)::INT, 1) WHEN s_suppkey % 3 = 1 THEN CASE s_suppkey % 7 WHEN 1 THEN 'A' WHEN 3 THEN 'G' WHEN 4 THEN 'T' WHEN 5 THEN 'Z' ELSE 'O' END END AS fixed FROM supplier""",
)
def misread_labels(t: Tables) -> DataFrame:
    at = (F.col("s_suppkey") % 7).cast("int")
    right, wrong = F.array(*[F.lit(c) for c in "SABGTZO"]), F.array(*[F.lit(c) for c in "5486720"])
    label = F.when(F.col("s_suppkey") % 3 == 0, F.get(right, at)).when(F.col("s_suppkey") % 3 == 1, F.get(wrong, at)).otherwise(F.lit("KX"))
    return t.supplier.select("s_suppkey", bars.fix_label(label, bars.LETTER_FIXES, right).alias("fixed"))


LETTERS, NUMBERS = list("ABGSTZOI"), ["1", "4", "5", "6", "8", "9", "10", "15", "2"]
KNOWN_PAIRS = [f"{a}-{b}" for i, a in enumerate(LETTERS) for j, b in enumerate(NUMBERS) if (i + j) % 2]
_SQL_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_FIX_ROWS = lambda kind, fixes: ", ".join(f"('{kind}', '{seen}', '{meant}')" for seen, all_ in fixes.items() for meant in all_)


@query(
    "txt22_misread_locations",
    rf"""WITH RECURSIVE raw AS (SELECT p_partkey AS k, {_SQL_LIST(LETTERS)}[(p_partkey % 8 + 1)::INT] AS l, {_SQL_LIST(NUMBERS)}[(p_partkey // 8 % 9 + 1)::INT] AS n FROM part),
    seen AS (SELECT k, CASE WHEN k % 3 = 0 THEN translate(l, 'ABGSTZOI', '48657201') ELSE l END || CASE WHEN k % 25 = 0 THEN '.17' WHEN k % 5 = 0 THEN '.' || k % 10 WHEN k % 7 = 0 THEN '4' WHEN k % 11 = 0 THEN chr(39) ELSE '' END AS letter,
      CASE WHEN k % 4 = 1 THEN translate(n, '14568902', 'IASGBSOZ') ELSE n END AS number FROM raw),
    word AS (SELECT DISTINCT 'l' AS kind, regexp_replace(letter, '^(.+\.\d)\d$', '\1') AS label, letter AS shown FROM seen UNION SELECT DISTINCT 'n', regexp_replace(number, '^(.+\.\d)\d$', '\1'), number FROM seen),
    vocab AS (SELECT 'l' AS kind, unnest({_SQL_LIST(LETTERS)}) AS w UNION ALL SELECT 'n', unnest({_SQL_LIST(NUMBERS)})),
    fixes(kind, seen, meant) AS (VALUES {_FIX_ROWS('l', bars.LETTER_FIXES)}, {_FIX_ROWS('n', bars.NUMBER_FIXES)}),
    form AS (SELECT DISTINCT kind, label, 0 AS place, label AS form FROM word UNION SELECT DISTINCT kind, label, 1, substr(label, 1, 1) || '.' || substr(label, 2, 1) FROM word WHERE length(label) = 2),
    chars AS (SELECT DISTINCT kind, unnest(string_split(form, '')) AS c FROM form), opt AS (SELECT kind, c, c AS o FROM chars UNION SELECT kind, seen, meant FROM fixes),
    v(kind, label, place, form, i, made) AS (SELECT kind, label, place, form, 0, '' FROM form UNION ALL SELECT v.kind, label, place, form, i + 1, made || o FROM v JOIN opt ON opt.kind = v.kind AND opt.c = substr(form, i + 1, 1) WHERE i < length(form)),
    hit AS (SELECT DISTINCT v.kind, label, place, made FROM v JOIN vocab ON vocab.kind = v.kind AND (made = w OR (regexp_matches(made, '^.+\.\d$') AND left(made, length(made) - 2) = w)) WHERE i = length(form)),
    own AS (SELECT DISTINCT kind, label FROM hit WHERE place = 0 AND made = label),
    ok AS (SELECT h.kind, h.label, made FROM hit h LEFT JOIN own USING (kind, label) WHERE CASE WHEN own.label IS NOT NULL THEN made = h.label AND place = 0
      ELSE NOT contains(h.label, chr(39)) AND place = (SELECT min(place) FROM hit x WHERE x.kind = h.kind AND x.label = h.label) END),
    both_sides AS (SELECT s.k, a.made || '-' || b.made AS location FROM seen s JOIN word wl ON wl.kind = 'l' AND wl.shown = s.letter JOIN word wn ON wn.kind = 'n' AND wn.shown = s.number
      JOIN ok a ON a.kind = 'l' AND a.label = wl.label JOIN ok b ON b.kind = 'n' AND b.label = wn.label),
    n AS (SELECT k, count(*) AS several FROM both_sides GROUP BY k),
    kept AS (SELECT k, max(location) AS location, count(*) AS c FROM both_sides JOIN n USING (k) WHERE several = 1 OR location IN (SELECT unnest({_SQL_LIST(KNOWN_PAIRS)})) GROUP BY k)
    SELECT s.k AS p_partkey, s.letter, s.number, CASE WHEN c = 1 THEN location END AS location FROM seen s LEFT JOIN kept USING (k)""",
)
def misread_locations(t: Tables) -> DataFrame:
    """Locations of a letter and a number, some characters of which were taken for others; several readings go by the known pairs."""
    k = F.col("p_partkey")
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    letter, number = F.get(listed(LETTERS), (k % 8).cast("int")), F.get(listed(NUMBERS), (F.floor(k / 8) % 9).cast("int"))
    end = F.when(k % 25 == 0, ".17").when(k % 5 == 0, F.concat(F.lit("."), S(k % 10))).when(k % 7 == 0, "4").when(k % 11 == 0, "'").otherwise("")
    rows = t.part.select(
        "p_partkey", F.concat(F.when(k % 3 == 0, F.translate(letter, "ABGSTZOI", "48657201")).otherwise(letter), end).alias("letter"),
        F.when(k % 4 == 1, F.translate(number, "14568902", "IASGBSOZ")).otherwise(number).alias("number"),
    )
    return rows.withColumn("location", bars.fix_location(F.col("letter"), F.col("number"), listed(LETTERS), listed(NUMBERS), listed(KNOWN_PAIRS)))


@query(
    "txt23_one_edit_label_repair",
    """WITH w AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN r_name WHEN 1 THEN substr(r_name, 2) WHEN 2 THEN 'X' || substr(r_name, 2) ELSE 'XX' || substr(r_name, 3) END AS word
      FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    k AS (SELECT c_custkey, word, min(r_name) AS fixed FROM w JOIN region ON levenshtein(word, r_name) <= 1 AND length(r_name) >= length(word) - 1 GROUP BY ALL)
    SELECT w.c_custkey, w.word, k.fixed FROM w LEFT JOIN k USING (c_custkey)""",
)
def one_edit(t: Tables) -> DataFrame:
    labels = t.region.agg(F.array_sort(F.collect_list("r_name")).alias("labels"))  # closed list, one row
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    k, name = F.col("c_custkey") % 4, F.col("r_name")
    word = (
        F.when(k == 0, name).when(k == 1, F.substring(name, 2, 99)).when(k == 2, F.concat(F.lit("X"), F.substring(name, 2, 99)))
        .otherwise(F.concat(F.lit("XX"), F.substring(name, 3, 99)))
    )
    rows = t.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", word.alias("word"))
    return rows.join(F.broadcast(labels)).select("c_custkey", "word", bars.closest_label(F.col("word"), F.col("labels")).alias("fixed"))


AREA_SQL = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in bars.BAR_AREA_MM2.items()) + " END"
SIZES_SQL = "['10M', '15M', '20M', '25M', '99M']"


@query(
    "txt24_plausible_quantities",
    f"""WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, {SIZES_SQL}[l_linenumber % 5 + 1] AS size, (l_quantity * 2)::INT AS qty, l_returnflag = 'A' AS vertical,
      l_quantity * 20 AS spacing, l_linestatus = 'F' AS verified, l_extendedprice AS area, l_returnflag = 'R' AS fixed, (l_tax > 0.05)::INT AS unread FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, (list_contains(['10M', '15M', '20M', '25M', '30M', '35M', '45M', '55M'], size) AND qty > 0 AND qty <= CASE WHEN vertical THEN 60 ELSE 200 END
        AND NOT coalesce(vertical AND area > 0 AND qty * {AREA_SQL.format(c='size')} > 0.08 * area, FALSE))::INT AS plausible,
      CASE WHEN spacing BETWEEN 50 AND 600 THEN spacing END AS spacing,
      round(least(0.8 - CASE WHEN fixed THEN 0.1 ELSE 0 END - CASE WHEN vertical AND NOT verified THEN 0.1 ELSE 0 END, CASE WHEN unread > 0 THEN 0.6 ELSE 1 END), 2)::DOUBLE AS confidence FROM b""",
)
def plausible(t: Tables) -> DataFrame:
    sizes = F.array(*[F.lit(s) for s in ("10M", "15M", "20M", "25M", "99M")])
    size = F.element_at(sizes, F.col("l_linenumber") % 5 + 1)
    vertical = F.col("l_returnflag") == "A"
    read = F.array(F.struct(F.when(vertical, "VERT").otherwise("LIG").alias("role"), (F.col("l_linestatus") == "F").alias("verified")))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        bars.plausible(size, (F.col("l_quantity") * 2).cast("int"), vertical, F.col("l_extendedprice")).cast("int").alias("plausible"),
        bars.spacing_in_range(F.col("l_quantity") * 20).alias("spacing"),
        bars.reading_confidence(read, F.col("l_returnflag") == "R", (F.col("l_tax") > 0.05).cast("int")).alias("confidence"),
    )


ZONES = ["2-20M HAUT", "10M U BAR", "10M ETR ADD", "15M @ 300", "2-25M ADD", "2 20M B", "4 25M", "4-20M", "3-10M ADD", "2 ETRIERS 10M", "15M @ 12\" PEAU"]
ZONES_PLAN = ["LONG", "LIG", "LIG", "LIG", "ADD", "LIG", "LIG", "LONG", "LIG ADD", "LIG ADD", "PEAU"]
ZONES_SHOP = ["SUP", "LIG U", "LIG ADD", "PEAU", "ADD", "INF", "LONG", "LONG", "ADD", "LIG", "PEAU"]


@query(
    "txt25_bar_zones",
    "SELECT p_partkey, " + f"CASE WHEN p_size > 25 THEN {ZONES_SHOP}[p_partkey % 11 + 1] WHEN p_size = 3 AND {ZONES_PLAN}[p_partkey % 11 + 1] = 'LIG' THEN 'PEAU' ELSE {ZONES_PLAN}[p_partkey % 11 + 1] END AS zone FROM part",
)
def zones(t: Tables) -> DataFrame:
    line = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("p_partkey") % 11 + 1).cast("int"))
    return t.part.select("p_partkey", bars.bar_zone(line, F.col("p_size") == 3, F.col("p_size") > 25).alias("zone"))


def label_lines(t: Tables) -> DataFrame:
    """Lines of made-up pages: a page per brand, a line per part in key order, titles larger than labels."""
    k = F.col("p_partkey") % 6
    body = (
        F.when(k == 0, F.concat(F.lit("P-1O"), S(F.col("p_size") % 10), F.lit(" - 300 x 600"))).when(k == 1, F.concat(F.lit("P 2"), S(F.col("p_size"))))
        .when(k == 2, F.lit("400 X 800")).when(k == 3, F.concat(S(F.col("p_size")), F.lit("-20M"))).when(k == 4, F.concat(F.lit("PC-"), S(F.col("p_size")), F.lit(" : note")))
        .otherwise(F.concat(F.lit("4 25M B"), S(F.col("p_size"))))
    )
    size = F.when(k.isin(0, 1, 4), F.when(F.col("p_size") % 7 == 0, 9.0).otherwise(14.0)).otherwise(8.0 + F.col("p_size") % 3)
    return t.part.select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("line"), k.alias("k"), body.alias("body"), size.alias("size"), "p_size")


@query(
    "txt26_structured_titles",
    """WITH l AS (SELECT p_brand AS page, p_partkey AS line, p_partkey % 6 AS k, p_size, CASE WHEN p_partkey % 6 IN (0, 1, 4) THEN CASE WHEN p_size % 7 = 0 THEN 9.0 ELSE 14.0 END ELSE 8.0 + p_size % 3 END AS size FROM part),
    r AS (SELECT page, median(size) AS ref FROM l WHERE k IN (3, 5) GROUP BY page),
    f AS (SELECT *, lead(k) OVER (PARTITION BY page ORDER BY line) AS next_k FROM l)
    SELECT line, CASE k WHEN 0 THEN 'P10' || (p_size % 10) WHEN 1 THEN 'P2' || p_size END AS title FROM f LEFT JOIN r USING (page)
    WHERE (k = 0 OR (k = 1 AND (next_k IS NULL OR next_k IN (0, 2, 3, 5)))) AND (coalesce(ref, 0) = 0 OR size >= 1.3 * ref)""",
)
def titles(t: Tables) -> DataFrame:
    lines = label_lines(t)
    reference = grouped_quantile(lines.where(F.col("k").isin(3, 5)), ["page"], {"reference": F.col("size")})
    # the cell that follows on the same page; a title that ends its line takes it when it starts with a number
    following = lag_in_chunks(lines, ["page"], ["line"], F.floor(F.col("line") / 1024), ["body"], "next_", ahead=True)
    joined = following.withColumnRenamed("next_body", "following").join(reference, "page", "left")
    title = bars.parse_title(F.col("body"), F.col("following"), F.col("size"), F.col("reference"))
    return joined.select("line", title.alias("title")).where(F.col("title").isNotNull())


@query(
    "txt27_band_labels_and_stacks",
    """WITH l AS (SELECT p_brand, p_partkey, p_size, p_partkey % 3 AS k FROM part),
    q AS (SELECT *, CASE k WHEN 0 THEN p_size WHEN 1 THEN p_size + 2 + 3 END AS q FROM l)
    SELECT p_partkey, q::INT AS quantity, (sum(coalesce(q, 0)) OVER (PARTITION BY p_brand ORDER BY p_partkey))::BIGINT AS total,
      CASE WHEN k = 2 THEN p_size % 100 END::INT AS n, CASE WHEN k = 2 THEN 4 END AS m, CASE WHEN k = 2 THEN '15M' END AS size FROM q""",
)
def band_labels(t: Tables) -> DataFrame:
    n, k = S(F.col("p_size")), F.col("p_partkey") % 3
    body = F.when(k == 0, F.concat(n, F.lit(" 20M"))).when(k == 1, F.concat(F.lit("2 + "), n, F.lit(" 15M + 3 15M"))).otherwise(
        F.concat(n, F.lit(" (4) - 15 M"))
    )
    rows = t.part.select("p_brand", "p_partkey", bars.line_quantity(body).alias("quantity"), bars.band_label(body).alias("b"))
    total = running_sum_in_chunks(rows, ["p_brand"], ["p_partkey"], F.floor(F.col("p_partkey") / 1024), F.coalesce("quantity", F.lit(0)), "total")
    return total.select("p_partkey", "quantity", "total", "b.n", "b.m", "b.size")


@query(
    "txt28_title_block",
    """WITH l AS (SELECT p_brand AS page, p_partkey, (p_partkey * 37 % 1000)::DOUBLE AS x, (p_partkey * 91 % 1000)::DOUBLE AS y, 8 + p_size % 12 AS size,
      CASE WHEN p_partkey % 4 = 0 THEN 'S-' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') ELSE p_name END AS body FROM part),
    c AS (SELECT page, body, row_number() OVER (PARTITION BY page ORDER BY size DESC, p_partkey) AS rn FROM l WHERE x >= 800 AND y >= 800 AND body LIKE 'S-%')
    SELECT p.page, c.body AS sheet, p.n FROM (SELECT page, count(*) AS n FROM l GROUP BY 1) p LEFT JOIN c ON c.page = p.page AND rn = 1""",
)
def title_block(t: Tables) -> DataFrame:
    from ravelin.operators.grid import sheet_code

    key = F.col("p_partkey")
    lines = t.part.select(
        F.col("p_brand").alias("page"), key.alias("line"), (key * 37 % 1000).cast("double").alias("x"), (key * 91 % 1000).cast("double").alias("y"),
        (8 + F.col("p_size") % 12).alias("size"),
        F.when(key % 4 == 0, F.concat(F.lit("S-"), F.lpad(S(key % 1000), 3, "0"))).otherwise(F.col("p_name")).alias("body"),
    )
    pages = lines.groupBy("page").agg(F.count(F.lit(1)).alias("n")).withColumns({"width": F.lit(1000.0), "height": F.lit(1000.0)})
    return sheet_code(lines, pages).select("page", "sheet", "n")
