"""Matching in rounds against the plain ordered loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.operators import corpus, reconcile as rec
from ravelin.plans.reconcile import nearby_pairs


def loop_assign(plans, shops, gap):
    used, out = set(), {}
    for pid, grp, cls in plans:
        free = [(gap(cls, c), n, sid) for n, (sid, g, c) in enumerate(shops) if g == grp and sid not in used]
        if free:
            cost, _, sid = min(free)
            used.add(sid)
            out[pid] = sid
    return out


def test_greedy_assign_equals_the_loop_with_a_hot_group(spark):
    random.seed(3)
    for _ in range(3):
        group = lambda: random.choice(["h", "h", "x", "y"])
        plans = [(i, group(), random.randint(0, 3)) for i in range(60)]
        shops = [(100 + i, group(), random.randint(0, 3)) for i in range(45)]
        gap = lambda a, b: abs(a - b)
        p = spark.createDataFrame([(g, c, i, i) for i, g, c in plans], "grp string, cls int, pid int, pos int")
        s = spark.createDataFrame([(g, i, c, n) for n, (i, g, c) in enumerate(shops)], "grp string, sid int, c int, spos int")
        options = p.select("grp", "cls").distinct().join(s, "grp").select("grp", "cls", "sid", F.abs(F.col("cls") - F.col("c")).alias("cost"), "spos")
        got = {r.pid: r.sid for r in rec.greedy_assign(p, options).collect()}
        assert got == loop_assign(plans, shops, gap)


def test_greedy_edges_equals_the_loop(spark):
    random.seed(4)
    edges = list({(random.randint(0, 25), random.randint(0, 25)): round(random.random(), 6) for _ in range(150)}.items())
    used_a, used_b, want = set(), set(), set()
    for d, a, b in sorted((d, a, b) for (a, b), d in edges):
        if a not in used_a and b not in used_b:
            want.add((a, b))
            used_a.add(a)
            used_b.add(b)
    df = spark.createDataFrame([(a, b, d) for (a, b), d in edges], "a int, b int, d double")
    assert {(r.a, r.b) for r in rec.greedy_edges(df, ["d"]).collect()} == want


def loop_edges(edges):
    used_a, used_b, want = set(), set(), set()
    for k, a, b in sorted(edges):
        if a not in used_a and b not in used_b:
            want.add((a, b))
            used_a.add(a)
            used_b.add(b)
    return want


def test_a_chain_of_clashes_takes_few_rounds(spark, caplog):
    """Each edge clashes with the one before it, so the loop settles them one by one."""
    edges = [(float(i), i // 2, (i + 1) // 2) for i in range(2400)]
    df = spark.createDataFrame(edges, "k double, a int, b int")
    with caplog.at_level("INFO"):
        got = {(r.a, r.b) for r in rec.greedy_edges(df, ["k"]).collect()}
    assert got == loop_edges(edges)
    assert sum("pairing round" in m for m in caplog.messages) == 1


def test_large_components_are_worked_down(spark):
    random.seed(9)
    edges = [(round(random.random(), 6), random.randint(0, 30), random.randint(0, 30)) for _ in range(120)]
    edges = list({(a, b): (k, a, b) for k, a, b in edges}.values())
    df = spark.createDataFrame(edges, "k double, a int, b int")
    assert {(r.a, r.b) for r in rec.greedy_edges(df, ["k"], most=6).collect()} == loop_edges(edges)


def test_groups_beyond_the_limit_go_through_rounds(spark, monkeypatch):
    random.seed(10)
    plans = [(i, random.choice("hhhx"), random.randint(0, 3)) for i in range(30)]
    shops = [(100 + i, random.choice("hhx"), random.randint(0, 3)) for i in range(25)]
    p = spark.createDataFrame([(g, c, i, i) for i, g, c in plans], "grp string, cls int, pid int, pos int")
    s = spark.createDataFrame([(g, i, c, n) for n, (i, g, c) in enumerate(shops)], "grp string, sid int, c int, spos int")
    options = p.select("grp", "cls").distinct().join(s, "grp").select("grp", "cls", "sid", F.abs(F.col("cls") - F.col("c")).alias("cost"), "spos")
    monkeypatch.setattr(rec, "COMPONENT", 50)
    assert {r.pid: r.sid for r in rec.greedy_assign(p, options).collect()} == loop_assign(plans, shops, lambda a, b: abs(a - b))


def test_nearby_is_one_to_one_and_in_plan_order(spark):
    random.seed(5)
    plan = [("p", i, random.uniform(0, 4), random.uniform(0, 4), i % 2) for i in range(40)]
    shop = [("p", i, random.uniform(0, 4), random.uniform(0, 4), i % 2) for i in range(30)]
    dist = lambda a, b: round(max(abs(a[2] - b[2]), abs(a[3] - b[3])), 9)
    used, want, pending = set(), {}, []
    for limit, approx, todo in ((0.25, False, plan), (1.0, True, pending)):
        for p in todo:
            c = [(dist(p, s), int(p[4] != s[4]), s[1]) for s in shop if s[1] not in used and dist(p, s) <= limit and (not approx or p[4] == s[4])]
            if c:
                want[p[1]] = min(c)[2]
                used.add(min(c)[2])
            elif not approx:
                pending.append(p)
    a = spark.createDataFrame(plan, "page string, a int, x double, y double, qty int").withColumn("scale", F.lit(1.0))
    b = spark.createDataFrame(shop, "page string, b int, tx double, ty double, s_qty int").withColumn("scale", F.lit(1.0))
    assert {r.a: r.b for r in nearby_pairs(a, b).collect()} == want


def test_align_spacing_equals_the_loop(spark):
    plan = [(0, "10M", 300.0), (1, "15M", None), (2, "20M", 200.0)]
    shop = [(0, "10M", 304.0), (1, "15M", 90.0), (2, "25M", 210.0), (3, "30M", 600.0)]
    df = lambda rows: spark.createDataFrame([("k", *r) for r in rows], "key string, pos int, size string, spacing double")
    got = {(r.p, r.s, r.how) for r in rec.align_spacing(df(plan), df(shop), ["key"]).collect()}
    assert got == {(0, 0, "match"), (1, 1, "match"), (2, 2, "closest"), (0, 3, "rest")}


def test_subset_sums(spark):
    counts = lambda *pairs: F.array(*[F.struct(F.lit(q).alias("qty"), F.lit(n).alias("n")) for q, n in pairs])
    sums = lambda most, *pairs: sorted(spark.range(1).select(rec.subset_sums(counts(*pairs), F.lit(most)).alias("s")).first().s)
    assert sums(20, (3, 1), (5, 1), (7, 1)) == [3, 5, 7, 8, 10, 12, 15]
    assert sums(9, (3, 8), (50, 2), (0, 1)) == [3, 6, 9] and sums(16, (2, 8)) == [2, 4, 6, 8, 10, 12, 14, 16]


def test_connected_groups_and_roots(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 3), (20, 21)], "a long, b long")
    got = {r.id: r.group for r in corpus.connected_groups(links, "a", "b").collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 10, 11, 12, 13], 1), 20: 20, 21: 20}
    chain = spark.createDataFrame([(i + 1, i) for i in range(50)], "c long, p long")
    assert {r.root for r in corpus.roots(chain, "c", "p").collect()} == {0}
    with pytest.raises(ValueError, match="cycle"):
        corpus.roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "c long, p long"), "c", "p")


def test_copies_of_a_text_and_of_a_source(spark):
    long, short = "x" * 40, "y" * 39
    rows = [("a:1", "a", None, "a", long, "h1"), ("b:1", "b", None, "b", long, "h1"), ("a:2", "a", None, "a", long, "h1"), ("c:1", "c", None, "c", short, "h2"), ("d:1", "d", None, "d", short, "h2")]
    df = spark.createDataFrame(rows, "id string, source_id string, attachment_of string, path string, text string, sha256 string")
    assert {(r.id, r.duplicate_of) for r in corpus.text_copies(df).collect()} == {("b:1", "a:1")}
    lines = spark.createDataFrame([("s1", "p1", 0, "h"), ("s1", "p1", 1, "g"), ("s2", "p2", 0, "h"), ("s2", "p2", 1, "g"), ("s3", "p3", 0, "g"), ("s3", "p3", 1, "h")], "s string, p string, i int, h string")
    assert [(r.s, r.copy_of) for r in corpus.source_copies(lines, "s", "p", "i", "h").collect()] == [("s2", "s1")]


def test_state_against_itself_has_no_diff(spark):
    row = [("s", 1, 3, 2, 1, 0, 0, 0, 0)]
    cols = "subject string, current_id long, passages long, independent long, sources long, flags_risk long, has_deadline long, superseded long, contradictions long"
    df = spark.createDataFrame(row, cols)
    assert corpus.diff_snapshots(df, df).count() == 0


def test_pairing_cascade_equals_the_loop(spark):
    from ravelin.plans.reconcile import annotation_pairs

    random.seed(6)

    def side(n, first):
        rows = []
        for i in range(n):
            x, y = round(random.uniform(0, 5), 3), round(random.uniform(0, 5), 3)
            rows.append(("p", first + i, x, y, random.choice("HV"), random.randint(0, 1), random.randint(0, 1), f"{int(x)}:{int(y)}"))
        return rows

    plan, shop = side(45, 0), side(45, 1000)
    edges = []
    for p in plan:
        for s in shop:
            dx, dy = abs(p[2] - s[2]), abs(p[3] - s[3])
            if p[4] == s[4]:
                across, along = (dx, dy) if p[4] == "V" else (dy, dx)
                edges.append((p[1], s[1], round((dx * dx + dy * dy) ** 0.5, 9), p[5] == s[5] and p[6] == s[6], p[5] != s[5] and p[6] != s[6], p[7] == s[7], round(across, 9), round(along, 9)))
    used_a, used_b, want = set(), set(), {}

    def take(candidates, how):
        for e in candidates:
            if e[0] not in used_a and e[1] not in used_b:
                used_a.add(e[0])
                used_b.add(e[1])
                want[e[0]] = (e[1], how)

    take(sorted((e for e in edges if e[2] <= 0.6 and e[3]), key=lambda e: (e[2], e[0], e[1])), "near, same value")
    take(sorted((e for e in edges if e[2] <= 0.6 and not e[3] and e[5]), key=lambda e: (e[4], e[2], e[0], e[1])), "near, same cell")
    take(sorted((e for e in edges if e[5] and not e[4]), key=lambda e: (not e[3], e[2], e[0], e[1])), "same cell")
    free = [e for e in edges if e[0] not in used_a and e[1] not in used_b and e[2] <= 0.8]
    best = lambda i, k: min((f for f in free if f[k] == i), key=lambda f: (f[2], f[0], f[1]))
    take([e for e in free if e[3] and best(e[0], 0) == e and best(e[1], 1) == e], "mutual nearest")
    take(sorted((e for e in edges if e[3] and e[6] <= 0.3 and e[7] <= 3.0), key=lambda e: (e[6], e[7], e[0], e[1])), "same line")
    schema = "page string, id int, x double, y double, axis string, n int, m int, loc string"
    got = {r.a: (r.b, r.how) for r in annotation_pairs(spark.createDataFrame(plan, schema), spark.createDataFrame(shop, schema)).collect()}
    assert got == want


def test_pairing_cascade_keeps_only_edges_of_its_passes(spark, monkeypatch):
    """On a crowded page no pass writes more edges than there are pairs of one value within its reach."""
    from ravelin.plans.reconcile import annotation_pairs

    side = lambda first: [("p", first + i, (i * 37 % 200) / 50, (i * 53 % 200) / 50 + first / 1e5, "HV"[i % 2], i % 3, i % 2, f"{i * 37 % 200 // 50}:{i * 53 % 200 // 50}") for i in range(200)]
    plan, shop = side(0), side(1000)
    schema = "page string, id int, x double, y double, axis string, n int, m int, loc string"
    written, cut = [], rec.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(rec, "cut_lineage", counted)
    assert annotation_pairs(spark.createDataFrame(plan, schema), spark.createDataFrame(shop, schema)).count() > 150
    near = sum(p[4] == s[4] and p[5:7] == s[5:7] and (p[2] - s[2]) ** 2 + (p[3] - s[3]) ** 2 <= 0.36 for p in plan for s in shop)
    assert max(written) <= max(near, 200)


def test_corpus_events_give_the_counters_of_the_whole(spark):
    from ravelin.plans import corpus as bound
    from ravelin.plans.streams import run_corpus
    from ravelin.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    store = run_corpus(t)
    keep = ["subject", "passages", "independent", "sources", "flags_risk"]
    last = {tuple(r) for r in store.read("snapshots", 2).select(*keep).collect()}
    assert last == {tuple(r) for r in corpus.counters(bound.statements(t)).select(*keep).collect()}
    assert store.read("pairs", 2).groupBy("a", "b").count().where("count > 1").isEmpty()
    assert store.read("snapshots", 0).count() > 0 and store.read("diffs", 1).count() > 0


def test_short_quotes_are_found(spark):
    from ravelin.operators import search

    quotes = spark.createDataFrame([(1, "Budget"), (2, "le plan"), (3, "absent"), (4, "a b c d e f g h"), (5, "")], "quote_id int, quote string")
    rows = spark.createDataFrame([(10, "Le budget révisé et le planning"), (11, "sous-budgets"), (12, "x a b c d e f g h y")], "id int, text string")
    got = {(r.quote_id, r.id) for r in search.find_quotes(quotes, rows).collect()}
    assert got == {(1, 10), (1, 11), (2, 10), (4, 12)}


def test_readings_agree_without_an_exchange_of_hashes(spark):
    a = spark.createDataFrame([(1, 5), (1, 5), (1, None), (2, 3), (2, 3), (3, 1), (4, None), (5, 1), (None, 2)], "k int, v int")
    b = spark.createDataFrame([(1, 5), (1, 5), (2, 3), (2, 4), (4, None), (5, 1), (5, 1), (6, 1), (None, 2)], "k int, v int")
    rows = rec.agreement(a, b, "k", F.col("v"))
    assert {(r.k, r.agree) for r in rows.collect()} == {(1, 1), (2, 0), (4, 1), (5, 0)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and "Join" not in plan


NEAR_SIDE = "page string, u double, v double, n int"


def near_rule(du, dv, alike):
    """Within 0.6, equal values first; ``n`` may be unknown."""
    d = rec.rounded(np.sqrt(du * du + dv * dv))
    (same, other), = alike
    return (d <= 0.6) & (same | other), np.where(same, 0, 1), d


def near_pairs(spark, plan, shop, **more):
    p, s = spark.createDataFrame(plan, "a int, " + NEAR_SIDE), spark.createDataFrame(shop, "b int, " + NEAR_SIDE)
    out = rec.greedy_near(p, s, ["page"], (0.61, 0.61), near_rule, rec.repeated_ids(p, s), ["n"], **more)
    return [tuple(r) for r in out.select("p.a", "s.b").collect()]


def near_edges(plan, shop):
    d = lambda p, s: round(((p[2] - s[2]) ** 2 + (p[3] - s[3]) ** 2) ** 0.5, 9)
    near = [(p, s) for p in plan for s in shop if p[1] is not None and p[1] == s[1] and None not in (p[4], s[4]) and d(p, s) <= 0.6]
    return [((int(p[4] != s[4]), d(p, s)), p[0], s[0]) for p, s in near]


def near_side(n, pages, step=0.1, first=0):
    spot = lambda: round(random.randrange(14) * step, 2)
    return [(first + i, random.choice(pages), spot(), spot(), random.choice([0, 1, 1, None])) for i in range(n)]


@pytest.mark.parametrize("most", [None, 20, 1])
def test_near_items_pair_as_the_loop_with_ties_and_in_rounds(spark, most):
    random.seed(12)
    plan, shop = near_side(60, ["x", "x", "y", None]), near_side(50, ["x", "x", "y", None], first=1000)
    assert sorted(near_pairs(spark, plan, shop, most=most)) == sorted(loop_edges(near_edges(plan, shop)))


def test_near_items_of_one_id_are_one_item(spark):
    """Ids come back on other pages and places; rows that come twice give each row of their pair."""
    random.seed(13)
    plan, shop = ([(r[0] % 25, *r[1:]) for r in near_side(40, "xyz")] for _ in range(2))
    assert set(near_pairs(spark, plan, shop)) == set(near_pairs(spark, plan, shop, most=5)) == loop_edges(near_edges(plan, shop))
    assert near_pairs(spark, [(1, "x", 0.0, 0.0, 1)] * 2, [(7, "x", 0.1, 0.0, 1)] * 2 + [(8, "x", 0.2, 0.0, 1)]) == [(1, 7)] * 4


def test_first_edges_of_both_ends(spark):
    random.seed(14)
    plan, shop = near_side(80, "xy"), near_side(70, "xy", first=1000)
    edges = near_edges(plan, shop)
    first = lambda k: {min(e for e in edges if e[k] == i) for i in {e[k] for e in edges}}
    p, s = spark.createDataFrame(plan, "a int, " + NEAR_SIDE), spark.createDataFrame(shop, "b int, " + NEAR_SIDE)
    got = {tuple(r) for r in rec.first_near(p, s, ["page"], (0.61, 0.61), near_rule, ["n"]).select("p.a", "s.b").collect()}
    assert got == {e[1:] for e in first(1) & first(2)}


def test_rounding_in_tasks_is_that_of_spark(spark):
    values = [0.1234567885, 0.1234567895, 0.5, 1.0000000005, 2.9999999995, 0.0, *(random.Random(1).random() * 4 for _ in range(300))]
    want = [r.r for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 9).alias("r")).collect()]
    assert rec.rounded(np.array(values)).tolist() == want


def test_a_crowd_is_paired_without_writing_its_edges(spark, monkeypatch):
    """All 14,400 pairs of the crowd are within reach; what is written stays near its 240 items."""
    from ravelin.plans.reconcile import annotation_pairs

    side = lambda first, n: [("p", first + i, (i * 7 % 40) / 100, (i * 11 % 40) / 100 + first / 1e6, "H", i % n, 0, "0:0") for i in range(120)]
    schema = "page string, id int, x double, y double, axis string, n int, m int, loc string"
    written, cut = [], rec.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(rec, "cut_lineage", counted)
    monkeypatch.setattr(corpus, "cut_lineage", counted)
    assert annotation_pairs(spark.createDataFrame(side(0, 1), schema), spark.createDataFrame(side(1000, 1), schema)).count() == 120
    assert annotation_pairs(spark.createDataFrame(side(0, 3), schema), spark.createDataFrame(side(1000, 2), schema)).count() == 120
    assert max(written) <= 240


def test_first_edges_do_not_depend_on_the_pieces(spark, monkeypatch):
    random.seed(15)
    plan, shop = near_side(30, "x"), near_side(40, "x", first=1000)
    p, s = spark.createDataFrame(plan, "a int, " + NEAR_SIDE), spark.createDataFrame(shop, "b int, " + NEAR_SIDE)
    cell = F.lit(1).cast("long")
    rows = rec._stream(rec._both_sides(p, s).withColumns({"cell": cell, "cx": cell, "cy": cell}), "cell", ["page"], ["n"]).toArrow()

    def told(piece):
        monkeypatch.setattr(rec, "PIECE", piece)
        return sorted(str(r) for b in rec._first_in_cells(iter(rows.to_batches(max_chunksize=9)), near_rule, ["n"]) for r in b.to_pylist())

    edges = near_edges(plan, shop)
    assert told(7) == told(1 << 18) and len(told(7)) == len({e[1] for e in edges}) + len({e[2] for e in edges})
