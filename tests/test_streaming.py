"""Streams over several runs, and the incremental corpus beside one that is computed anew."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ravelin.operators import corpus
from ravelin.sources.files import scratch
from ravelin.streaming import events, incremental, lots

SCHEMA = "event_id long, ts timestamp, event_type string, value double"
RULES = lots.LotRules("ts", "1 day", "1 day", "event_type", 0.0, 10.0)


def event(number, day, hour=12, value=5.0):
    return (number, datetime(2024, 3, 1) + timedelta(days=day, hours=hour), "k", value)


def test_lots_are_published_once_over_restarts_and_late_rows_are_kept_apart(spark):
    folder, out, late, log, states = (scratch(spark, n) for n in ("lots-in", "lots-out", "lots-late", "lots-log", "lots-state"))
    files = [
        [event(0, 0), event(1, 1)],
        [event(2, 0, 1), event(3, 3)],  # a day late, inside the delay
        [event(4, 0, 2), event(5, 4, value=99.0)],  # its lot is closed by this very batch, so it still counts
        [event(6, 0, 3), event(7, 8), event(8, 1)],  # two lots that are closed
        [event(9, 9)],
    ]
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        lots.publish_lots(spark, folder, schema, out, f"{states}/a", RULES)  # a run of its own for every file
        lots.route_late_rows(spark, folder, schema, late, log, f"{states}/b", RULES)
    closed = [(r["lot"]["start"].day, r["n"], r["published"], r["batch"]) for r in lots.read_batches(spark, out).collect()]
    assert sorted(closed) == [(1, 3, 1, 2), (2, 1, 1, 2), (4, 1, 1, 4), (5, 1, 0, 4)]
    assert sorted(r["event_id"] for r in lots.read_batches(spark, late).collect()) == [6, 8]


ROW = "id long, source_id string, attachment_of string, path string, subject string, nature string, kind string, authority double, date string, flags_risk double, has_deadline double, sha256 string, n_text int, found array<string>"


def passages(rng, first, count):
    subjects, sources = ["security", "go_live_date", "status_reporting", "noise"], [f"s{i}" for i in range(5)]
    natures = ["decision", "proposal", "risk", "information", "delivery", "approval"]
    out = []
    for i in range(first, first + count):
        source = rng.choice(sources)
        found = sorted(rng.sample(["topic:security", "runbook", "cr-1", "cr-2", "inv-7", "x"], rng.randrange(0, 4)))
        out.append((i, source, rng.choice([None, None, "p"]), f"{rng.choice('abc')}/{rng.randrange(1000):04d}/{i}", rng.choice(subjects), rng.choice(natures), rng.choice(["email", "adr"]),
                    rng.choice([0.5, 1.0, 2.0, 3.0]), f"2026-09-{rng.randrange(1, 28):02d}", rng.random(), rng.random(), f"h{rng.randrange(30)}", rng.choice([30, 50, 80]), found))
    return out


def judged(pairs):
    return pairs.withColumns({"contradicts": ((pairs.a + pairs.b * 17) % 10) / 10, "supersedes": ((pairs.a * 31 + pairs.b) % 10) / 10})


def test_incremental_corpus_equals_one_computed_anew(spark, monkeypatch):
    monkeypatch.setattr(incremental, "BOARD", 2)
    rng = random.Random(6)
    store = incremental.IncrementalCorpus(spark, scratch(spark, "incremental"), judged, buckets=4)
    seen, known = [], None
    for version, count in enumerate((60, 25)):
        new = passages(rng, 1000 - len(seen) - count, count)  # smaller ids and paths come later, so marks change
        seen += new
        store.on_event(spark.createDataFrame(new, ROW), version)
        rows = spark.createDataFrame(seen, ROW)
        marked = rows.join(corpus.text_copies(rows), "id", "left")
        strong = corpus.strongest_per_source(corpus.pair_statements(marked))
        candidates = corpus.candidate_pairs(strong)
        fresh = judged(candidates if known is None else corpus.fresh_pairs(candidates, known))
        pairs = fresh if known is None else known.unionByName(fresh)
        known = spark.createDataFrame(pairs.collect(), pairs.schema)
        want = corpus.snapshot(marked, known, marked)
        found = store.snapshot(version).select(want.columns)
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, want.collect())))
        stored = store.pairs.whole(version).select("a", "b", "subject")
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, known.select("a", "b", "subject").collect()))


def test_an_event_reads_what_it_touches_and_may_run_again(spark):
    rng = random.Random(7)
    store = incremental.IncrementalCorpus(spark, scratch(spark, "incremental"), judged, buckets=32)
    rows = [(*r[:11], f"h{r[0]}", *r[12:]) for r in passages(rng, 0, 200)]
    store.on_event(spark.createDataFrame(rows, ROW), 0)
    shelves = [store.texts, store.groups, store.strong, store.entities, store.pairs, store.replaced, store.boards, store.subjects]
    for s in shelves:
        s.reads.clear()
    one = (900, "s1", None, "a/1/900", "security", "decision", "adr", 3.0, "2026-09-30", 0.1, 0.1, "h-new", 80, ["x"])
    seen = []
    for _ in range(2):
        store.on_event(spark.createDataFrame([one], ROW), 1)
        seen.append(sorted(map(repr, map(tuple, store.snapshot(1).collect()))))
    assert seen[0] == seen[1]
    assert all(read <= 1 for s in (store.texts, store.groups, store.strong, store.boards, store.subjects) for read, _ in s.reads)
    # its own entities and those of the statement that it takes over from
    assert all(read <= 4 for read, _ in store.entities.reads)
    assert {r["subject"] for r in store.diffs().where("version = 1").collect()} == {"security"}


def test_repeated_keys_are_computed_once_and_null_keys_have_an_answer(spark):
    rows = spark.createDataFrame([(1, "a", "x y"), (2, "a", "x y"), (3, "b", None), (4, None, "x y"), (5, "b", None)], "id long, lang string, text string")
    seen = []

    def compute(df):
        seen.append(df)
        return df.withColumn("value", F.concat_ws("/", F.coalesce("lang", F.lit("-")), F.coalesce("text", F.lit("-"))))

    out = {r.id: r.value for r in events.dedup_apply(rows, ["lang", "text"], compute).collect()}
    assert out == {1: "a/x y", 2: "a/x y", 3: "b/-", 4: "-/x y", 5: "b/-"} and seen[0].count() == 3


def test_dedup_joins_on_the_fingerprint(spark):
    rows = spark.createDataFrame([(1, "x y")], "id long, text string")
    plan = events.dedup_apply(rows, ["text"], lambda df: df.withColumn("value", F.length("text")))._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Join" in line]
    assert keys and all("[_key" in line and "[text" not in line for line in keys)
