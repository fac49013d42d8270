"""Document corpus: duplicates, candidate pairs, consolidated state and its changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.functions.binding import lookup
from ravelin.operators.ordering import top_per_key
from ravelin.session import cut_lineage

MIN_COPY_LENGTH = 40
MIN_STATEMENT_LENGTH = 25
STATUS_SUBJECT = "status_reporting"
STATUS_WINDOW_DAYS = 21
SUPPORTING = 4
YES = 0.5

# Rank of natures when pairs are built.
PAIR_NATURE_RANK = {
    "approval": 9, "decision": 8, "validation": 7, "owner_change": 7, "payment": 6, "invoice": 6, "proposal": 5,
    "delivery": 5, "risk": 4, "finding": 4, "commitment": 3,
}
# Rank of natures in the state.
STATE_NATURE_RANK = {
    "approval": 9, "decision": 8, "validation": 7, "owner_change": 7, "payment": 6, "invoice": 6, "finding": 5,
    "risk": 5, "delivery": 4, "commitment": 3, "proposal": 2, "information": 1, "noise": 0,
}
# Rank of document kinds.
KIND_RANK = {
    "adr": 6, "contract": 6, "project_doc": 5, "meeting": 4, "email": 3, "invoice": 3, "ticket": 2, "image": 2,
    "csv": 2, "teams": 1, "archive": 0, "event": 3,
}
# Entity of a status report -> subject it speaks about.
STATUS_TOPICS = {
    "topic:security": "security", "topic:accessibility": "accessibility", "runbook": "operations_runbook",
    "topic:budget": "vendor_contract", "slot:october_date": "go_live_date",
}
# Fixed values: (rule, nature of the newer, natures of the older) that never replaces.
GUARDS = [("R2", "proposal", ("decision", "approval")), ("R3", "delivery", ("finding", "risk", "validation"))]


# ---- duplicates -------------------------------------------------------------------------------


def text_length(passages: DataFrame) -> Column:
    """Length of the text: a narrow table carries it as ``n_text`` in place of the text."""
    return F.col("n_text") if "n_text" in passages.columns else F.length("text")


def source_copies(passages: DataFrame, source: str, path: str, suffix: str, digest: str) -> DataFrame:
    """Sources whose passages are the same set of (suffix, hash): each copy with the first source by path.

    The signature is a commutative digest: the four 64-bit words of sha256(suffix, hash) are
    summed, so a source of any size is reduced on the map side and never collected.
    """
    word = lambda i: F.conv(
        F.substring(F.sha2(F.concat_ws("\x00", F.col(suffix).cast("string"), F.col(digest)), 256), 1 + 16 * i, 16), 16, 10
    ).cast("decimal(20,0)")
    signed = passages.groupBy(source, path).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(word(i)).alias(f"_w{i}") for i in range(4)]
    )
    signature = ["_n", "_w0", "_w1", "_w2", "_w3"]
    first = signed.groupBy(*signature).agg(F.min(F.struct(path, source)).alias("_first"))
    return (
        signed.join(first, signature)
        .where(F.col(f"_first.{source}") != F.col(source))
        .select(source, F.col(f"_first.{source}").alias("copy_of"))
    )


def text_copies(passages: DataFrame, min_length: int = MIN_COPY_LENGTH) -> DataFrame:
    """Passages (id, source_id, attachment_of, path, text, sha256) that repeat a text of another origin.

    The canonical passage of a text is the first by (not an attachment, path, id); it is found
    by a map-side minimum, so a text repeated everywhere costs one row per task.
    """
    long = passages.where(text_length(passages) >= min_length).select("id", "source_id", "attachment_of", "path", "sha256")
    order = F.struct(F.col("attachment_of").isNotNull().alias("att"), "path", "id", "source_id", "attachment_of")
    canonical = long.groupBy("sha256").agg(F.min(order).alias("_c"))
    other = ~(F.col("_c.source_id").eqNullSafe(F.col("source_id")) & F.col("_c.attachment_of").eqNullSafe(F.col("attachment_of")))
    return (
        long.join(canonical, "sha256")
        .where((F.col("_c.id") != F.col("id")) & other)
        .select("id", F.col("_c.id").alias("duplicate_of"))
    )


def known_documents(new: DataFrame, known: DataFrame, doc: str, digest: str) -> DataFrame:
    """Per new document: does every passage already exist? Known passages are reduced to distinct hashes."""
    hits = new.join(known.select(digest).distinct().withColumn("_seen", F.lit(True)), digest, "left")
    return hits.groupBy(doc).agg(
        F.count(F.lit(1)).alias("passages"), F.bool_and(F.coalesce("_seen", F.lit(False))).alias("is_known")
    )


def roots(pointers: DataFrame, child: str, parent: str) -> DataFrame:
    """Last element of each pointer chain, by pointer doubling: chains of length n need log2(n) rounds; a cycle is an error."""
    current = cut_lineage(pointers.select(F.col(child).alias("id"), F.col(parent).alias("root")))
    steps = current.count().bit_length() + 1
    while True:
        further = current.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        stepped = cut_lineage(
            current.join(further, "root", "left").select(
                "id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            )
        )
        current = stepped.select("id", "root")
        if stepped.where("_moved").isEmpty():
            break
        steps -= 1
        if steps < 0:
            raise ValueError("the pointers form a cycle")
    return current.select(F.col("id").alias(child), "root")


def connected_groups(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, group) with group = smallest id of the component; alternating large and small stars.

    Neighbour lists are never collected: each star is a map-side minimum joined back to its edges.
    """
    edges = cut_lineage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(small_low, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small_low.select("u", F.col("m").alias("v"))
        )
        edges = cut_lineage(small.where("u <> v").distinct())
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == state:
            break
        state = seen
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("group"))
    return members.unionByName(members.select(F.col("group").alias("id"), "group").distinct())


# ---- statements and candidate pairs -----------------------------------------------------------


def pair_statements(passages: DataFrame) -> DataFrame:
    """Passages that may enter a pair: no copies, no noise, some authority, long enough."""
    return passages.where(
        F.col("duplicate_of").isNull() & (F.col("subject") != "noise") & (F.col("nature") != "noise")
        & (F.col("authority") >= 1) & (text_length(passages) >= MIN_STATEMENT_LENGTH)
    )


def strongest_per_source(statements: DataFrame) -> DataFrame:
    """Strongest statement of each (subject, source): authority, date, nature rank, risk."""
    order = [
        F.desc("authority"), F.coalesce("date", F.lit("")).desc(), lookup(PAIR_NATURE_RANK, F.col("nature"), 0).desc(),
        F.desc("flags_risk"), F.asc("id"),
    ]
    return top_per_key(statements, ["subject", "source_id"], order).drop("rn")


def _sides(left: str, right: str) -> list[Column]:
    """Ids of a pair, older first; the left one stays first on equal dates."""
    day = lambda s: F.coalesce(F.col(f"{s}_date"), F.lit(""))
    swap = day(left) > day(right)
    return [
        F.when(swap, F.col(f"{right}_id")).otherwise(F.col(f"{left}_id")).alias("a"),
        F.when(swap, F.col(f"{left}_id")).otherwise(F.col(f"{right}_id")).alias("b"),
    ]


def _side(rows: DataFrame, name: str, extra: list[str] | None = None) -> DataFrame:
    keep = ["id", "source_id", "date", "subject", "found", *(extra or [])]
    return rows.select(*[F.col(c).alias(f"{name}_{c}") for c in keep], F.explode("found").alias("entity"))


def same_subject_pairs(strong: DataFrame) -> DataFrame:
    """Statements of one subject, different sources, with a shared entity.

    An equi-join on (subject, entity); a pair that shares several entities is kept on the
    smallest one only, so no distinct is needed.
    """
    rows = strong.where(F.col("subject") != STATUS_SUBJECT)
    left, right = _side(rows, "l"), _side(rows, "r")
    on = (left["entity"] == right["entity"]) & (F.col("l_subject") == F.col("r_subject"))
    joined = left.join(right, on & (F.col("l_id") < F.col("r_id")) & (F.col("l_source_id") != F.col("r_source_id")))
    first = left["entity"] == F.array_min(F.array_intersect("l_found", "r_found"))
    return joined.where(first).select(*_sides("l", "r"), F.col("l_subject").alias("subject"))


def status_pairs(strong: DataFrame) -> DataFrame:
    """Status reports beside statements of the subject they speak about, within the day window."""
    return _status_between(strong, strong)


def _status_between(statements: DataFrame, reporting: DataFrame) -> DataFrame:
    reports = _side(reporting.where(F.col("subject") == STATUS_SUBJECT), "r").withColumn(
        "target", lookup(STATUS_TOPICS, F.col("entity"))
    ).where(F.col("target").isNotNull())
    topics = _side(statements, "l")
    on = (topics["entity"] == reports["entity"]) & (F.col("l_subject") == F.col("target"))
    days = F.abs(F.datediff(F.substring("l_date", 1, 10).cast("date"), F.substring("r_date", 1, 10).cast("date")))
    joined = topics.join(reports, on).where((days <= STATUS_WINDOW_DAYS) & (F.col("l_source_id") != F.col("r_source_id")))
    return joined.select(*_sides("l", "r"), F.col("target").alias("subject")).distinct()


def cross_subject_pairs(strong: DataFrame) -> DataFrame:
    """Statements of different subjects that share a change or invoice reference."""
    rows = strong.withColumn("found", F.filter("found", lambda e: e.rlike("^(cr|inv)-"))).where(F.size("found") > 0)
    left, right = _side(rows, "l"), _side(rows, "r")
    joined = left.join(
        right, (left["entity"] == right["entity"]) & (F.col("l_id") < F.col("r_id"))
        & (F.col("l_subject") != F.col("r_subject")) & (F.col("l_source_id") != F.col("r_source_id")),
    )
    first = left["entity"] == F.array_min(F.array_intersect("l_found", "r_found"))
    label = F.array_join(F.array_sort(F.array("l_subject", "r_subject")), "|")
    return joined.where(first).select(*_sides("l", "r"), label.alias("subject"))


def candidate_pairs(strong: DataFrame) -> DataFrame:
    """All three kinds of pairs; the first builder wins when a pair appears twice."""
    built = [same_subject_pairs(strong), status_pairs(strong), cross_subject_pairs(strong)]
    ranked = [b.withColumn("builder", F.lit(i)) for i, b in enumerate(built)]
    union = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    return union.groupBy("a", "b").agg(F.min(F.struct("builder", "subject")).alias("s")).select("a", "b", "s.subject")


def pairs_touching(changed: DataFrame, around: DataFrame) -> DataFrame:
    """Candidate pairs with at least one statement of ``changed``; ``around`` holds all that share an entity with one, itself included.

    The changed side drives every join, so pairs between unchanged statements aren't made.
    """
    marked = around.join(changed.select("id", F.lit(True).alias("moved")), "id", "left").withColumn("moved", F.coalesce("moved", F.lit(False)))
    once = ~F.col("r_moved") | (F.col("l_id") < F.col("r_id"))
    apart = F.col("l_source_id") != F.col("r_source_id")

    def linked(left: DataFrame, right: DataFrame, subjects: Column) -> DataFrame:
        one, other = _side(left, "l"), _side(right, "r", ["moved"])
        joined = one.join(other, (one["entity"] == other["entity"]) & subjects & apart & once)
        joined = joined.where(one["entity"] == F.array_min(F.array_intersect("l_found", "r_found")))
        # of equal dates the smaller id stays first
        day = lambda s: F.coalesce(F.col(f"{s}_date"), F.lit(""))
        first = (day("l") < day("r")) | ((day("l") == day("r")) & (F.col("l_id") < F.col("r_id")))
        older, newer = (F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("l_id", "r_id"), ("r_id", "l_id")))
        return joined.select(older.alias("a"), newer.alias("b"), "l_subject", "r_subject")

    plain = F.col("subject") != STATUS_SUBJECT
    same = linked(changed.where(plain), marked.where(plain), F.col("l_subject") == F.col("r_subject"))
    status = [(marked, changed), (changed, marked.where(~F.col("moved")))]
    reported = [_status_between(topics, reports) for topics, reports in status]
    named = F.filter("found", lambda e: e.rlike("^(cr|inv)-"))
    named_only = lambda df: df.withColumn("found", named).where(F.size("found") > 0)
    crossed = linked(named_only(changed), named_only(marked), F.col("l_subject") != F.col("r_subject"))
    label = F.array_join(F.array_sort(F.array("l_subject", "r_subject")), "|")
    built = [
        same.select("a", "b", F.lit(0).alias("builder"), F.col("l_subject").alias("subject")),
        *[r.select("a", "b", F.lit(1).alias("builder"), "subject") for r in reported],
        crossed.select("a", "b", F.lit(2).alias("builder"), label.alias("subject")),
    ]
    union = built[0]
    for part in built[1:]:
        union = union.unionByName(part)
    return union.groupBy("a", "b").agg(F.min(F.struct("builder", "subject")).alias("s")).select("a", "b", "s.subject")


def fresh_pairs(candidates: DataFrame, known: DataFrame) -> DataFrame:
    return candidates.join(known.select("a", "b"), ["a", "b"], "left_anti")


# ---- state --------------------------------------------------------------------------------------


def guard_rule(newer: Column, older: Column) -> Column:
    """Rule that keeps the newer statement from replacing the older one, null when none applies."""
    rule = F.lit(None).cast("string")
    for name, nature, protected in reversed(GUARDS):
        rule = F.when((newer == nature) & older.isin(*protected), name).otherwise(rule)
    return rule


def supersessions(pairs: DataFrame, passages: DataFrame) -> DataFrame:
    """Pairs judged as replacements, with the guard that blocks them if any."""
    nature = passages.select("id", "nature")
    a = nature.select(F.col("id").alias("a"), F.col("nature").alias("a_nature"))
    b = nature.select(F.col("id").alias("b"), F.col("nature").alias("b_nature"))
    said = pairs.where(F.col("supersedes") >= YES).join(a, "a").join(b, "b")
    return said.withColumn("rule", guard_rule(F.col("b_nature"), F.col("a_nature")))


def replaced_by(superseded: DataFrame) -> DataFrame:
    return superseded.where(F.col("rule").isNull()).select(F.col("a").alias("id"), F.col("b").alias("by"))


def subject_statements(passages: DataFrame) -> DataFrame:
    """Statements that count for the state: no copies, a stating nature, some authority."""
    natures = [n for n in STATE_NATURE_RANK if n not in ("information", "noise")]
    return passages.where(
        F.col("duplicate_of").isNull() & F.col("nature").isin(natures) & (F.col("authority") >= 1)
        & (F.col("subject") != "noise")
    )


def rank_order(statements: DataFrame) -> list[Column]:
    """Decided before proposed, then authority, day, nature, length, kind, time stamp."""
    return [
        (F.col("nature") != "proposal").desc(), F.desc("authority"), F.substring(F.coalesce("date", F.lit("")), 1, 10).desc(),
        lookup(STATE_NATURE_RANK, F.col("nature"), 0).desc(), text_length(statements).desc(),
        lookup(KIND_RANK, F.col("kind"), 0).desc(), F.coalesce("date", F.lit("")).desc(), F.asc("id"),
    ]


def current(statements: DataFrame, replaced: DataFrame) -> DataFrame:
    """Current statement of each subject."""
    live = statements.join(replaced.select("id").distinct(), "id", "left_anti")
    return top_per_key(live, ["subject"], rank_order(live)).drop("rn")


def supporting(statements: DataFrame, replaced: DataFrame, k: int = SUPPORTING) -> DataFrame:
    """Best statement of up to ``k`` other sources; proposals only where nothing is decided.

    Only the ``k + 1`` best sources of a subject can matter, and each step keeps a bounded
    number of rows per key before it is shuffled.
    """
    live = statements.join(replaced.select("id").distinct(), "id", "left_anti")
    per_source = top_per_key(live, ["subject", "source_id"], rank_order(live)).drop("rn")
    best = top_per_key(per_source, ["subject"], rank_order(live), k + 1, "position")
    decided = F.max((F.col("nature") != "proposal").cast("int")).over(W.partitionBy("subject"))
    kept = best.withColumn("_decided", decided).where((F.col("_decided") == 0) | (F.col("nature") != "proposal"))
    return kept.where(F.col("position") > 1).withColumn("position", F.col("position") - 1).drop("_decided")


def history(statements: DataFrame, replaced: DataFrame) -> DataFrame:
    """Replaced statements with the sorted list of what replaced them."""
    lists = replaced.groupBy("id").agg(F.array_sort(F.collect_set("by")).alias("superseded_by"))
    return statements.join(lists, "id")


def resolve(pairs: DataFrame, passages: DataFrame, replaced: DataFrame, now: DataFrame) -> DataFrame:
    """Winner, loser and rule of each contradiction."""
    gone = replaced.select("id").distinct().withColumn("gone", F.lit(True))
    facts = passages.select("id", "authority", F.coalesce("date", F.lit("")).alias("date")).join(gone, "id", "left")

    def side(s: str) -> DataFrame:
        return facts.select(
            F.col("id").alias(s), F.col("authority").alias(f"{s}_authority"), F.col("date").alias(f"{s}_date"),
            F.coalesce("gone", F.lit(False)).alias(f"{s}_gone"),
        )

    said = pairs.where(F.col("contradicts") >= YES)
    said = said.withColumn("in_subject", F.explode(F.split("subject", r"\|")))
    rows = said.join(side("a"), "a").join(side("b"), "b").join(
        now.select(F.col("subject").alias("in_subject"), F.col("id").alias("current_id")), "in_subject", "left"
    )
    a_auth, b_auth, a_date, b_date = (F.col(c) for c in ("a_authority", "b_authority", "a_date", "b_date"))
    both = F.col("a_gone") & F.col("b_gone")
    side_won = (
        F.when(F.col("a_gone") != F.col("b_gone"), F.when(F.col("a_gone"), "b").otherwise("a"))
        .when(a_auth != b_auth, F.when(a_auth > b_auth, "a").otherwise("b"))
        .when(a_date != b_date, F.when(a_date > b_date, "a").otherwise("b"))
    )
    rows = rows.withColumn("_won", F.when(~both, side_won))
    won = F.when(F.col("_won") == "a", F.col("a")).when(F.col("_won") == "b", F.col("b"))
    lost = F.when(F.col("_won") == "a", F.col("b")).when(F.col("_won") == "b", F.col("a"))
    rule = (
        F.when(both | (F.col("a_gone") != F.col("b_gone")), "R1").when(F.col("_won").isNotNull(), "R4").otherwise("unresolved")
    )
    return rows.select(
        "in_subject", "a", "b", F.coalesce(won, F.col("current_id")).alias("winner"), lost.alias("loser"), rule.alias("rule")
    )


def counters(passages: DataFrame) -> DataFrame:
    """Counters per subject; copies count as passages but not as independent ones."""
    own = F.col("duplicate_of").isNull()
    flag = lambda c: F.count_if(own & (F.col(c) >= YES))
    return passages.where(F.col("subject") != "noise").groupBy("subject").agg(
        F.count(F.lit(1)).alias("passages"), F.count_if(own).alias("independent"),
        F.count_distinct("source_id").alias("sources"), flag("flags_risk").alias("flags_risk"),
        flag("has_deadline").alias("has_deadline"),
    )


def snapshot(passages: DataFrame, pairs: DataFrame, strong: DataFrame) -> DataFrame:
    """One row per subject: current statement, replaced and contradiction counts, counters.

    Both members of a pair are in ``strong``, so the natures are looked up there.
    """
    statements = subject_statements(passages)
    replaced = replaced_by(supersessions(pairs, strong))
    now = current(statements, replaced)
    gone = statements.join(replaced.select("id").distinct(), "id", "left_semi").groupBy("subject").agg(
        F.count(F.lit(1)).alias("superseded")
    )
    fights = pairs.where(F.col("contradicts") >= YES).withColumn("subject", F.explode(F.split("subject", r"\|"))).groupBy(
        "subject"
    ).agg(F.count(F.lit(1)).alias("contradictions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        counters(passages).join(now.select("subject", F.col("id").alias("current_id")), "subject", "left")
        .join(gone, "subject", "left").join(fights, "subject", "left")
        .select("subject", "current_id", "passages", "independent", "sources", "flags_risk", "has_deadline",
                zero("superseded"), zero("contradictions"))
    )


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Subjects of the later snapshot that changed, with counter deltas; a state against itself gives nothing."""
    counts = ["passages", "independent", "sources", "flags_risk", "has_deadline", "superseded", "contradictions"]
    old = before.select("subject", F.col("current_id").alias("current_v1"), *[F.col(c).alias(f"old_{c}") for c in counts])
    new = after.select("subject", F.col("current_id").alias("current_v2"), *counts)
    delta = {f"d_{c}": F.col(c) - F.coalesce(f"old_{c}", F.lit(0)) for c in counts}
    joined = new.join(old, "subject", "left").withColumns(delta)
    moved = ~F.col("current_v1").eqNullSafe(F.col("current_v2"))
    any_delta = F.lit(False)
    for c in counts:
        any_delta = any_delta | (F.col(f"d_{c}") != 0)
    return joined.withColumn("current_changed", moved).where(moved | any_delta).select(
        "subject", "current_v1", "current_v2", "current_changed", *delta
    )
