"""Secret scans with built-in functions only: fixed patterns, and windows of high Shannon entropy in candidate strings.

Base kinds (leftmost matches that don't overlap, then failing ones dropped): ``assign``, ``access``, ``hex``. The method adds ``entropy``
spans: candidates are runs of key characters; the smallest character class that holds a candidate gives window length and threshold. A
window slides over the candidate one character at a time: the counts of the characters in it change by one entering and one leaving
character, and the sum of ``c * log2(c)`` over the counts follows from those two counts alone, so a step doesn't recompute the window. A
candidate is folded in blocks of places and a text's matches in blocks of matches, so a long candidate or a text of many takes time in
proportion to its length.
Window entropy is ``log2(w) - sum / w``. Windows over the threshold that touch or overlap are one span. A candidate that contains an
allow-listed string (ignoring ASCII case) or is a single run of an alphabet is suppressed; base spans never are.

The sums are whole numbers (millionths of a bit), so no rounding error builds up and every engine finds the same windows.

Masking also judges the runs of one class inside a candidate (``RUNS``), each as a candidate of its own, with its own window, threshold and
allow-list; so a key behind ``key=`` or ``API_`` is found. The query judges whole candidates only, which its check SQL prescribes.

Spans are code points, end exclusive, listed by start, then kind in the order assign, access, hex, entropy. Defined results: null and
empty texts have no spans; repeated rows are scanned one by one; columns named like results are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.binding import let
from ravelin.llm.registry import query, table

#: The base patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
#: Runs of one character set: the greedy match with ``+`` of at least so many characters is the same as these.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Runs of one class inside a candidate: a key joined to a name by a sign or by letters of another class is judged by its own class.
RUNS = ("[0-9a-fA-F]{20,}", "[A-Z0-9]{20,}", "[A-Za-z0-9]{20,}")
KINDS = ("assign", "access", "hex", "entropy")
UNIT = 1_000_000


@dataclass(frozen=True)
class CharClass:
    """Candidates of characters of ``pattern`` only; ``window`` characters need ``bits`` of entropy."""

    name: str
    pattern: str
    window: int
    bits: float

    def weights(self) -> list[int]:
        """c * log2(c) for the counts 0..window, in millionths of a bit."""
        return [round(UNIT * c * math.log2(c)) if c else 0 for c in range(self.window + 1)]

    def alphabet(self) -> str:
        """Its characters, in order."""
        return "".join(c for c in map(chr, range(128)) if re.match(self.pattern, c))

    def most(self) -> int:
        """Largest sum over the counts at which a window still has ``bits`` of entropy."""
        return math.floor(UNIT * self.window * (math.log2(self.window) - self.bits))


#: From the smallest class to the largest: a candidate belongs to the first that holds it. Digits alone are numbers, not keys.
CLASSES = (
    CharClass("hex", "^[0-9a-fA-F]+$", 20, 3.0),
    CharClass("upper", "^[A-Z0-9]+$", 20, 3.4),
    CharClass("mixed", "^[A-Za-z0-9+/_=-]+$", 20, 3.7),
)
DIGIT = "[0-9]"
ALLOW = ("example", "placeholder", "changeme", "xxxxxxxx", "00000000", "abcdefghij", "0123456789")


SPAN = "struct<start:int,end:int,kind:string,value:int>"
MATCH = "struct<start:int,end:int,kind:string,value:int,string:string>"
#: Lists in folds grow by copying, so folds run over blocks: of matches, and of places of a candidate.
MATCH_BLOCK, PLACE_BLOCK = 256, 1024


def _matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Matches (start, end, kind, value, string) whose ``group`` has at least ``least`` characters.

    The pieces between the matches give the places: match k starts after k + 1 pieces and k matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    rows = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), F.transform(matches, lambda x: F.length(x)).alias("long"), F.transform(values, lambda x: F.length(x)).alias("value"), matches.alias("string")
    )
    empty = F.expr(f"cast(array() as array<{MATCH}>)")

    def block(rows: Column, first: Column) -> Column:
        """Matches from number ``first`` on; those before it only say where it starts."""
        before = F.aggregate(F.slice(rows, 1, first), F.lit(0), lambda at, r: at + r["gap"] + r["long"])
        start = F.struct(before.alias("at"), empty.alias("found"))

        def step(acc: Column, r: Column) -> Column:
            end = acc["at"] + r["gap"] + r["long"]
            match = F.struct((acc["at"] + r["gap"]).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), r["value"].alias("value"), r["string"].alias("string"))
            return F.struct(end.alias("at"), F.concat(acc["found"], F.array(match)).alias("found"))

        return F.aggregate(F.slice(rows, first + 1, MATCH_BLOCK), start, step, lambda acc: F.filter(acc["found"], lambda m: m["value"] >= least))

    def places(rows: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(rows) - 1, F.lit(MATCH_BLOCK)), lambda first: block(rows, first)))

    whole = let(F.filter(rows, lambda r: r["long"].isNotNull()), places)
    return F.when(F.regexp_like(text, F.lit(pattern)), whole).otherwise(empty)


def located(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans (start, end, kind, value) of ``_matches``."""
    return F.transform(_matches(text, pattern, kind, group, least), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), m["value"].alias("value")))


def _touching(spans: Column) -> Column:
    """Windows (from, to) in order, those that touch or overlap as one. All are of one length, so neighbours tell."""
    fresh = F.filter(spans, lambda x, i: (i == 0) | (F.get(spans, i - 1)["to"] < x["from"]))
    last = F.filter(spans, lambda x, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["from"] > x["to"]))
    return F.zip_with(fresh, last, lambda a, b: F.struct(a["from"].alias("from"), b["to"].alias("to")))


def _high_windows(candidate: Column, kind: CharClass) -> Column:
    """0-based (from, to) of the merged windows of ``candidate`` with enough entropy.

    The candidate is turned into numbers of its characters once. Blocks of places are folded one by one; each starts with the window
    before it, so a step only knows the counts of the characters in its window.
    """
    w, weights = kind.window, F.array(*[F.lit(x) for x in kind.weights()])
    value = lambda c: F.element_at(weights, c + 1)
    empty = F.expr("cast(array() as array<struct<from:int,to:int>>)")

    def block(codes: Column, first: Column) -> Column:
        """Windows that end at the places ``first`` (from 1) to the block's last."""
        origin = F.greatest(first - w, F.lit(1))

        def step(acc: Column, i: Column) -> Column:
            """The character at place ``i`` enters, the one ``w`` places before leaves; their two counts change the sum."""
            enter, leave = F.get(codes, i - 1), F.when(i - w >= origin, F.get(codes, i - 1 - w)).otherwise(F.lit(-1))
            now, was = F.get(acc["counts"], enter), F.coalesce(F.get(acc["counts"], F.nullif(leave, F.lit(-1))), F.lit(1))
            total = acc["sum"] + F.when(enter == leave, 0).otherwise(value(now + 1) - value(now) + value(was - 1) - value(was))
            counts = F.transform(acc["counts"], lambda c, k: c + (k == enter).cast("int") - (k == leave).cast("int"))
            good = (i >= first) & (i >= w) & (total <= kind.most())
            last = F.try_element_at(acc["spans"], F.lit(-1))
            joined = F.when(
                F.coalesce(last["to"] >= i - w, F.lit(False)),
                F.concat(F.slice(acc["spans"], 1, F.size(acc["spans"]) - 1), F.array(F.struct(last["from"].alias("from"), i.alias("to")))),
            ).otherwise(F.concat(acc["spans"], F.array(F.struct((i - w).alias("from"), i.alias("to")))))
            return F.struct(total.alias("sum"), F.when(enter == leave, acc["counts"]).otherwise(counts).alias("counts"), F.when(good, joined).otherwise(acc["spans"]).alias("spans"))

        start = F.struct(F.lit(0).alias("sum"), F.array_repeat(F.lit(0), len(kind.alphabet())).alias("counts"), empty.alias("spans"))
        ends = F.sequence(origin, F.least(first + (PLACE_BLOCK - 1), F.size(codes)))
        return F.aggregate(ends, start, step, lambda acc: acc["spans"])

    def windows(codes: Column) -> Column:
        found = F.flatten(F.transform(F.sequence(F.lit(1), F.size(codes), F.lit(PLACE_BLOCK)), lambda first: block(codes, first)))
        return let(found, _touching)

    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(kind.alphabet()), c) - 1)
    return let(codes, windows)


def entropy_spans(candidates: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of kind ``entropy``; ``candidates``: matches of the candidate patterns."""

    def of(span: Column) -> Column:
        string = span["string"]
        low = F.lower(string)
        allowed = F.exists(F.array(*[F.lit(a) for a in allow]), lambda a: F.contains(low, a)) if allow else F.lit(False)
        none = F.expr("cast(array() as array<struct<from:int,to:int>>)")
        found = none
        for kind in reversed(CLASSES):
            found = F.when(F.regexp_like(string, F.lit(kind.pattern)), _high_windows(string, kind)).otherwise(found)
        found = F.when(allowed | ~F.regexp_like(string, F.lit(DIGIT)) | ~F.regexp_like(string, F.lit("[A-Za-z]")), none).otherwise(found)
        return F.transform(found, lambda x: F.struct((span["start"] + x["from"]).alias("start"), (span["start"] + x["to"]).alias("end"), F.lit("entropy").alias("kind"), F.lit(0).alias("value")))

    return F.flatten(F.transform(candidates, of))


def joined(spans: Column) -> Column:
    """Spans of one kind, those that touch or overlap as one."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))
        return F.when(F.coalesce(last["end"] >= s["start"], F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<struct<start:int,end:int,kind:string,value:int>>)"), step)


def scan_secrets(docs: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW, runs: bool = False) -> DataFrame:
    """``docs`` with ``spans``: array of (start, end, kind), sorted. With ``runs``, the runs of one class inside a candidate are candidates too."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("_candidates", _matches(whole, CANDIDATE, "entropy"))
    if runs:
        inside = F.array_distinct(F.concat("_candidates", *(_matches(whole, r, "entropy") for r in RUNS)))
        found = found.withColumn("_candidates", F.when(F.size("_candidates") > 0, inside).otherwise(F.col("_candidates")))
    high = entropy_spans(F.col("_candidates"), allow)
    spans = F.concat(
        located(whole, ASSIGN, "assign", 2, ASSIGN_VALUE), located(whole, ACCESS, "access"), located(whole, HEX, "hex"), joined(high) if runs else high,
    )
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.withColumn("spans", F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).drop("_candidates")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with every secret in ``text``, also inside candidates, replaced by ``mark``; overlapping spans are one secret. Texts without secrets and all other
    columns stay as they are, also those named like results."""
    body = F.col(f"in_{text}")
    given = docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}).withColumn("_n", F.length(body))
    found = scan_secrets(given, f"in_{text}", allow, runs=True)
    merged = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["end"].alias("at"))
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.col("_n"))),
    )
    masked = found.withColumn(f"in_{text}", F.when(F.size("spans") > 0, merged).otherwise(body))
    return masked.select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))


def _sql() -> str:
    """The same spans: base matches located by the pieces between them, window sums from the characters of every window."""
    base = " union all ".join(
        f"""select rid, '{kind}' as kind, {rank} as rank, {group} as value, string_split_regex(text, '{pattern.replace("'", "''")}') as pieces,
            regexp_extract_all(text, '{pattern.replace("'", "''")}') as whole from d"""
        for rank, (kind, pattern, group) in enumerate([
            ("assign", ASSIGN, f"""regexp_extract_all(text, '{ASSIGN.replace("'", "''")}', 2)"""), ("access", ACCESS, "null"), ("hex", HEX, "null"), ("candidate", CANDIDATE, "null"),
        ])
    )
    weights = "case c " + " ".join(f"when {c} then {x}" for c, x in enumerate(CLASSES[0].weights())) + " end"
    window = CLASSES[0].window
    most = "case " + " ".join(f"when regexp_matches(s, '{k.pattern}') then {k.most()}" for k in CLASSES) + " end"
    allowed = " or ".join(f"contains(lower(s), '{a}')" for a in ALLOW)
    return f"""
    with d as (
        select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
    ), b as ({base}), m as (
        select rid, kind, rank, unnest(range(1, len(whole) + 1)) as i, pieces, whole, value from b where len(whole) > 0
    ), located as (
        select rid, kind, rank, whole[i] as s, value[i] as v,
            cast(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) as bigint) as first from m
    ), cand as (
        select rid, s, first, {most} as most from located
        where kind = 'candidate' and regexp_matches(s, '[0-9]') and regexp_matches(s, '[A-Za-z]') and not ({allowed})
    ), win as (
        select rid, first, p, any_value(most) as most, sum({weights}) as total from (
            select rid, first, p, most, substr(s, p + q, 1) as ch, count(*) as c
            from cand, unnest(range(1, length(s) - {window} + 2)) t(p), unnest(range(0, {window})) u(q) group by all
        ) group by rid, first, p
    ), high as (
        select rid, first, p, case when p <= lag(p) over (partition by rid, first order by p) + {window} then 0 else 1 end as fresh from win where total <= most
    ), runs as (
        select rid, first, p, sum(fresh) over (partition by rid, first order by p) as g from high
    ), spans as (
        select rid, kind, rank, first as a, first + length(s) as z from located where kind in ('access', 'hex') or kind = 'assign' and length(v) >= {ASSIGN_VALUE}
        union all select rid, 'entropy', 3, first + min(p) - 1, first + max(p) - 1 + {window} from runs group by rid, first, g
    ), per as (
        select rid, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
            string_agg(concat(kind, ':', a, ':', z), ',' order by a, rank) as spans,
            string_agg(concat(kind, ':', a, ':', z), ',' order by a, rank) filter (rank < 3) as base
        from spans group by rid
    )
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join per using (rid)
    """


@query("op6_secret_entropy", _sql())
def op6_secret_entropy(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
