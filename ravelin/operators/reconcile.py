"""Record reconciliation: one-to-one matching of two item sets, gaps between their bars, findings.

Ordered greedy matching is independent in the connected components of its candidates. Components (for assignments: groups) of at most
``COMPONENT`` rows are settled by one ordered pass each, as the rows stream through a task; larger ones are worked down by rounds of
joins and aggregations, so no task ever holds more than one small component.

Items that pair by their distance (``greedy_near``, ``first_near``) go to the tasks as items: their edges grow with the square of a
crowd, so they are made and judged inside a task and never written or exchanged.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.operators.corpus import connected_groups
from ravelin.operators.ordering import running_sum_in_chunks
from ravelin.session import cut_lineage

SPACING_TOL, LENGTH_TOL = 5.0, 25.0
LOW_CONFIDENCE, APPROXIMATE_CAP, UNREAD_CAP = 0.5, 0.5, 0.4
BLOCK = 65536
#: Most rows of a component that one task settles.
COMPONENT = 200_000
#: Most edges that a task looks at together.
PIECE = 1 << 18
#: Most items of short runs that a task holds together.
TOGETHER = 1 << 15
#: Rule of a pass: distances on both axes and, per class column, (equal, different) -> (allowed, first and second sort key).
Rule = Callable[[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]], tuple[np.ndarray, np.ndarray, np.ndarray]]
log = logging.getLogger(__name__)


def _empty() -> Column:
    return F.array().cast("array<string>")


def subset_sums(counts: Column, most: Column) -> Column:
    """Sums up to ``most`` of one or more values; ``counts``: array of (qty, n), positive value and how often it occurs.

    At most ``most`` sums are held, and a value is added at most ``most / value`` times, however many there are.
    """

    def grow(sums: Column, c: Column) -> Column:
        times = F.sequence(F.lit(0), F.least(c["n"].cast("int"), F.floor(most / c["qty"]).cast("int")))
        more = F.flatten(F.transform(times, lambda i: F.transform(sums, lambda s: s + i * c["qty"])))
        return F.array_distinct(F.filter(more, lambda s: s <= most))

    usable = F.filter(counts, lambda c: (c["qty"] > 0) & (c["qty"] <= most))
    return F.filter(F.aggregate(usable, F.array(F.lit(0).cast("int")), grow), lambda s: s > 0)


def compare_bars(plan: DataFrame, shop: DataFrame, key: str) -> DataFrame:
    """Gaps per (key, role) between the first plan bar of the role and the shop bars of the role.

    Both sides hold key, role, pos, size, qty, spacing, length. Diameter must be one of the shop
    sizes; quantity must be a sum of shop counts of that size (of all sizes when none has it), not compared for stirrups; spacing and length have tolerances. ``absent`` marks a
    role without shop bars.
    """
    by = [key, "role"]
    bar = F.struct("pos", "size", "qty", "spacing", "length")
    first = plan.groupBy(*by).agg(F.min(bar).alias("p"))
    met = shop.join(first, by)
    p = lambda f: F.col("p")[f]
    facts = met.groupBy(*by).agg(
        F.bool_or(F.col("size") == p("size")).alias("size_met"), F.min(F.when(F.col("size").isNotNull(), F.struct("pos", "size"))).alias("size1"),
        F.bool_or(F.abs(F.col("spacing") - p("spacing")) <= SPACING_TOL).alias("spacing_met"),
        F.min(F.when(F.col("spacing").isNotNull(), F.struct("pos", "spacing"))).alias("spacing1"), F.min(bar).alias("s1"),
    )
    counted = met.where(F.col("qty").isNotNull()).withColumn("same", F.coalesce(F.col("size") == p("size"), F.lit(False)))
    # equal counts are added up before they are listed, so a list has at most the distinct counts
    per_qty = counted.groupBy(*by, "same", "qty").agg(F.count(F.lit(1)).alias("n"))
    listed = per_qty.groupBy(*by).agg(F.collect_list(F.struct("same", F.col("qty").cast("int").alias("qty"), "n")).alias("qs"), F.bool_or("same").alias("any_same"))
    usable = F.filter("qs", lambda q: q["same"] | ~F.col("any_same"))
    joined = first.join(facts, by, "left").join(listed.select(*by, usable.alias("qs")), by, "left")
    has = F.col("s1").isNotNull()
    size_gap = has & p("size").isNotNull() & F.col("size1").isNotNull() & ~F.coalesce("size_met", F.lit(False))
    qty_gap = has & (F.col("role") != "LIG") & p("qty").isNotNull() & (F.size("qs") > 0) & ~F.array_contains(subset_sums(F.col("qs"), p("qty").cast("int")), p("qty").cast("int"))
    spacing_gap = has & p("spacing").isNotNull() & F.col("spacing1").isNotNull() & ~F.coalesce("spacing_met", F.lit(False))
    length_gap = has & (F.abs(p("length") - F.col("s1.length")) > LENGTH_TOL)
    gap = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(name))).otherwise(_empty())
    gaps = F.concat(gap(size_gap, "size"), gap(qty_gap, "quantity"), gap(spacing_gap, "spacing"), gap(length_gap, "length"))
    return joined.select(*by, gaps.alias("gaps"), (~has).alias("absent"))


def _runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows of one key after the other, from batches that are ordered by it."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        change = batch[key].ne(batch[key].shift(fill_value=kept[-1][key].iloc[-1] if kept else batch[key].iloc[0] if len(batch) else None))
        starts = [*np.flatnonzero(change.to_numpy()), len(batch)]
        at = 0
        for stop in starts:
            if stop > at:
                kept.append(batch.iloc[at:stop])
            if stop < len(batch) and kept:
                yield pd.concat(kept)
                kept = []
            at = stop
    if kept:
        yield pd.concat(kept)


def _assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Plans of a group in order, each with the next free option of its class. Options come first, best first."""
    for rows in _runs(batches, "g"):
        queues: dict[str, list] = {}
        gone: set[str] = set()
        taken = []
        for c, pid, sid in zip(rows["c"], rows["pid"], rows["sid"]):
            if sid is not None:
                queues.setdefault(c, []).append(sid)
                continue
            queue = queues.get(c, [])
            if isinstance(queue, list):
                queue = queues[c] = iter(queue)
            choice = next((s for s in queue if s not in gone), None)
            if choice is not None:
                gone.add(choice)
                taken.append((rows["g"].iloc[0], pid, choice))
        yield pd.DataFrame(taken, columns=["g", "pid", "sid"])


def greedy_assign(plans: DataFrame, options: DataFrame) -> DataFrame:
    """Exact result of taking plans in order, each with its best free option; see ``assign_in_rounds`` for the columns.

    Groups of up to ``COMPONENT`` plans and options are settled in one pass; the others go through rounds.
    """
    plans, options = cut_lineage(plans), cut_lineage(options)
    sizes = plans.select("grp").unionByName(options.select("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("rows"))
    large = cut_lineage(sizes.where(F.col("rows") > COMPONENT).select("grp"))
    name = lambda c: F.to_json(F.struct(F.col(c)))
    none = F.lit(None).cast("string")
    small = lambda df: df.join(large, "grp", "left_anti")
    asked = small(plans).select(name("grp").alias("g"), name("cls").alias("c"), name("pid").alias("pid"), none.alias("sid"), F.lit(1).alias("step"), F.lit(None).cast(options.schema["cost"].dataType).alias("cost"), F.col("pos").alias("at"))
    given = small(options).select(name("grp").alias("g"), name("cls").alias("c"), none.alias("pid"), name("sid").alias("sid"), F.lit(0).alias("step"), "cost", F.col("spos").alias("at"))
    stream = given.unionByName(asked).repartition("g").sortWithinPartitions("g", "step", "cost", "at").select("g", "c", "pid", "sid")
    named = cut_lineage(stream.mapInPandas(_assigned, "g string, pid string, sid string"))
    back = small(plans).withColumns({"g": name("grp"), "p": name("pid")})
    priced = small(options).withColumns({"g": name("grp"), "s": name("sid")}).select("g", "s", "cls", "sid", "cost")
    settled = named.select("g", F.col("pid").alias("p"), F.col("sid").alias("s")).join(back, ["g", "p"]).join(priced, ["g", "s", "cls"]).select("grp", "pid", "sid", "cost")
    if large.isEmpty():
        return settled
    return settled.unionByName(assign_in_rounds(plans.join(large, "grp", "left_semi"), options.join(large, "grp", "left_semi")))


def assign_in_rounds(plans: DataFrame, options: DataFrame) -> DataFrame:
    """Exact result of taking plans in order, each with its best free option.

    ``plans`` (grp, cls, pid, pos): order ``pos`` inside an independent group, ``cls`` a class of plans with
    the same options. ``options`` (grp, cls, sid, cost, spos): lower cost first, then lower ``spos``.

    In a round the r-th waiting plan of a class proposes to the r-th free option of the class. As long as
    no two plans want the same option these proposals are what the ordered loop would choose, so each group
    keeps them up to its first clash (the later plan of the clashing pair) and goes on from there. Every round
    settles the first waiting plan of each group at least, so the work ends; the loop is serial by nature and its
    rounds are logged.
    """
    by = ["grp", "cls"]
    waiting = cut_lineage(plans)
    free = cut_lineage(options)
    taken: list[DataFrame] = []
    while True:
        log.info("assignment round %d", len(taken) + 1)
        sizes = waiting.groupBy(*by).agg(F.count(F.lit(1)).alias("need"))
        wanted = free.join(sizes, by)
        ranked = running_sum_in_chunks(wanted, by, ["cost", "spos"], F.struct("cost", F.floor(F.col("spos") / BLOCK)), F.lit(1), "r")
        queue = running_sum_in_chunks(waiting, by, ["pos"], F.floor(F.col("pos") / BLOCK), F.lit(1), "r")
        proposals = cut_lineage(
            queue.join(ranked.where("r <= need").select(*by, "r", "sid", "cost"), [*by, "r"], "left").select("grp", "cls", "pid", "pos", "sid", "cost")
        )
        asked = proposals.where("sid IS NOT NULL")
        firsts = asked.groupBy("grp", "sid").agg(F.min("pos").alias("first_pos"))
        clash = asked.join(firsts, ["grp", "sid"]).where(F.col("pos") > F.col("first_pos")).groupBy("grp").agg(F.min("pos").alias("stop"))
        marked = proposals.join(clash, "grp", "left")
        before = F.col("stop").isNull() | (F.col("pos") < F.col("stop"))
        kept = marked.where(before & F.col("sid").isNotNull()).select("grp", "pid", "sid", "cost")
        taken.append(cut_lineage(kept))
        rest = cut_lineage(marked.where(~before).select("grp", "cls", "pid", "pos"))
        if rest.isEmpty():
            break
        waiting = rest
        open_classes = waiting.select(*by).distinct()
        free = cut_lineage(free.join(open_classes, by, "left_semi").join(taken[-1].select("grp", "sid"), ["grp", "sid"], "left_anti"))
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of a component in order, each taken when both ends are free."""
    for rows in _runs(batches, "component"):
        used_a: set[str] = set()
        used_b: set[str] = set()
        taken = []
        for a, b in zip(rows["na"], rows["nb"]):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                taken.append((a, b))
        yield pd.DataFrame(taken, columns=["na", "nb"])


def greedy_edges(edges: DataFrame, order: list[str], most: int | None = None) -> DataFrame:
    """Exact result of taking edges (a, b, ...) by ``order``, each when both ends are free.

    An edge that is first at both its ends is taken by the loop whatever happens elsewhere. One such round goes first, as it settles
    most edges. What is left falls into connected components, found in a number of steps that grows with the logarithm of their
    length; those of up to ``most`` edges (default ``COMPONENT``) are settled by one ordered pass each. Edges of larger components get another round, which
    takes at least their smallest edge, and are looked at again; their rounds are logged.
    """
    most = COMPONENT if most is None else most
    name = lambda c: F.to_json(F.struct(F.col(c)))
    left = cut_lineage(edges.withColumns({"_k": F.struct(*order, "a", "b"), "na": name("a"), "nb": name("b")}))
    taken: list[DataFrame] = []
    while True:
        log.info("pairing round %d", len(taken) + 1)
        at_a = left.groupBy("a").agg(F.min("_k").alias("_ka"))
        at_b = left.groupBy("b").agg(F.min("_k").alias("_kb"))
        won = cut_lineage(left.join(at_a, "a").join(at_b, "b").where((F.col("_k") == F.col("_ka")) & (F.col("_k") == F.col("_kb"))).drop("_ka", "_kb"))
        taken.append(won)
        left = cut_lineage(left.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti"))
        if left.isEmpty():
            break
        # two nodes of one hash only join their components
        node_a, node_b = F.xxhash64(F.lit("a"), "na"), F.xxhash64(F.lit("b"), "nb")
        groups = connected_groups(left.select(node_a.alias("u"), node_b.alias("v")), "u", "v")
        placed = left.withColumn("id", node_a).join(groups.select("id", F.col("group").alias("component")), "id").drop("id")
        sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
        placed = cut_lineage(placed.join(sizes, "component"))
        small = placed.where(F.col("_n") <= most).repartition("component").sortWithinPartitions("component", "_k")
        settled = small.select("component", "na", "nb").mapInPandas(_greedy, "na string, nb string")
        taken.append(cut_lineage(left.join(settled, ["na", "nb"])).select(*left.columns))
        left = cut_lineage(placed.where(F.col("_n") > most).select(*left.columns))
        if left.isEmpty():
            break
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part.select(*out.columns))
    return out.drop("_k", "na", "nb")


def free_edges(edges: DataFrame, taken: DataFrame) -> DataFrame:
    """Edges whose ends no taken edge uses."""
    return edges.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti")


def rounded(v: np.ndarray) -> np.ndarray:
    """Nine decimals of numbers of 0 and more, as ``F.round`` gives them: halves of the printed number go up."""
    scaled = v * 1e9
    low = np.floor(scaled)
    out = (low + (scaled - low >= 0.5)) / 1e9
    for i in np.flatnonzero(np.abs(scaled - low - 0.5) < 1e-5):
        out.flat[i] = float(Decimal(repr(float(v.flat[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _either(c: str) -> Column:
    """A column that the items of both sides have."""
    return F.coalesce(F.col(f"p.{c}"), F.col(f"s.{c}"))


def _named(items: DataFrame) -> DataFrame:
    return items.withColumn("name", F.when(F.col("side") == 0, F.to_json(F.struct("p.a"))).otherwise(F.to_json(F.struct("s.b"))))


def _both_sides(plan: DataFrame, shop: DataFrame) -> DataFrame:
    kind = lambda df: F.lit(None).cast(df.schema)
    ours = plan.select(F.lit(0).alias("side"), F.struct(*plan.columns).alias("p"), kind(shop).alias("s"))
    return ours.unionByName(shop.select(F.lit(1).alias("side"), kind(plan).alias("p"), F.struct(*shop.columns).alias("s")))


def repeated_ids(plan: DataFrame, shop: DataFrame) -> DataFrame:
    """(side, name) of the ids (``a`` of the plan, ``b`` of the shop) that come on more than one row."""
    both = plan.select(F.lit(0).alias("side"), "a", F.lit(None).cast(shop.schema["b"].dataType).alias("b")).unionByName(
        shop.select(F.lit(1).alias("side"), F.lit(None).cast(plan.schema["a"].dataType).alias("a"), "b")
    )
    counts = both.groupBy("side", "a", "b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return cut_lineage(_named(counts.select("side", F.struct("a").alias("p"), F.struct("b").alias("s"))).select("side", "name"))


def _placed(items: DataFrame, keys: list[str], repeated: DataFrame) -> DataFrame:
    """Items with all keys and a place, with their component: the items of equal keys, and of keys that share an id."""
    known = [_either(c).isNotNull() for c in [*keys, "u", "v"]]
    for test in known:
        items = items.where(test)
    placed = items.withColumn("component", F.xxhash64(*[_either(c) for c in keys]))
    if repeated.isEmpty():
        return placed
    node = F.xxhash64("side", "name")
    shared = _named(placed).join(repeated, ["side", "name"], "left_semi").select(node.alias("u"), F.col("component").alias("v"))
    groups = connected_groups(shared, "u", "v").select(F.col("id").alias("component"), "group")
    return placed.join(groups, "component", "left").select(F.coalesce("group", "component").alias("component"), "side", "p", "s")


def _cells(reach: tuple[float, float]) -> dict[str, Column]:
    return {"cx": F.floor(_either("u") / reach[0]), "cy": F.floor(_either("v") / reach[1])}


def _stream(items: DataFrame, run: str, keys: list[str], classes: list[str]) -> DataFrame:
    """Items of a ``run`` one after the other, plans first, each side by its ids; what tasks need of them beside the items."""
    told = lambda c: F.when(_either(c).isNotNull(), F.to_json(F.struct(_either(c)))).alias(f"is_{c}")
    dealt = _named(items.repartition(run).sortWithinPartitions(run, "side", "p.a", "s.b"))
    return dealt.select(
        F.col(run).alias("run"), "side", "name", F.to_json(F.struct(*[_either(c).alias(c) for c in keys])).alias("keys"), _either("u").cast("double").alias("u"),
        _either("v").cast("double").alias("v"), "cx", "cy", *[told(c) for c in classes], "p", "s",
    )


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs, from batches that are ordered by them; short runs come together, as they need not be told apart by the tasks."""
    kept: list[pa.RecordBatch] = []
    last, held = None, 0
    for batch in batches:
        runs = batch.column("run").to_numpy()
        if not len(runs):
            continue
        at = 0
        for stop in [*(np.flatnonzero(runs[1:] != runs[:-1]) + 1), len(runs)]:
            if kept and runs[at] != last and held + stop - at > TOGETHER:
                yield pa.Table.from_batches(kept)
                kept, held = [], 0
            kept.append(batch.slice(at, stop - at))
            held += stop - at
            last, at = runs[at], stop
    if kept:
        yield pa.Table.from_batches(kept)


class _Items:
    """Columns of a run as arrays; ids, keys and classes as numbers, ids in the order of their side."""

    def __init__(self, table: pa.Table, classes: list[str]):
        number = lambda c: table[c].to_numpy()
        code = lambda c: table[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.u, self.v, self.cx, self.cy = number("u"), number("v"), number("cx"), number("cy")
        self.id, self.keys, self.classes = code("name"), code("keys"), [code(f"is_{c}") for c in classes]
        side = number("side")
        self.plans, self.shops = np.flatnonzero(side == 0), np.flatnonzero(side == 1)

    def judged(self, i: np.ndarray, j: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rule for plans ``i`` and shops ``j``."""
        alike = []
        for c in self.classes:
            known, same = (c[i] >= 0) & (c[j] >= 0), c[i] == c[j]
            alike.append((known & same, known & ~same))
        return rule(np.abs(self.u[i] - self.u[j]), np.abs(self.v[i] - self.v[j]), alike)

    def by_cell(self, rows: np.ndarray) -> dict[tuple, np.ndarray]:
        at = pd.DataFrame({"k": self.keys[rows], "x": self.cx[rows], "y": self.cy[rows]})
        return {k: rows[found] for k, found in at.groupby(["k", "x", "y"]).indices.items()}


def _in_order(items: _Items, rule: Rule) -> tuple[list[int], list[int]]:
    """Rows of the plans and shops that an ordered loop over the allowed edges pairs.

    Each plan waits with its best free shop. The least of the waiting edges is the next of the loop if its shop is still free; else
    its plan looks for a shop again. Rows of one id are one item; all rows of the edge that is taken are returned.
    """
    free_plan, free_shop = (np.ones(items.id.max() + 1, bool) for _ in range(2))
    listed, near = items.by_cell(items.shops), {}
    none = np.array([], int)

    def around(i: int) -> np.ndarray:
        at = (k, x, y) = items.keys[i], items.cx[i], items.cy[i]
        if at not in near:
            near[at] = np.sort(np.concatenate([listed.get((k, x + p, y + q), none) for p in (-1, 0, 1) for q in (-1, 0, 1)]))
        near[at] = near[at][free_shop[items.id[near[at]]]]
        return near[at]

    twins: dict[int, list[int]] = {}
    if len(np.unique(items.id[items.plans])) < len(items.plans):
        for i in items.plans:
            twins.setdefault(items.id[i], []).append(i)
    several = len(twins) > 0 or len(np.unique(items.id[items.shops])) < len(items.shops)
    waiting = [(-np.inf, -np.inf, items.id[i], -1, i, -1) for i in items.plans]
    rows_p: list[int] = []
    rows_s: list[int] = []
    while waiting:
        k1, k2, plan, shop, i, j = heapq.heappop(waiting)
        if not free_plan[plan]:
            continue
        if shop >= 0 and free_shop[shop]:
            for t in twins.get(plan, [i]) if several else ():
                same = around(t)
                same = same[items.id[same] == shop]
                fits, q1, q2 = items.judged(t, same, rule)
                same = same[fits & (q1 == k1) & (q2 == k2)]
                rows_p.extend([t] * len(same))
                rows_s.extend(same)
            if not several:
                rows_p.append(i)
                rows_s.append(j)
            free_plan[plan] = free_shop[shop] = False
            continue
        found = around(i)
        fits, q1, q2 = items.judged(i, found, rule)
        found, q1, q2 = found[fits], q1[fits], q2[fits]
        if len(found):
            ties = np.flatnonzero(q1 == q1.min())
            best = ties[q2[ties].argmin()]
            heapq.heappush(waiting, (q1[best], q2[best], plan, items.id[found[best]], i, found[best]))
    return rows_p, rows_s


def _settled(batches: Iterator[pa.RecordBatch], rule: Rule, classes: list[str]) -> Iterator[pa.RecordBatch]:
    """Pairs of each component, by one ordered pass."""
    for table in _tables(batches):
        items = _Items(table, classes)
        # the components of a table have no edges and no ids in common, so one loop gives the pairs of each
        rows_p, rows_s = _in_order(items, rule) if len(items.plans) and len(items.shops) else ([], [])
        yield from pa.table({"p": table["p"].take(pa.array(rows_p, pa.int64())), "s": table["s"].take(pa.array(rows_s, pa.int64()))}).to_batches()


def _first_in_cells(batches: Iterator[pa.RecordBatch], rule: Rule, classes: list[str]) -> Iterator[pa.RecordBatch]:
    """Per plan of a cell, and per shop that is listed there, the first of its edges; all rows of that edge."""

    def firsts(one: np.ndarray, k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places of the first edge of each ``one``, edges of equal keys being in the order of the other end's ``rows``."""
        if not len(one):
            return np.array([], int)
        order = np.lexsort((rows, k2, k1, one))
        begins = np.flatnonzero(np.r_[True, one[order][1:] != one[order][:-1]])
        first = np.repeat(order[begins], np.diff(np.r_[begins, len(order)]))
        return order[(k1[order] == k1[first]) & (k2[order] == k2[first]) & (ids[order] == ids[first])]

    def edges(table: pa.Table, of: int, found: list[np.ndarray]) -> list[pa.RecordBatch]:
        i, j, k1, k2 = found
        return pa.table({"of": np.full(len(i), of), "k1": k1, "k2": k2, "p": table["p"].take(pa.array(i)), "s": table["s"].take(pa.array(j))}).to_batches()

    for table in _tables(batches):
        items = _Items(table, classes)
        plans, shops = items.by_cell(items.plans), items.by_cell(items.shops)
        met = [(plans[cell], shops[cell]) for cell in plans.keys() & shops.keys()]
        least = None
        for own, listed in _pieces(met):
            i, j = (np.concatenate(x) for x in ([np.repeat(o, len(js)) for o, js in zip(own, listed)], [np.tile(js, len(o)) for o, js in zip(own, listed)]))
            fits, k1, k2 = items.judged(i, j, rule)
            found = [x[fits] for x in (i, j, k1.astype(float), k2)]
            # a row is in one cell, so rows tell the ends of edges apart; all edges of a plan are in one piece, those of a shop may not be
            yield from edges(table, 0, [x[firsts(found[0], *found[2:], items.id[found[1]], found[1])] for x in found])
            both = found if least is None else [np.concatenate(x) for x in zip(least, found)]
            least = [x[firsts(both[1], *both[2:], items.id[both[0]], both[0])] for x in both]
        if least is not None:
            yield from edges(table, 1, least)


def _pieces(met: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Plans and shops of cells, with at most ``PIECE`` edges at a time, or those of one plan."""
    own: list[np.ndarray] = []
    listed: list[np.ndarray] = []
    edges = 0
    for plans, shops in met:
        size = max(1, PIECE // len(shops))
        for start in range(0, len(plans), size):
            part = plans[start : start + size]
            if own and edges + len(part) * len(shops) > PIECE:
                yield own, listed
                own, listed, edges = [], [], 0
            own.append(part)
            listed.append(shops)
            edges += len(part) * len(shops)
    if own:
        yield own, listed


def _first_both_ways(items: DataFrame, keys: list[str], reach: tuple[float, float], rule: Rule, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pairs (p, s) whose edge is the first of both ends, and the (side, name) of all items that have an edge."""
    spread = F.when(F.col("side") == 1, F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = F.coalesce(spread, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    listed = items.select("side", "p", "s").withColumns(_cells(reach)).withColumn("o", F.explode(spread))
    listed = listed.withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o")
    cell = F.xxhash64(*[_either(c) for c in keys], "cx", "cy")
    schema = T.StructType([T.StructField("of", T.LongType()), T.StructField("k1", T.DoubleType()), T.StructField("k2", T.DoubleType()), items.schema["p"], items.schema["s"]])
    stream = _stream(listed.withColumn("cell", cell), "cell", keys, classes)
    edges = cut_lineage(stream.mapInArrow(lambda batches: _first_in_cells(batches, rule, classes), schema))
    edges = edges.withColumns({"k": F.struct("k1", "k2", "p.a", "s.b"), "na": F.to_json(F.struct("p.a")), "nb": F.to_json(F.struct("s.b"))})
    at_a = edges.where("of = 0").groupBy("na").agg(F.min("k").alias("k"))
    at_b = edges.where("of = 1").groupBy("nb").agg(F.min("k").alias("k"))
    won = edges.where("of = 0").join(at_a.select("na", "k"), ["na", "k"], "left_semi").join(at_b.select("nb", "k"), ["nb", "k"], "left_semi")
    live = at_a.select(F.lit(0).alias("side"), F.col("na").alias("name")).unionByName(at_b.select(F.lit(1).alias("side"), F.col("nb").alias("name")))
    return won.select("p", "s"), live


def first_near(plan: DataFrame, shop: DataFrame, keys: list[str], reach: tuple[float, float], rule: Rule, classes: list[str] | None = None) -> DataFrame:
    """Pairs whose edge is the first of all allowed edges at both its ends; see ``greedy_near``."""
    items = _both_sides(plan, shop)
    for c in [*keys, "u", "v"]:
        items = items.where(_either(c).isNotNull())
    return _first_both_ways(items, keys, reach, rule, classes or [])[0]


def greedy_near(
    plan: DataFrame, shop: DataFrame, keys: list[str], reach: tuple[float, float], rule: Rule, repeated: DataFrame, classes: list[str] | None = None, most: int | None = None
) -> DataFrame:
    """Exact result of taking the edges between near items in order, each when both ends are free; pairs as structs ``p`` and ``s``.

    Sides hold the keys, the classes, ``u`` and ``v`` (place) and ``a`` or ``b`` (id). An edge links items of equal keys whose cells of
    the size ``reach`` touch, if ``rule`` allows it; edges go by the two keys of the rule, then by ``a`` and ``b``. ``repeated``: see ``repeated_ids``.

    Items of equal keys are a component. Those of up to ``most`` items (default ``COMPONENT``) are settled by one ordered pass each, in
    memory for the items alone. Larger ones go through rounds that take the edges that are first at both ends, until so few items
    that have an edge are left; the rounds are serial in the worst case and logged.
    """
    most, classes = COMPONENT if most is None else most, classes or []
    items = _placed(_both_sides(plan, shop), keys, repeated)
    schema = T.StructType([items.schema["p"], items.schema["s"]])
    taken: list[DataFrame] = []
    while True:
        sizes = items.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
        large = cut_lineage(sizes.where(F.col("_n") > most).select("component"))
        whole = large.isEmpty()
        small = items if whole else items.join(large, "component", "left_anti")
        stream = _stream(small.withColumns(_cells(reach)), "component", keys, classes)
        taken.append(cut_lineage(stream.mapInArrow(lambda batches: _settled(batches, rule, classes), schema)))
        if whole:
            break
        log.info("pairing round %d of large components", len(taken))
        rest = cut_lineage(_named(items.join(large, "component", "left_semi")))
        won, live = _first_both_ways(rest, keys, reach, rule, classes)
        won = cut_lineage(won)
        taken.append(won)
        gone = _named(won.select(F.lit(0).alias("side"), "p", "s")).unionByName(_named(won.select(F.lit(1).alias("side"), "p", "s"))).select("side", "name")
        items = cut_lineage(rest.join(live, ["side", "name"], "left_semi").join(gone, ["side", "name"], "left_anti").drop("name"))
    out = taken[0]
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def unmatched(plan: DataFrame, shop: DataFrame, pairs: DataFrame, level: list[str]) -> DataFrame:
    """Findings for items of one side only: missing in the shop, or added on a level the plan has.

    Sides hold id, sheet, element and the level columns; repeated finding ids get a suffix.
    """
    missing = plan.join(pairs.select(F.col("pid").alias("id")), "id", "left_anti").select(
        F.lit("missing").alias("status"), "id", F.concat_ws("-", "sheet", "element").alias("finding")
    )
    sheets = plan.groupBy(*level).agg(F.min(F.struct("id", "sheet")).alias("_s")).select(*level, F.col("_s.sheet").alias("plan_sheet"))
    alone = shop.join(pairs.select(F.col("sid").alias("id")), "id", "left_anti").join(sheets, level)
    added = alone.select(F.lit("added").alias("status"), "id", F.concat_ws("-", "plan_sheet", "element", F.lit("shop")).alias("finding"))
    both = missing.unionByName(added)
    numbered = running_sum_in_chunks(both, ["finding"], ["status", "id"], F.struct("status", F.floor(F.col("id") / BLOCK)), F.lit(1), "k")
    return numbered.select(
        "status", "id", F.when(F.col("k") > 1, F.concat_ws("-", "finding", F.col("k").cast("string"))).otherwise(F.col("finding")).alias("finding")
    )


def retain_gaps(rows: DataFrame, plan_conf: str, shop_conf: str, unread: Column, approximate: Column, gaps: str) -> DataFrame:
    """Confidence of a pair with its caps; gaps under 0.5 are dropped and noted."""
    base = F.round(F.least(plan_conf, shop_conf), 2)
    conf = F.least(base, F.when(unread, UNREAD_CAP).otherwise(1.0), F.when(approximate, APPROXIMATE_CAP).otherwise(1.0))
    weak = F.col("_conf") < LOW_CONFIDENCE
    note = lambda cond, text: F.when(cond, F.array(F.lit(text))).otherwise(_empty())
    notes = F.concat(
        note(approximate, "approximate"), note(unread, "unread"), note(weak, "weak"), note(weak & (F.size(gaps) > 0), "gap not kept")
    )
    return rows.withColumn("_conf", conf).withColumns(
        {
            "confidence": F.round("_conf", 2), "kept": F.when(weak, _empty()).otherwise(F.col(gaps)),
            "note": F.array_join(F.array_distinct(notes), "; "),
        }
    ).drop("_conf")


def item_gaps(pairs: DataFrame) -> DataFrame:
    """Extra gaps of a pair: bars the plan does not give, and type labels that differ (put first)."""
    pattern = r"^TYPE\s*([A-Z0-9]+)$"
    kind = lambda c: F.nullif(F.regexp_extract(F.upper(F.col(c)), pattern, 1), F.lit(""))
    both = kind("plan_element").isNotNull() & kind("shop_element").isNotNull()
    differ = both & (kind("plan_element") != kind("shop_element"))
    extra = F.when((F.size("plan_bars") == 0) & (F.size("shop_bars") > 0), F.array(F.lit("bars"))).otherwise(_empty())
    found = F.concat(F.when(differ, F.array(F.lit("type"))).otherwise(_empty()), F.col("gaps"), extra)
    same = both & ~differ & (F.size(F.concat("gaps", extra)) > 0)
    return pairs.withColumn("all_gaps", found).withColumn("same_type_other_bars", same)


def eval_join(truth: DataFrame, findings: DataFrame) -> DataFrame:
    """Truth rows with their finding on the normalised location; a non-conforming one is preferred."""
    key = lambda c: F.regexp_replace(F.upper(F.col(c)), r"\s+", "")
    order = F.struct((F.col("status") != "non_conforme").alias("later"), "finding", "status")
    best = findings.groupBy(key("element").alias("_loc")).agg(F.min(order).alias("_b"))
    joined = truth.withColumn("_loc", key("location")).join(best, "_loc", "left")
    hit = F.coalesce(F.col("_b.status") == "non_conforme", F.lit(False))
    return joined.select(
        *truth.columns, F.col("_b.finding").alias("finding"), F.col("_b.status").alias("status"), F.when(F.col("expected"), hit.cast("int")).alias("found")
    )


def distinct_by_frequency(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (size, spacing step) per key, most frequent first, with the first bar of each."""
    step = F.coalesce(F.bround(F.col("spacing") / 5), F.lit(0.0)).cast("long")
    counts = bars.withColumn("step", step).groupBy(*keys, "size", "step").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"), F.min(F.struct("pos", "spacing")).alias("_f")
    )
    return counts.select(*keys, "size", "step", "n", "pos", F.col("_f.spacing").alias("spacing"))


def align_spacing(plan: DataFrame, shop: DataFrame, keys: list[str]) -> DataFrame:
    """Plan and shop bars aligned by spacing.

    A shop bar goes to the first plan bar of its size within tolerance; a plan bar left alone takes the
    closest shop bar (same size first); a shop bar left alone goes to the closest plan bar. Both sides are
    distinct bars per key (keys, pos, size, spacing), so their number is bounded by sizes x steps.
    """
    p = plan.select(*keys, F.col("pos").alias("p"), F.col("size").alias("p_size"), F.col("spacing").alias("p_sp"))
    s = shop.select(*keys, F.col("pos").alias("s"), F.col("size").alias("s_size"), F.col("spacing").alias("s_sp"))
    both = p.join(s, keys)
    close = (F.col("p_size") == F.col("s_size")) & (F.col("p_sp").isNull() | (F.abs(F.col("p_sp") - F.col("s_sp")) <= SPACING_TOL))
    gap = F.abs(F.coalesce("p_sp", F.lit(0.0)) - F.coalesce("s_sp", F.lit(0.0)))
    hits = both.where(F.coalesce(close, F.lit(False))).groupBy(*keys, "s").agg(F.min("p").alias("p"))
    alone = both.join(hits.select(*keys, "p").distinct(), [*keys, "p"], "left_anti").groupBy(*keys, "p").agg(
        F.min(F.struct((F.col("p_size") != F.col("s_size")).alias("other"), gap.alias("gap"), "s")).alias("b")
    ).select(*keys, F.col("b.s").alias("s"), "p")
    so_far = hits.select(*keys, "s", "p", F.lit("match").alias("how")).unionByName(alone.withColumn("how", F.lit("closest")).select(*keys, "s", "p", "how"))
    rest = both.join(so_far.select(*keys, "s").distinct(), [*keys, "s"], "left_anti").groupBy(*keys, "s").agg(
        F.min(F.struct(gap.alias("gap"), "p")).alias("b")
    ).select(*keys, "s", F.col("b.p").alias("p"), F.lit("rest").alias("how"))
    return so_far.unionByName(rest)


def merge_views(plan: DataFrame, shop: DataFrame) -> DataFrame:
    """Views of both sides by beam: aligned when both have one, else solo; a beam read on one side only is in doubt.

    Sides hold beam, view, zone; views with stirrups are preferred, else the one with most bars.
    """

    def chosen(side: DataFrame, name: str) -> DataFrame:
        views = side.groupBy("beam", "view").agg(F.count(F.lit(1)).alias("bars"), F.bool_or(F.col("zone") == "LIG").cast("int").alias("lig"))
        per = views.groupBy("beam").agg(
            F.sum("lig").alias("n_lig"), F.sum(F.when(F.col("lig") == 1, F.col("bars"))).alias("lig_bars"),
            F.max(F.struct("bars", (-F.col("view")).alias("v"))).alias("best"),
        )
        return per.select(
            "beam", F.when(F.col("n_lig") > 0, F.col("n_lig")).otherwise(1).alias(f"{name}_views"),
            F.when(F.col("n_lig") > 0, F.col("lig_bars")).otherwise(F.col("best.bars")).alias(f"{name}_bars"),
        )

    both = chosen(plan, "plan").join(chosen(shop, "shop"), "beam", "full")
    side = F.when(F.col("plan_views").isNull(), "shop only").when(F.col("shop_views").isNull(), "plan only").otherwise("both")
    return both.withColumn("side", side).withColumn("doubt", (side != "both").cast("int"))


def agreement(a: DataFrame, b: DataFrame, key: str, field: Column) -> DataFrame:
    """Do two readings of a block hold the same multiset of values? Each value counts for one reading and against the other; nulls are no values."""
    reading = lambda df, sign: df.select(key, field.alias("_v"), F.lit(sign).cast("long").alias("_s"))
    values = reading(a, 1).unionByName(reading(b, -1)).groupBy(key, "_v").agg(
        F.sum("_s").alias("_d"), F.max("_s").alias("_a"), F.min("_s").alias("_b")
    )
    blocks = values.groupBy(key).agg(
        F.bool_and(F.col("_v").isNull() | (F.col("_d") == 0)).cast("int").alias("agree"), F.max("_a").alias("_a"), F.min("_b").alias("_b")
    )
    return blocks.where((F.col("_a") == 1) & (F.col("_b") == -1) & F.col(key).isNotNull()).select(key, "agree")


def merge_reads(lines: DataFrame) -> DataFrame:
    """Lines (block, line, text, own array, extra array) with the extra values that may be added and why the others may not.

    An extra value must occur in the text, on a line without own values, and be new.
    """
    grounded = lambda v: F.col("text").contains(v)
    covered = lambda v: F.array_contains(F.col("known"), v)
    reason = lambda v: (
        F.when(~grounded(v), "not grounded").when(F.size("own") > 0, "line already read").when(covered(v), "already known")
    )
    judged = lines.withColumn("_j", F.transform("extra", lambda v: F.struct(v.alias("v"), reason(v).alias("why"))))
    return judged.withColumns(
        {
            "added": F.array_distinct(F.transform(F.filter("_j", lambda j: j["why"].isNull()), lambda j: j["v"])),
            "rejected": F.transform(F.filter("_j", lambda j: j["why"].isNotNull()), lambda j: j["why"]),
        }
    ).drop("_j")
