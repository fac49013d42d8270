"""Merkle manifest of a data set with a membership proof for every row, built by streaming appends with incremental witnesses.

A row's leaf is the SHA-256 of its fields. The leaves of a group (a source), in order, are the bottom of a tree of runs of ``ARITY``; the
groups' roots, in order of the groups, are the bottom of the tree above. Digests are lower-case hex text.

1. A scan computes the leaves; texts go no further. The leaf table is written once.
2. Leaves get their places: a range exchange by (group, key), counts per partition and group, running sums of these counts. A group may lie
   in any number of partitions.
3. Places are cut into aligned blocks of ``BLOCK`` leaves (three levels). A task streams the leaves of its blocks in order and appends them.
   An open run keeps for each of its nodes the partial witness: what stood left of it when it came, and each later sibling, added when
   that sibling is complete. A full run becomes a node of the next level, which is an append there.
4. Block roots are appended in the same way (4,096 times fewer each time) until one is left per group; the groups' roots are appended last.
   Their witnesses go back down by joins on the block.
5. A second stream over the leaves of each block, headed by the block's own witness, completes every leaf's witness, and folds with it.

A task holds one block's leaves and open runs, whatever the size of a group. Only the largest count of a level goes to the driver.

Defined results: null fields are `-` and differ from empty ones; null groups are one group before all others; null keys come first in
their group; equal keys are ordered by leaf, so repeated rows have equal proofs; an empty table has no rows. A single leaf is its group's
root, and a proof without siblings is the digest of nothing. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.registry import query, table
from ravelin.llm.storage import written

ARITY = 16
LEVELS = 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ALL = "1"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """Digest of a row's fields: `-` for null, else the UTF-8 byte count, `:` and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


class OpenRun:
    """Nodes of a run that isn't full yet, each with its partial witness."""

    def __init__(self):
        self.nodes: list[str] = []
        self.left: list[str] = []
        self.right: list[list[str]] = []

    def append(self, node: str) -> None:
        for later in self.right:
            later.append(node)
        self.left.append("".join(self.nodes))
        self.right.append([])
        self.nodes.append(node)

    def closed(self) -> tuple[str, list[tuple[str, str]]]:
        """The run's digest, and the completed witness (left, right) of each node."""
        return digest("".join(self.nodes)), [(a, "".join(b)) for a, b in zip(self.left, self.right)]


class Appender:
    """Tree over the appended nodes of one aligned block; ``steps[level][index]`` is the witness of a completed node."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open = [OpenRun() for _ in range(levels)]
        self.steps: list[list[tuple[str, str]]] = [[] for _ in range(levels)]
        self.root: str | None = None

    def append(self, node: str, level: int = 0) -> None:
        if level == self.levels:
            self.root = node
            return
        self.open[level].append(node)
        if len(self.open[level].nodes) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        node, steps = self.open[level].closed()
        self.open[level] = OpenRun()
        self.steps[level] += steps
        self.append(node, level + 1)

    def finish(self) -> str:
        for level in range(self.levels):
            if self.open[level].nodes:
                self._close(level)
        return self.root

    def witness(self, index: int) -> list[tuple[str, str]]:
        return [self.steps[level][index // ARITY**level] for level in range(self.levels)]


def levels_of(count: int) -> int:
    """Levels inside a block of a group of ``count`` nodes: all of them where the group goes on beyond the block."""
    levels = 0
    while levels < LEVELS and count > ARITY**levels:
        levels += 1
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (group, block) after the other, in their order."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row["g"], row["block"]) != (rows[0]["g"], rows[0]["block"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


STEPS = pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))
STEPS_SQL = "array<struct<a:string,b:string>>"


def _append_blocks(with_steps: bool):
    def run(batches):
        if with_steps:
            schema = pa.schema([("g", pa.string()), ("place", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("root", pa.string()), ("steps", STEPS)])
        else:
            schema = pa.schema([("g", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("root", pa.string())])
        found: list[tuple] = []
        for rows in _blocks(batches):
            tree = Appender(levels_of(rows[0]["n"]))
            for row in rows:
                tree.append(row["node"])
            root, head = tree.finish(), rows[0]
            if with_steps:
                found += [(r["g"], r["place"], r["block"], r["n"], root, [{"a": a, "b": b} for a, b in tree.witness(i)]) for i, r in enumerate(rows)]
            else:
                found.append((head["g"], head["block"], head["n"], root))
            if len(found) >= (512 if with_steps else BLOCK):
                yield _out(found, schema)
                found = []
        if found:
            yield _out(found, schema)

    return run


def _streamed(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes dealt by aligned block, each block in order."""
    dealt = nodes.withColumn("block", F.floor(F.col("place") / BLOCK)) if "block" not in nodes.columns else nodes
    return dealt.select("g", "block", "place", "n", "node", *more).repartition("g", "block").sortWithinPartitions("g", "block", "place")


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place`` (from 0, within ``g``, by ``order``) and ``n``, the group's number of rows. Works for groups of any size."""
    cut = nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    runs = written(cut.withColumn("part", F.spark_partition_id()).withColumn("at", at), "merkle-order")
    pieces = runs.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    group = Window.partitionBy("g")
    before = F.sum("size").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("g", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(group).alias("n"))
    return runs.join(pieces, ["g", "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def climb(nodes: DataFrame) -> DataFrame:
    """(g, place, top, steps) for nodes (g, place, n, node): the root of each group and the witness of each node up to it."""
    schema = f"g string, place long, block long, n long, root string, steps {STEPS_SQL}"
    own = written(_streamed(nodes).mapInArrow(_append_blocks(True), schema), "merkle-steps")
    most = own.agg(F.max("n")).first()[0] or 0
    if most <= BLOCK:
        return own.select("g", "place", F.col("root").alias("top"), "steps")
    above = own.groupBy("g", "block").agg(F.first("root").alias("node"), F.first("n").alias("n"))
    above = climb(above.select("g", F.col("block").alias("place"), F.ceil(F.col("n") / BLOCK).alias("n"), "node"))
    above = above.select("g", F.col("place").alias("block"), "top", F.col("steps").alias("more"))
    return own.join(above, ["g", "block"]).select("g", "place", "top", F.concat("steps", "more").alias("steps"))


def witnessed_blocks(leaves: DataFrame) -> DataFrame:
    """(g, block, subroot, root, steps) for leaves (g, place, n, node): each block's witness through its group's root to the root."""
    roots = written(_streamed(leaves).mapInArrow(_append_blocks(False), "g string, block long, n long, root string"), "merkle-blocks")
    inner = climb(roots.select("g", F.col("block").alias("place"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("node")))
    groups = inner.groupBy(F.col("g").alias("group")).agg(F.first("top").alias("node"))
    groups = placed(groups.withColumn("g", F.lit(ALL)), ["group"])
    outer = climb(groups).select("place", F.col("top").alias("root"), F.col("steps").alias("more"))
    outer = groups.select(F.col("group").alias("g"), "place").join(outer, "place").select("g", "root", "more")
    return inner.join(outer, "g").select("g", F.col("place").alias("block"), F.col("top").alias("subroot"), "root", F.concat("steps", "more").alias("steps"))


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its witness give."""
    for left, right in steps:
        leaf = digest(left + leaf + right)
    return leaf


PROVED = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])


def _prove(batches):
    """Streams of a header (place -1: the block's witness) and the block's leaves."""
    found: list[tuple] = []
    for rows in _blocks(batches):
        head, rows = rows[0], rows[1:]
        upper = [(s["a"], s["b"]) for s in head["steps"]]
        upper_text = "".join(a + b for a, b in upper)
        tree = Appender(levels_of(rows[0]["n"]))
        for row in rows:
            tree.append(row["node"])
        tree.finish()
        for i, row in enumerate(rows):
            steps = tree.witness(i)
            proof = digest("".join(a + b for a, b in steps) + upper_text)
            top = fold(row["claimed"], steps + upper)
            found.append((row["doc_id"], row["node"], head["subroot"], head["root"], proof, top, top == head["root"]))
        if len(found) >= BLOCK:
            yield _out(found, PROVED)
            found = []
    if found:
        yield _out(found, PROVED)


def proofs(leaves: DataFrame) -> DataFrame:
    """Proof of every leaf, folded from the claimed leaf. ``leaves``: g, place, n, node (the leaf), claimed (the leaf to verify), doc_id."""
    heads = witnessed_blocks(leaves).select("g", "block", F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("n"), "subroot", "root", "steps")
    rows = leaves.withColumn("block", F.floor(F.col("place") / BLOCK))
    both = rows.unionByName(heads, allowMissingColumns=True)
    sql = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _streamed(both, "claimed", "doc_id", "subroot", "root", "steps").mapInArrow(_prove, sql)


def leaf_table(docs: DataFrame, claimed_text: Column) -> DataFrame:
    """(g, place, n, node, claimed, doc_id) of documents; ``claimed_text`` stands for the text in the leaf that is to be verified."""
    fields = [F.col(c) for c in FIELDS]
    claimed = [*fields[:-1], claimed_text]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(fields).alias("node"), leaf_of(claimed).alias("claimed"), F.monotonically_increasing_id().alias("uid"),
    )
    return placed(written(leaves, "merkle-leaves"), ["doc_id", "node", "uid"]).drop("uid")


def tampered_text() -> Column:
    """Text of the documents as the test of the manifest changes it: A-Z lower-cased where 5 divides the CRC-32 of the id."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lower).otherwise(F.col("text"))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, group root, root and proof of every document, and whether the claimed document verifies."""
    return proofs(leaf_table(docs, tampered_text()))


def _check_sql(inner: int = 5, outer: int = 4) -> str:
    """Levels are written out: 16**inner leaves per source, 16**outer sources."""

    def field(c):
        return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"

    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    head = " || ".join(field(c) for c in FIELDS[:-1])
    parts = [f"""
    WITH RECURSIVE bits(i, k, c) AS (
        SELECT range, 0, range FROM range(256)
        UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    docs AS (SELECT doc_id, source, sha256({head} || {field('text')}) AS leaf,
        CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::BIGINT)),
                 lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 5 = 0
             THEN sha256({head} || {field(f"translate(text, '{upper}', '{lower}')")}) ELSE sha256({head} || {field('text')}) END AS claimed
        FROM documents, crc),
    placed AS (SELECT *, coalesce('1' || source, '0') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs),
    s0 AS (SELECT g, i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM placed)"""]

    def levels(name, count):
        for k in range(count):
            run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            parts.append(f"""
    {name}{k}w AS (SELECT g, i, n, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
        coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{k}),
    {name}{k + 1} AS (SELECT g, i, d, count(*) OVER (PARTITION BY g) AS n FROM (
        SELECT g, i // 16 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d FROM {name}{k} GROUP BY g, i // 16))""")

    levels("s", inner)
    parts.append(f"""
    r0 AS (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, count(*) OVER () AS n, g AS source_g FROM s{inner})""")
    levels("r", outer)
    parts.append(f"""
    f0 AS (SELECT placed.doc_id, placed.g, placed.i, r0.i AS j, placed.leaf, r0.d AS subroot, r{outer}.d AS root, placed.claimed AS c, '' AS p
        FROM placed JOIN r0 ON r0.source_g = placed.g CROSS JOIN r{outer})""")
    for k in range(inner + outer):
        name, on = (f"s{k}w", f"w.g = f.g AND w.i = f.i // {16**k}") if k < inner else (f"r{k - inner}w", f"w.i = f.j // {16 ** (k - inner)}")
        parts.append(f"""
    f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN w.n > 1 THEN sha256(w.a || f.c || w.b) ELSE f.c END AS c, CASE WHEN w.n > 1 THEN f.p || w.a || w.b ELSE f.p END AS p)
        FROM f{k} f JOIN {name} w ON {on})""")
    return ",".join(parts) + f"""
    SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, c AS folded_root, c = root AS verified FROM f{inner + outer}"""


@query("op13_merkle_manifest", _check_sql())
def op13_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))
