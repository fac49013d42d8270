"""Exact vector search through a metric index: cells around centres, and the triangle inequality of angles on the unit sphere.

The centres are vectors of the index itself, a fixed sample of at most ``MAX_CENTRES``. Every vector lies in the cell of its nearest
centre and keeps its angle to it; a cell keeps its radius. A query can miss

* a cell: no vector of it is nearer than the angle to the centre less the radius;
* a vector: it is no nearer than the difference of both angles to the centre.

What is near enough follows from the centres too: they are indexed vectors, so the k-th best of them is a score that the k-th best hit
reaches or passes. Cells that lie together form tiles of bounded size, and a cell larger than that is cut into several. A search is one
cogroup of tiles and blocks of queries: a query goes to the tiles that have a cell for it, a cell is multiplied with its queries as matrices,
and each tile gives the ``k`` best it has. Without clusters every query goes to every tile: vectors times queries, in bounded memory.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.ordering import top_per_key
from ravelin.operators.search import PREPARED_LEXICAL, PREPARED_SEMANTIC, match_prepared
from ravelin.session import cut_lineage

MAX_CENTRES = 4096
#: Bounds give way by this much, beyond the nine digits of a score.
SLACK = 1e-8
#: Cell of vectors without a direction, whose score is 0 for every query.
NO_CELL = -1
#: Vectors of a tile: as many as make this number of tiles, within bounds. Queries of a block.
TILES, TILE, BLOCK = 64, (256, 16384), 16384
#: Numbers of a matrix in a task, and hits held before they are cut to the best.
CELLS, HELD = 1 << 20, 1 << 20
DIGITS = 1e9


@dataclass
class MetricIndex:
    """``rows``: id, vector, weight, cell, angle, tile. The arrays are per centre: its id, direction and weight, and its cell's radius and greatest weight.

    ``held`` are the cells of the tiles, tile after tile, and ``starts`` where each tile begins in them.
    """

    rows: DataFrame
    ids: np.ndarray
    centres: np.ndarray
    weights: np.ndarray
    radius: np.ndarray
    heaviest: np.ndarray
    size: int
    held: np.ndarray
    starts: np.ndarray


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), float).reshape(len(vectors), -1)


def _dense(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Matrix of a column of equally long arrays."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks] or [np.zeros(0)]) if isinstance(vectors, pa.ChunkedArray) else vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), len(flat) // max(len(vectors), 1))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _slices(n: int, width: int):
    """Ranges of ``n`` rows with at most ``CELLS`` numbers of this width each."""
    step = max(1, CELLS // max(width, 1))
    return (slice(low, low + step) for low in range(0, n, step))


def _tiles(cells: pd.DataFrame, directions: np.ndarray, size: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Cells (cell, n) packed into tiles beside their neighbours: (cell, tile, parts) and the cells and starts of the tiles."""
    room = min(max(TILE[0], math.ceil(size / TILES)), TILE[1])
    pivots = _angles(directions, directions[:TILES])
    near = {int(c): (int(pivots[c].argmin()), float(pivots[c].min())) if c != NO_CELL else (-1, 0.0) for c in cells["cell"]}
    placed, held, starts, left = [], [], [], 0
    for cell, n in sorted(zip(cells["cell"].tolist(), cells["n"].tolist()), key=lambda x: near[x[0]]):
        parts = math.ceil(n / room)
        if n > left:
            starts += range(len(held), len(held) + parts)
            left = room if parts == 1 else 0
        placed.append((cell, len(starts) - parts, parts))
        held += [cell] * parts
        left -= n if parts == 1 else 0
    return pd.DataFrame(placed, columns=["cell", "tile", "parts"]), np.array(held, int), np.array(starts, int)


def build(index: DataFrame, centres: int | None = None) -> MetricIndex:
    """Index of (id, vector, weight): unit vectors or zeros, weights of 0 or more. About two centres for each root of the number of vectors."""
    size = index.count()
    wanted = min(MAX_CENTRES, centres or max(16, math.ceil(2 * math.sqrt(size))))
    directed = index.where(F.exists("vector", lambda v: v != 0))
    chosen = directed.orderBy(F.xxhash64("id"), "id").limit(wanted).select("id", "vector", "weight").toPandas()
    directions = _matrix(chosen["vector"]) if len(chosen) else np.zeros((0, 1))
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(directions)

    @F.pandas_udf("cell int, angle double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        cell, angle = np.full(len(vectors), NO_CELL, np.int32), np.zeros(len(vectors))
        for s in _slices(len(vectors), len(shared.value)):
            rows = _matrix(vectors.iloc[s])
            at = np.flatnonzero((rows != 0).any(1))
            if len(at):
                angles = _angles(rows[at], shared.value)
                cell[s.start + at] = angles.argmin(1)
                angle[s.start + at] = angles.min(1)
        return pd.DataFrame({"cell": cell, "angle": angle})

    rows = cut_lineage(index.select("id", "vector", "weight", place("vector").alias("p")).select("id", "vector", "weight", "p.cell", "p.angle"))
    cells = rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.max("weight").alias("heaviest"), F.count(F.lit(1)).alias("n")).toPandas()
    radius, heaviest = np.full(len(chosen), -1.0), np.zeros(len(chosen))
    own = cells[cells["cell"] != NO_CELL]
    radius[own["cell"]], heaviest[own["cell"]] = own["radius"], own["heaviest"]
    placed, held, starts = _tiles(cells, directions, size)
    where = F.broadcast(spark.createDataFrame(placed.itertuples(index=False, name=None), "cell int, first int, parts int"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    tiled = rows.join(where, "cell").select("id", "vector", "weight", "cell", "angle", (F.col("first") + part).alias("tile"))
    return MetricIndex(tiled, chosen["id"].to_numpy(), directions, chosen["weight"].to_numpy(float), radius, heaviest, size, held, starts)


def _may_hold(angle: np.ndarray, reach: np.ndarray, radius: np.ndarray, heaviest: np.ndarray) -> np.ndarray:
    """Whether the cells, at these angles from the queries, may hold a score of ``reach``."""
    nearest = np.maximum(angle - radius, 0.0)
    # a negative cosine scores best under the smallest weight, which may be 0
    return (radius >= 0) & (np.where(nearest < np.pi / 2, np.cos(nearest) * heaviest, 0.0) >= reach[:, None])


def probes(index: MetricIndex, queries: DataFrame, k: int, exclude_self: bool = False, floor: float | None = None) -> DataFrame:
    """(tile, query, vector, reach) for each tile that may hold one of the ``k`` best; ``reach`` is the score a hit must have."""
    shared = queries.sparkSession.sparkContext.broadcast((index.ids, index.centres, index.weights, index.radius, index.heaviest, index.held, index.starts))

    def probe(batches):
        ids, centres, weights, radius, heaviest, held, starts = shared.value
        for batch in batches:
            for s in _slices(batch.num_rows, 4 * max(len(centres), len(starts), 1)) if len(starts) else ():
                asked = batch.slice(s.start, s.stop - s.start)
                query, v = asked.column("query"), _dense(asked.column("vector"))
                angle = _angles(v, centres) if len(centres) else np.zeros((len(v), 0))
                score, others = np.cos(angle) * weights, np.full(len(v), len(centres))
                if exclude_self and len(centres):
                    same = pc.index_in(query, value_set=pa.array(ids, type=query.type)).fill_null(-1).to_numpy(zero_copy_only=False)
                    at = np.flatnonzero(same >= 0)
                    score[at, same[at]] = -np.inf
                    others[at] -= 1
                best = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(v), -np.inf)
                reach = np.maximum(np.where(others >= k, best, -np.inf), -np.inf if floor is None else floor) - SLACK
                cells = np.column_stack([_may_hold(angle, reach, radius, heaviest), reach <= 0])  # the last one is that of no direction
                who, tile = np.nonzero(np.logical_or.reduceat(cells[:, held], starts, axis=1))
                out = [pa.array(tile.astype(np.int32)), query.take(pa.array(who)), asked.column("vector").take(pa.array(who)), pa.array(reach[who])]
                yield pa.RecordBatch.from_arrays(out, names=["tile", "query", "vector", "reach"])

    kind = dict(queries.dtypes)["query"]
    return queries.select("query", "vector").mapInArrow(probe, f"tile int, query {kind}, vector array<double>, reach double")


@dataclass
class _Tile:
    """Vectors of a tile in the order of their ids, and the queries sent to it."""

    rows: pa.Table
    asked: pa.Table
    vectors: np.ndarray
    weight: np.ndarray
    queries: np.ndarray
    reach: np.ndarray
    own: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, asked: pa.Table, exclude_self: bool) -> _Tile:
        rows = rows.sort_by("id")
        own = np.full(len(asked), -1)
        if exclude_self:
            own = pc.index_in(asked["query"], value_set=rows["id"].combine_chunks().cast(asked["query"].type)).fill_null(-1).to_numpy()
        return cls(rows, asked, _dense(rows["vector"]), rows["weight"].to_numpy(), _dense(asked["vector"]), asked["reach"].to_numpy(), own)

    def meetings(self, centres: np.ndarray, radius: np.ndarray, heaviest: np.ndarray):
        """Each cell with the queries that may find something in it, in pieces of at most ``CELLS`` pairs: (cell, queries, their angles, rows)."""
        cells = self.rows["cell"].to_numpy()
        for cell in np.unique(cells):
            if cell == NO_CELL:
                angle, who = np.zeros(len(self.reach)), np.flatnonzero(self.reach <= 0)
            else:
                angle = _angles(self.queries, centres[[cell]])
                who, angle = np.flatnonzero(_may_hold(angle, self.reach, radius[[cell]], heaviest[[cell]])[:, 0]), angle[:, 0]
            at = np.flatnonzero(cells == cell)
            for low in range(0, len(at), 1024):
                part = at[low : low + 1024]
                for s in _slices(len(who), len(part)):
                    yield cell, who[s], angle[who[s]], part

    def hits(self, centres: np.ndarray, radius: np.ndarray, heaviest: np.ndarray, k: int, floor: float | None) -> pa.Table:
        """The ``k`` best of each query in this tile: (query, id, score)."""
        none = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        found, size, least = [none], 0, self.reach.copy()
        for _, who, _, part in self.meetings(centres, radius, heaviest):
            scores = self.queries[who] @ self.vectors[part].T * self.weight[part]
            a, b = np.nonzero(scores >= least[who, None])
            score = scores[a, b]
            level = np.sign(score) * np.floor(np.abs(score) * DIGITS + 0.5) + 0.0
            query, row = who[a], part[b]
            kept = self.own[query] != row
            if floor is not None:
                kept &= level / DIGITS >= floor
            found.append((query[kept], row[kept], level[kept]))
            size += int(kept.sum())
            if size > HELD:
                found = [_best(found, k)]
                query, _, level = found[0]
                size = len(query)
                worst = np.full(len(least), np.inf)
                np.minimum.at(worst, query, level / DIGITS)
                least = np.where(np.bincount(query, minlength=len(least)) >= k, np.maximum(least, worst - SLACK), least)
        query, row, level = _best(found, k) if size else none
        return pa.table({"query": self.asked["query"].take(pa.array(query)), "id": self.rows["id"].take(pa.array(row)), "score": pa.array(level / DIGITS)})


def _best(found: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of each query: (query, row, score in units of the last digit), rows in the order of ids."""
    query, row, level = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((row, -level, query))
    query, row, level = query[order], row[order], level[order]
    begins = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    rank = np.arange(len(query)) - np.repeat(begins, np.diff(np.r_[begins, len(query)]))
    return query[rank < k], row[rank < k], level[rank < k]


def _over_tiles(index: MetricIndex, queries: DataFrame, k: int, exclude_self: bool, floor: float | None, run, schema: str) -> DataFrame:
    """``run(tile, centres, radius, heaviest)`` gives a table for each tile and block of its queries."""
    blocks = -(-queries.count() // BLOCK)
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.heaviest))
    block = F.pmod(F.xxhash64("query"), F.lit(max(blocks, 1))).cast("int").alias("block")
    asked = probes(index, queries, k, exclude_self, floor).select("tile", block, "query", "vector", "reach")
    rows = index.rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))).alias("block"))

    def both(rows: pa.Table, asked: pa.Table) -> pa.Table:
        return run(_Tile.of(rows, asked, exclude_self), *shared.value)

    return rows.groupBy("tile", "block").cogroup(asked.groupBy("tile", "block")).applyInArrow(both, schema)


def search(index: MetricIndex, queries: DataFrame, k: int, exclude_self: bool = False, floor: float | None = None) -> DataFrame:
    """Exact top ``k`` by cosine times weight of each query (query, vector), ties by id; ``floor`` is a least score."""

    def run(tile: _Tile, *cells: np.ndarray) -> pa.Table:
        return tile.hits(*cells, k, floor)

    schema = f"query {dict(queries.dtypes)['query']}, id {dict(index.rows.dtypes)['id']}, score double"
    scored = _over_tiles(index, queries, k, exclude_self, floor, run, schema)
    return top_per_key(scored, ["query"], [F.desc("score"), F.asc("id")], k, "position")


def scored_share(index: MetricIndex, queries: DataFrame, k: int, exclude_self: bool = False, floor: float | None = None) -> DataFrame:
    """One row: pairs that the bounds leave, vector by vector, and all pairs of queries and vectors. A search multiplies the cells left whole."""

    def run(tile: _Tile, centres: np.ndarray, radius: np.ndarray, heaviest: np.ndarray) -> pa.Table:
        n, angles = 0, tile.rows["angle"].to_numpy()
        for cell, who, angle, part in tile.meetings(centres, radius, heaviest):
            bound = np.cos(np.abs(angles[part] - angle[:, None])) * tile.weight[part]
            left = (cell == NO_CELL) | (bound >= tile.reach[who, None])
            n += int((left & (part != tile.own[who, None])).sum())
        return pa.table({"n": pa.array([n])})

    counted = _over_tiles(index, queries, k, exclude_self, floor, run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("scored"))
    pairs = F.lit(queries.count() * index.size)
    return counted.select("scored", pairs.alias("pairs"), (F.col("scored") / pairs).alias("share"))


def match_in_tiers(queries: DataFrame, prepared: DataFrame, semantic: float = PREPARED_SEMANTIC, lexical: float = PREPARED_LEXICAL) -> DataFrame:
    """Prepared entry per query: the entry it names, else the nearest one by vector, else by words; (query, tier, id, score).

    A query with a vector is judged by it alone, at ``semantic`` or more: words decide only where there is none, so a near miss of
    meaning isn't made up for by shared words. Queries (query, body, tokens, vector or null), prepared (id, code, tokens, vector).
    """
    from ravelin.operators import vectors

    code = F.upper(F.regexp_extract("body", r"(?i)\b(Q\d{2}|EX\d)\b", 1))
    named = queries.select("query", code.alias("code")).where("code <> ''").join(prepared.select("id", "code"), "code")
    named = named.groupBy("query").agg(F.min("id").alias("id")).select("query", F.lit("named").alias("tier"), "id", F.lit(None).cast("double").alias("score"))
    rest = queries.join(named.select("query"), "query", "left_anti")
    index = build(prepared.where("vector IS NOT NULL").select("id", "vector", F.lit(1.0).alias("weight")))
    near = search(index, rest.where("vector IS NOT NULL").select("query", "vector"), 1, floor=semantic)
    near = near.select("query", F.lit("semantic").alias("tier"), "id", "score")
    worded = match_prepared(rest.where("vector IS NULL").withColumn("body", F.lit("")).select("query", "body", "tokens"), prepared, lexical)
    return named.unionByName(near).unionByName(worded.select("query", F.lit("lexical").alias("tier"), "id", "score"))
