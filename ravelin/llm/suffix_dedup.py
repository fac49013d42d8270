"""Removal of repeated long substrings: a distributed merge sort of sampled suffixes that carries common prefixes along.

A window is ``LENGTH`` bytes of one text. A byte goes if a window over it also starts elsewhere. Every window is charged to one suffix of
its text: the one that starts at the smallest 8-byte hash among the window's first ``REACH`` positions. The choice depends on the window's
bytes alone, so equal windows are charged to suffixes at equal distance, and only one suffix in about ``REACH / 2`` bytes is sorted. A
suffix carries the bytes of all windows charged to it: those from its start (at most ``LENGTH``), then those before it, last first.

1. A scan counts the fingerprints of the first ``SHARED`` bytes of the sampled suffixes, which all windows charged to one hold. Only
   suffixes whose fingerprint occurs twice can have a repeated window; a bit filter, sized by their number, tells them (more of them pass
   above its largest size, none is lost).
2. A second scan sorts those suffixes in runs of ``RUN_BYTES``. Equal ones of a run become one, and their places go to a table of their
   own. Runs are written front-coded: each suffix as the length of the prefix it shares with the one before, and the rest.
3. Heads of the runs' chunks give the range splitters. Chunks are cut there and exchanged, still front-coded.
4. A task per range merges its runs with a loser tree. A contender knows its common prefix with the last winner; the longer one wins
   without looking at bytes, and bytes are compared only from the known prefix on. The winners' common prefixes are the range's LCP array.
5. From the LCP array (bytes after the suffix) and a second order of the bytes before it, each distance says which suffixes have equal
   windows there. Stretches of suffixes that lie across ranges, which a hot passage makes, report digests of their windows, one per
   range and window, and those met in two ranges count too.
6. Found distances go back to the places, become byte ranges per text, and meet the texts by their digest.

A text crosses one exchange, at the end. No group is held by one task: equal suffixes are one per run, and ranges cut through everything
that differs. Equality is that of bytes; in step 5 across ranges it is that of 128-bit digests, and texts are known by 128 bits of
SHA-256.

Defined results: null texts are empty; texts below ``LENGTH`` bytes lose nothing; a text that stands in two rows repeats itself and goes
whole; overlapping copies inside one text (runs of one letter) count; repeated rows stay rows; an empty table has no rows. Ids may be null
or repeated. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm import wordhash as W
from ravelin.llm.bitmaps import bit_filter, passes
from ravelin.llm.registry import query, table
from ravelin.llm.storage import written

LENGTH = 400
REACH = 200
SHARED = LENGTH - REACH + 1
#: Window starts that are looked at together; a longer text is taken in pieces.
PIECE = 1 << 20
RUN_BYTES = 12 << 20
CHUNK_ITEMS = 1024
RANGE_BYTES = 6 << 20
MAX_RANGES = 20_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
HIGH = np.uint64(0xFFFFFFFF00000000)


def _piece(data: np.ndarray, offsets: np.ndarray, first: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix start, first window, last window, fingerprint) for window starts first..stop-1, all relative to ``data``."""
    part = data[first:stop + LENGTH - 1]
    n = len(part)
    padded = np.concatenate([part, np.zeros(8, np.uint8)])
    grams = np.empty(n, np.uint64)
    for j in range(min(8, n)):
        count = len(grams[j::8])
        grams[j::8] = padded[j:j + 8 * count].view("<u8")
    grams ^= grams >> np.uint64(29)
    grams *= MULTIPLIER
    grams &= HIGH
    grams |= np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= REACH:
        grams = np.minimum(grams[:-width], grams[width:])
        width *= 2
    if width < REACH:
        grams = np.minimum(grams[:width - REACH], grams[REACH - width:])
    starts = n - LENGTH + 1
    chosen = (grams[:starts] & ~HIGH).astype(np.int64)
    edge = np.zeros(starts + 1, np.int64)
    begin = np.clip(offsets[:-1] - first, 0, starts)
    end = np.clip(offsets[1:] - LENGTH + 1 - first, begin, starts)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    valid = np.cumsum(edge[:-1]) > 0
    same = np.zeros(starts + 1, bool)
    same[1:-1] = valid[1:] & valid[:-1] & (chosen[1:] == chosen[:-1])
    low, high = np.flatnonzero(valid & ~same[:-1]), np.flatnonzero(valid & ~same[1:])
    at = chosen[low]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(W.BYTE_VALUES[part] * W.powers(W.BASE, n), out=sums[1:])
    prints = W.mix((sums[at + SHARED] - sums[at]) * W.powers(W.BASE_INVERSE, n)[at])
    return at + first, low + first, high + first, prints


def sampled(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sampled suffixes of the texts of a slice, in pieces of bounded size."""
    starts = len(data) - LENGTH + 1
    for first in range(0, max(starts, 0), PIECE):
        yield _piece(data, offsets, first, min(first + PIECE, starts))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in W.text_slices(batch.column(0)):
            for _, _, _, prints in sampled(data, offsets):
                values, counts = np.unique(prints, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], names=["print", "n"])


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of which ``known`` bytes are known."""
    n, step = min(len(a), len(b)), 24
    while known < n:
        stop = min(known + step, n)
        x, y = a[known:stop], b[known:stop]
        if x != y:
            parted = (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length()
            return stop - (parted + 7) // 8
        known, step = stop, step * 4
    return n


class Item:
    """A suffix as sorted: its bytes, how many of them stand from its start on, and whether it stands for several places."""

    __slots__ = ("text", "ahead", "many")

    def __init__(self, text: bytes, ahead: int, many: bool):
        self.text, self.ahead, self.many = text, ahead, many


def encode(items: list[Item]) -> bytes:
    """Front-coded, compressed chunk."""
    shared, rests, before = [], [], b""
    for item in items:
        k = common(before, item.text)
        shared.append(k)
        rests.append(item.text[k:])
        before = item.text
    columns = np.array([shared, [len(r) for r in rests], [i.ahead for i in items], [i.many for i in items]], np.uint16)
    return zstandard.ZstdCompressor(level=1).compress(columns.tobytes() + b"".join(rests))


def decode(chunk: bytes, n: int) -> tuple[list[Item], list[int]]:
    """Items of a chunk, and the prefix each shares with the one before (the first: 0)."""
    data = zstandard.ZstdDecompressor().decompress(chunk)
    shared, lengths, ahead, many = np.frombuffer(data, np.uint16, 4 * n).reshape(4, n).tolist()
    items, at, before = [], 8 * n, b""
    for k, length, a, m in zip(shared, lengths, ahead, many):
        before = before[:k] + data[at:at + length]
        at += length
        items.append(Item(before, a, bool(m)))
    return items, shared


RUNS = pa.schema([
    ("run", pa.int64()), ("item", pa.int32()), ("n", pa.int32()), ("raw", pa.int64()), ("head", pa.binary()), ("tail", pa.binary()), ("chunk", pa.binary()),
    ("text_key", pa.binary()), ("at", pa.int64()),
])
RUNS_SQL = "run long, item int, n int, raw long, head binary, tail binary, chunk binary, text_key binary, at long"


def _run_rows(run: int, found: list[tuple[bytes, int, bytes, int]]) -> Iterator[pa.RecordBatch]:
    """Chunks of one sorted run, and the places of its items. ``found``: (suffix bytes, bytes ahead, text key, place)."""
    found.sort(key=lambda x: x[:2])
    items: list[Item] = []
    number = []
    for text, ahead, _, _ in found:
        if items and items[-1].text == text and items[-1].ahead == ahead:
            items[-1].many = True
        else:
            items.append(Item(text, ahead, False))
        number.append(len(items) - 1)
    for start in range(0, len(items), CHUNK_ITEMS):
        part = items[start:start + CHUNK_ITEMS]
        row = {"run": run, "item": start, "n": len(part), "raw": sum(len(i.text) for i in part), "head": part[0].text, "tail": part[-1].text, "chunk": encode(part)}
        yield pa.RecordBatch.from_pylist([row], schema=RUNS)
    n = len(found)
    none = pa.nulls(n, pa.binary())
    columns = [pa.array([run] * n, pa.int64()), pa.array(number, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), none, none, none,
               pa.array([x[2] for x in found], pa.binary()), pa.array([x[3] for x in found], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, schema=RUNS)


def _sorted_runs(shared, run_bytes: int):
    def run(batches):
        bitmap = shared.value
        first = TaskContext.get().partitionId() << 32
        runs, size, found = 0, 0, []
        for batch in batches:
            keys = batch.column("text_key")
            for start, _, data, offsets in W.text_slices(batch.column("text")):
                raw = None
                for at, low, high, prints in sampled(data, offsets):
                    likely = np.flatnonzero(passes(bitmap, prints))
                    if not len(likely):
                        continue
                    raw = raw if raw is not None else data.tobytes()
                    row = np.searchsorted(offsets, low[likely], "right") - 1
                    places = (at[likely] - offsets[row]).tolist()
                    for a, p, q, r, place in zip(at[likely].tolist(), low[likely].tolist(), high[likely].tolist(), row.tolist(), places):
                        text = raw[a:q + LENGTH] + raw[p:a][::-1]
                        found.append((text, q + LENGTH - a, keys[start + r].as_py(), place))
                        size += len(text) + 150
                        if size >= run_bytes:
                            yield from _run_rows(first + runs, found)
                            runs, size, found = runs + 1, 0, []
        if found:
            yield from _run_rows(first + runs, found)

    return run


CUT_SQL = "range int, run long, item int, n int, chunk binary"


def _cut(shared):
    """Chunks cut at the splitters; those inside one range pass as they are."""

    def run(batches):
        splitters = shared.value
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                low, high = bisect_right(splitters, row["head"]), bisect_right(splitters, row["tail"])
                if low == high:
                    out.append((low, row["run"], row["item"], row["n"], row["chunk"]))
                    continue
                items, _ = decode(row["chunk"], row["n"])
                texts, start = [i.text for i in items], 0
                for part in range(low, high + 1):
                    stop = len(items) if part == high else next((j for j in range(start, len(items)) if texts[j] >= splitters[part]), len(items))
                    if stop > start:
                        out.append((part, row["run"], row["item"] + start, stop - start, encode(items[start:stop])))
                    start = stop
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["range", "run", "item", "n", "chunk"])

    return run


class Stream:
    """A run's items in order, with the prefix each shares with the one before."""

    def __init__(self, run: int):
        self.run, self.items, self.shared, self.numbers, self.at = run, [], [], [], 0

    def extend(self, first: int, items: list[Item], shared: list[int]) -> None:
        if self.items:
            shared = [common(self.items[-1].text, items[0].text), *shared[1:]]
        self.items += items
        self.shared += shared
        self.numbers += range(first, first + len(items))


def merged(streams: list[Stream]) -> Iterator[tuple[Stream, int, int]]:
    """(stream, index, prefix shared with the item before) in sorted order, by a loser tree over known prefixes.

    Each contender's ``known`` is its common prefix with the last winner. Of two, the one with the longer known prefix is smaller, and the
    other's known prefix with it stays what it is; equal ones are compared from there on, and the loser's known prefix is where they part.
    """
    k = 1 << max(0, (len(streams) - 1).bit_length())
    known = [0] * k
    heads: list[Item | None] = [s.items[0] if s.items else None for s in streams] + [None] * (k - len(streams))

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        h = common(x.text, y.text, known[a])
        ends = (len(x.text), len(y.text))
        if h == ends[0] and h == ends[1]:
            first = (x.ahead, a) < (y.ahead, b)
        else:
            first = h == ends[0] or (h < ends[1] and x.text[h] < y.text[h])
        winner, loser = (a, b) if first else (b, a)
        known[loser] = h
        return winner, loser

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1] if k > 1 else 0
    while heads[winner] is not None:
        stream = streams[winner]
        yield stream, stream.at, known[winner]
        stream.at += 1
        if stream.at < len(stream.items):
            heads[winner], known[winner] = stream.items[stream.at], stream.shared[stream.at]
        else:
            heads[winner] = None
        node = (winner + k) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1


class Group:
    """Equal items of all runs: (run, number) of each."""

    __slots__ = ("item", "shared", "members", "many")

    def __init__(self, item: Item, shared: int):
        self.item, self.shared, self.members, self.many = item, shared, [], item.many


FOUND = pa.schema([("run", pa.int64()), ("item", pa.int32()), ("near", pa.int16()), ("far", pa.int16()), ("digest", pa.binary()), ("weight", pa.int32())])
FOUND_SQL = "run long, item int, near smallint, far smallint, digest binary, weight int"


def _window(text: bytes, ahead: int, distance: int) -> bytes:
    return text[ahead:ahead + distance][::-1] + text[:LENGTH - distance]


def _levels(groups: list[Group], across: np.ndarray, out: list[tuple]) -> None:
    """Distances at which items of one range have equal windows. ``groups``: whole stretches that share ``SHARED`` bytes, in order, each
    stretch's first with shared = 0; ``across``: which of them lie in a stretch that goes on in another range."""
    n = len(groups)
    shared = np.array([g.shared for g in groups])
    ahead = np.array([g.item.ahead for g in groups])
    near, far = LENGTH - ahead, np.array([len(g.item.text) for g in groups]) - ahead
    many = np.array([g.many for g in groups])
    behind = [g.item.text[g.item.ahead:] for g in groups]
    order = sorted(range(n), key=behind.__getitem__)
    parted = np.array([0, *(common(behind[a], behind[b]) for a, b in zip(order, order[1:]))])
    order = np.array(order)
    least, most = np.full(n, LENGTH), np.full(n, -1)
    back = np.empty(n, np.int64)
    for distance in range(int(near.min()), int(far.max()) + 1):
        at = np.flatnonzero((near <= distance) & (distance <= far))
        if not len(at):
            continue
        back[order] = np.cumsum(parted < distance)
        key = np.cumsum(shared < LENGTH - distance)[at] * (n + 1) + back[at]
        _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        twice = (counts > 1) | many[at[first]]
        if many[at].any():
            holds = np.zeros(len(counts), bool)
            np.logical_or.at(holds, inverse, many[at])
            twice |= holds
        hit = at[twice[inverse]]
        least[hit] = np.minimum(least[hit], distance)
        most[hit] = np.maximum(most[hit], distance)
        for j in np.flatnonzero(across[at[first]]):
            group = groups[at[first[j]]]
            digest = hashlib.blake2b(_window(group.item.text, group.item.ahead, distance), digest_size=16, person=distance.to_bytes(2, "big")).digest()
            if twice[j]:
                out.append((None, None, None, None, digest, 2))
            else:
                out.append((*group.members[0], distance, distance, digest, 1))
    for i in np.flatnonzero(most >= 0):
        if not groups[i].many:
            out += [(run, number, int(least[i]), int(most[i]), None, None) for run, number in groups[i].members]


def _merge_range(shared):
    def run(key, rows):
        splitters, part = shared.value, key[0].as_py()
        streams: list[Stream] = []
        for row in sorted(rows.to_pylist(), key=lambda r: (r["run"], r["item"])):
            if not streams or streams[-1].run != row["run"]:
                streams.append(Stream(row["run"]))
            streams[-1].extend(row["item"], *decode(row["chunk"], row["n"]))
        groups: list[Group] = []
        for stream, index, known in merged(streams):
            item = stream.items[index]
            last = groups[-1] if groups else None
            if last is not None and known == len(item.text) == len(last.item.text) and item.ahead == last.item.ahead:
                last.many = True
            else:
                last = Group(item, known)
                groups.append(last)
            last.members.append((stream.run, stream.numbers[index]))
        out: list[tuple] = []
        for g in groups:
            if g.many:
                out += [(r, i, LENGTH - g.item.ahead, len(g.item.text) - g.item.ahead, None, None) for r, i in g.members]
        edges = (splitters[part - 1] if part else None, splitters[part] if part < len(splitters) else None)
        chosen: list[Group] = []
        across: list[bool] = []
        start = 0
        for stop in range(1, len(groups) + 1):
            if stop < len(groups) and groups[stop].shared >= SHARED:
                continue
            stretch = groups[start:stop]
            open_ = (start == 0 and edges[0] is not None and common(edges[0], stretch[0].item.text) >= SHARED
                     or stop == len(groups) and edges[1] is not None and common(edges[1], stretch[-1].item.text) >= SHARED)
            if open_ or len(stretch) > 1 and not all(g.many for g in stretch):
                stretch[0].shared = 0
                chosen += stretch
                across += [open_] * len(stretch)
            start = stop
        if chosen:
            _levels(chosen, np.array(across), out)
        columns = list(zip(*out)) or [()] * len(FOUND)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    long = docs.where(F.octet_length("text") >= LENGTH)
    return long.withColumn("text_key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def repeated_ranges(texts: DataFrame, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(text_key, ranges) of texts with repeated windows; ``texts``: text_key, text. Ranges are [first byte, end) and may overlap."""
    spark = texts.sparkSession
    prints = texts.select("text").mapInArrow(_fingerprints, "print long, n long").groupBy("print").agg(F.sum("n").alias("n"))
    prints = written(prints.where("n > 1").select("print"), "suffix-prints")
    bits = min(28, max(20, math.ceil(math.log2(16 * max(1, prints.count())))))
    runs = written(texts.select("text_key", "text").mapInArrow(_sorted_runs(bit_filter(prints, "print", bits), run_bytes), RUNS_SQL), "suffix-runs")
    chunks = runs.where("chunk IS NOT NULL")
    places = runs.where("text_key IS NOT NULL").select("run", "item", "text_key", "at")
    size = chunks.agg(F.sum("raw")).first()[0] or 0
    ranges = min(MAX_RANGES, max(1, math.ceil(size / range_bytes)))
    splitters: list[bytes] = []
    if ranges > 1:
        heads = chunks.select("head").repartitionByRange(ranges, "head").groupBy(F.spark_partition_id().alias("part")).agg(F.min("head").alias("head"))
        splitters = sorted({bytes(r["head"]) for r in heads.collect()})[1:]
    shared = spark.sparkContext.broadcast(splitters)
    cut = chunks.select("run", "item", "n", "head", "tail", "chunk").mapInArrow(_cut(shared), CUT_SQL)
    found = written(cut.groupBy("range").applyInArrow(_merge_range(shared), FOUND_SQL), "suffix-found")
    inside = found.where("digest IS NULL").select("run", "item", "near", "far")
    across = found.where("digest IS NOT NULL")
    twice = across.groupBy("digest").agg(F.sum("weight").alias("weight")).where("weight > 1").select("digest")
    across = across.where("weight = 1").join(twice, "digest").select("run", "item", "near", "far")
    spans = places.join(inside.union(across), ["run", "item"])
    spans = spans.select("text_key", (F.col("at") - F.col("far")).alias("a"), (F.col("at") - F.col("near") + LENGTH).alias("b")).distinct()
    return spans.groupBy("text_key").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _judge(batches):
    for batch in batches:
        texts, out = batch.column("text"), []
        ids, ranges = batch.column("doc_id").to_pylist(), batch.column("ranges").to_pylist()
        for i, (doc_id, spans) in enumerate(zip(ids, ranges)):
            text = texts[i].as_buffer()
            text = memoryview(text) if text is not None else memoryview(b"")
            kept, at, removed, n_spans, end = hashlib.sha256(), 0, 0, 0, -1
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                if a > end:
                    kept.update(text[at:a])
                    n_spans += 1
                    end = a
                removed += max(0, b - end)
                at = end = max(end, b)
            kept.update(text[at:])
            out.append((doc_id, len(text), removed, n_spans, kept.hexdigest()))
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT)], schema=RESULT)


def with_ranges(docs: DataFrame, **options) -> DataFrame:
    """Documents (doc_id, text) with the ranges of bytes that are to go; null where there are none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = repeated_ranges(_keyed(docs).select("text_key", "text"), **options)
    short = docs.where(F.coalesce(F.octet_length("text") < LENGTH, F.lit(True)))
    joined = _keyed(docs).join(ranges, "text_key", "left").select("doc_id", "text", "ranges")
    return joined.unionByName(short.withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType)))


def removal_report(docs: DataFrame, **options) -> DataFrame:
    sql = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return with_ranges(docs, **options).mapInArrow(_judge, sql)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, kept): the bytes that stay, as binary, since a cut may fall inside a character."""

    def cut(batches):
        for batch in batches:
            kept = []
            for text, spans in zip(batch.column("text"), batch.column("ranges").to_pylist()):
                data, at, parts = bytes(text.as_buffer() or b""), 0, []
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    parts.append(data[at:max(at, a)])
                    at = max(at, b)
                kept.append(b"".join([*parts, data[at:]]) if text.is_valid else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return with_ranges(docs, **options).mapInArrow(cut, "doc_id long, kept binary")


@query("op11_suffix_dedup")
def op11_suffix_dedup(spark, sf_dir):
    return removal_report(table(spark, sf_dir, "documents"))
