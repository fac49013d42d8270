"""SentencePiece encoding by sampling distinct segmentations, and decoding.

A text is a lattice: places between characters, and an edge for each vocabulary piece that fits. Every path spells the text. A path has the
probability of its pieces (Zipf's law over the vocabulary's order, as merge-trained vocabularies carry ranks and no probabilities),
normalised over all paths by backward sums. Texts are drawn without replacement by the Gumbel top-k trick:

* the root has a Gumbel value; a node's value is the maximum over the paths below it, so one child of every node inherits its value, chosen
  with the child's probability, and all other children together have a smaller value, drawn from a truncated Gumbel;
* best-first (A-star) search with these values as exact bounds: follow the inherited value to a whole path, keep the other children of every
  node passed as one open entry with its bound, take the open entry with the largest bound, branch there, and so on. Whole paths come out
  in falling order of their values: that is sampling distinct paths without replacement;
* the next bound is the threshold of the inclusion scores: ``1 - exp(-exp(log_prob - threshold))``.

Random numbers are hashes of (row key, sample, place), so a row's samples depend on its key and text only, not on partitions or retries.

Pieces never have a blank after another character, so the lattice falls into segments (blanks, then other characters). Lattices are built
once per distinct segment of a slice of rows, with array steps; segments join at blanks, where all paths meet.

Defined results: null text has no samples; an empty text has one, of the pieces of the dummy blank alone; a text with fewer than k
segmentations has all of them, and the last inclusion score is 1 (log 0). Rows with equal keys and texts get equal samples. Extra columns
stay; ``samples`` replaces a column of that name.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm import wordhash as W
from ravelin.llm.registry import query, table

MODEL = os.environ.get("RAVELIN_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SAMPLES = 2
#: Arrays of a slice take some 400 bytes per byte of text.
SLICE_BYTES = 256 << 10
#: Zipf's law: probability of the piece of rank r is proportional to 1 / (r + SHIFT).
SHIFT = 10
BLANK = 32
SAMPLE_TYPE = "array<struct<ids:array<int>,log_prob:double,log_inclusion:double>>"


class Vocabulary:
    """Pieces as bytes (the blank sign is a blank), their log weights, byte pieces, and a hashed trie over them."""

    def __init__(self, model_bytes: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        self.pieces: list[bytes] = [b""] * model.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int64)
        normal = []
        for i in range(len(self.pieces)):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(name[1:-1], 16)] = i
                self.pieces[i] = bytes([int(name[1:-1], 16)])
            else:
                self.pieces[i] = name.replace("▁", " ").encode()
                normal.append(i)
        if any(b" " in self.pieces[i].lstrip(b" ") for i in normal):
            raise ValueError("a piece has a blank after another character")
        ranks = np.arange(1, len(normal) + 257)
        logs = -np.log(ranks + SHIFT) - np.log(np.sum(1.0 / (ranks + SHIFT)))
        self.weights = np.zeros(len(self.pieces))
        self.weights[normal] = logs[:len(normal)]
        self.weights[self.byte_ids[self.byte_ids >= 0]] = logs[-1]
        self.piece_sizes = np.array([len(p) for p in self.pieces])
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self._trie(normal)

    def _trie(self, normal: list[int]) -> None:
        """Nodes in breadth-first order; transitions (node * 256 + byte) -> node in an open-addressing table."""
        nodes, ends, keys, targets = {b"": 0}, [-1], [], []
        for piece_id in sorted(normal, key=lambda i: len(self.pieces[i])):
            piece = self.pieces[piece_id]
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(ends)
                    keys.append(nodes[piece[:n - 1]] * 256 + piece[n - 1])
                    targets.append(len(ends))
                    ends.append(-1)
            ends[nodes[piece]] = piece_id
        self.ends = np.array(ends, np.int32)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint32(32 - bits)
        self.keys, self.targets = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.int32)
        self.probes = 0
        for key, target in zip(keys, targets):
            slot, probe = int(self._slot(np.array([key], np.int32))[0]), 1
            while self.keys[slot] >= 0:
                slot, probe = (slot + 1) & (len(self.keys) - 1), probe + 1
            self.keys[slot], self.targets[slot] = key, target
            self.probes = max(self.probes, probe)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint32) * np.uint32(2654435761)) >> self.shift

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next trie node, -1 where none."""
        key = node * np.int32(256) + byte
        slot = self._slot(key)
        have = self.keys[slot]
        out = np.where(have == key, self.targets[slot], np.int32(-1))
        open_ = np.flatnonzero((have != key) & (have >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + np.uint32(1)) & np.uint32(len(self.keys) - 1)
            have = self.keys[slot[open_]]
            hit = have == key[open_]
            out[open_[hit]] = self.targets[slot[open_[hit]]]
            open_ = open_[~hit & (have >= 0)]
        return out


@lru_cache(maxsize=2)
def vocabulary_of(model_bytes: bytes) -> Vocabulary:
    """Built once per worker process."""
    return Vocabulary(model_bytes)


@dataclass
class Lattice:
    """Edges of all distinct segments, grouped by their first byte: ids (byte fallback: -1), end, probability, log probability."""

    start: np.ndarray  # per edge
    end: np.ndarray
    ids: np.ndarray
    prob: np.ndarray
    logp: np.ndarray
    upto: np.ndarray  # probability of the node's edges up to this one
    low: np.ndarray  # first edge and edge after the last per byte place
    high: np.ndarray


def build_lattice(vocabulary: Vocabulary, data: np.ndarray, limits: np.ndarray) -> Lattice:
    """``data``: bytes of the distinct segments one after another; ``limits``: their bounds."""
    n = len(data)
    seg_end = np.repeat(limits[1:], np.diff(limits))
    continuing = (data & 0xC0) == 0x80
    starts, lengths, ids = [], [], []
    at = np.flatnonzero(~continuing)
    nexts = np.append(at[1:], n)
    width = np.zeros(n, np.int64)
    width[at] = nexts - at
    covered = np.zeros(n, bool)
    edges_at = np.zeros(n, np.int64)
    node = np.zeros(len(at), np.int32)
    wide = data.astype(np.int32)
    length = 0
    places = at
    while len(places):
        node = vocabulary.step(node, wide[places + length])
        alive = node >= 0
        places, node = places[alive], node[alive]
        length += 1
        piece = vocabulary.ends[node]
        full = piece >= 0
        begun = places[full]
        starts.append(begun)
        lengths.append(length)
        ids.append(piece[full])
        edges_at[begun] += 1
        covered[begun[width[begun] == length]] = True
        more = places + length < seg_end[places]
        places, node = places[more], node[more]
    # a character without a piece of its own is spelt in bytes
    spelt = at[~covered[at]]
    edges_at[spelt] += 1
    # by distance from the end, place, and longest piece first: long pieces are likely, so a draw looks at few edges
    nodes = at[np.argsort(seg_end[at] - at, kind="stable")]
    upto_node = np.concatenate([[0], np.cumsum(edges_at[nodes])])
    slot = np.zeros(n, np.int64)
    slot[nodes] = upto_node[:-1]
    start = np.repeat(nodes, edges_at[nodes])
    end, piece = np.empty(len(start), np.int64), np.empty(len(start), np.int32)
    for begun, length, named in zip(reversed(starts), reversed(lengths), reversed(ids)):
        where = slot[begun]
        end[where], piece[where] = begun + length, named
        slot[begun] += 1
    end[slot[spelt]], piece[slot[spelt]] = spelt + width[spelt], -1
    away = seg_end[start] - start
    weight = np.where(piece >= 0, vocabulary.weights[piece], vocabulary.weights[vocabulary.byte_ids[0]] * (end - start)) if n else np.zeros(0)
    low = np.flatnonzero(np.r_[True, start[1:] != start[:-1]]) if len(start) else np.zeros(0, np.int64)
    high = np.append(low[1:], len(start))
    below = np.zeros(n + 1)
    # places by distance from their segment's end: sums below are ready when they are needed
    node_away = away[low]
    rounds = np.flatnonzero(np.r_[True, node_away[1:] != node_away[:-1]]) if len(low) else np.zeros(0, np.int64)
    target = np.where(end == seg_end[start], n, end) if n else end
    logp = weight
    for a, b in zip(rounds, np.append(rounds[1:], len(low))):
        i, j = low[a], high[b - 1]
        logp[i:j] += below[target[i:j]]
        value = logp[i:j]
        first = low[a:b] - i
        top = np.maximum.reduceat(value, first)
        total = np.add.reduceat(np.exp(value - np.repeat(top, high[a:b] - low[a:b])), first)
        below[start[low[a:b]]] = top + np.log(total)
    logp -= below[start]
    prob = np.exp(logp)
    # running sums node by node, so that they don't depend on what else is in the slice
    upto = prob.copy()
    more = low[high - low > 1] + 1
    last = high[high - low > 1]
    while len(more):
        upto[more] += upto[more - 1]
        more += 1
        more, last = more[more < last], last[more < last]
    upto[high - 1] = 1.0
    first, last = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    first[start[low]], last[start[low]] = low, high
    return Lattice(start, end, piece, prob, logp, upto, first, last)


def uniforms(seeds: np.ndarray, sample: int, places: np.ndarray, use: int) -> np.ndarray:
    """Numbers in (0, 1) fixed by row seed, sample, byte place and use."""
    x = W.mix(seeds + places.astype(W.U64) * W.U64(0x9E3779B97F4A7C15) + W.U64(sample * 8 + use))
    return ((x >> W.U64(12)).astype(np.float64) + 0.5) * 2.0**-52


def truncated(place: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at ``place`` (log mass) below ``bound``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        value = place - np.log(np.exp(place - bound) - np.log(u))
    return np.where(np.isneginf(place), -np.inf, value)


class Segments:
    """The rows of a slice as occurrences of distinct segments: blanks, then other characters. Every row gets the dummy blank in front."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        self.offsets = offsets + np.arange(rows + 1)
        text = np.full(len(data) + rows, BLANK, np.uint8)
        text[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets)) + 1] = data
        begins = text == BLANK
        begins[1:] &= text[:-1] != BLANK
        begins[self.offsets[:-1]] = True
        self.at = np.flatnonzero(begins)
        stop = np.append(self.at[1:], len(text))
        self.row = np.searchsorted(self.offsets, self.at, "right") - 1
        self.first = np.searchsorted(self.at, self.offsets)
        sums = np.zeros(len(text) + 1, W.U64)
        np.cumsum(W.BYTE_VALUES[text] * W.powers(W.BASE, len(text)), out=sums[1:])
        hashes = W.mix((sums[stop] - sums[self.at]) * W.powers(W.BASE_INVERSE, len(text))[self.at])
        self.hashes, which, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        sizes = (stop - self.at)[which]
        self.limits = np.concatenate([[0], np.cumsum(sizes)])
        self.distinct = text[np.arange(self.limits[-1]) + np.repeat(self.at[which] - self.limits[:-1], sizes)]


class Slice(Segments):
    """Segments with their lattices and the rows' seeds."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
        super().__init__(data, offsets)
        self.lattice = build_lattice(vocabulary, self.distinct, self.limits)
        self.seeds = seeds
        self.vocabulary = vocabulary

    def follow(self, occurrence: np.ndarray, cursor: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges of drawn paths from ``cursor`` (place in the distinct bytes) to the end of each occurrence's segment, and their number."""
        lat = self.lattice
        stop = self.limits[self.kind[occurrence] + 1]
        lanes = np.flatnonzero(cursor < stop)
        cursor = cursor.copy()
        edges, owners = [], []
        seed, base = self.seeds[self.row[occurrence]], self.at[occurrence] - self.offsets[self.row[occurrence]] - self.limits[self.kind[occurrence]]
        while len(lanes):
            here = cursor[lanes]
            u = uniforms(seed[lanes], sample, base[lanes] + here, 0)
            edge = lat.low[here]
            above = np.flatnonzero(u >= lat.upto[edge])
            while len(above):
                edge[above] += 1
                above = above[u[above] >= lat.upto[edge[above]]]
            edges.append(edge)
            owners.append(lanes)
            cursor[lanes] = lat.end[edge]
            lanes = lanes[lat.end[edge] < stop[lanes]]
        if not edges:
            return np.zeros(0, np.int64), np.zeros(len(occurrence), np.int64)
        counts = np.bincount(np.concatenate(owners), minlength=len(occurrence))
        base_at = np.concatenate([[0], np.cumsum(counts)])[:-1]
        out = np.empty(int(counts.sum()), np.int64)
        for step, (edge, owner) in enumerate(zip(edges, owners)):
            out[base_at[owner] + step] = edge
        return out, counts


class Path:
    """One path of a row: edges, the occurrence of each, log probability before each, and the open entries beside the first ones.

    The entry of a node is at most the log probability before it plus MOST, so entries after ``before`` has fallen by FAR are made only if
    the best entry of the row is below FAR's reach.
    """

    __slots__ = ("edges", "owners", "before", "open", "log_prob", "bound", "sample", "taken")

    def __init__(self, edges, owners, before, open_, log_prob, bound, sample):
        self.edges, self.owners, self.before, self.open, self.log_prob, self.bound, self.sample = edges, owners, before, open_, log_prob, bound, sample
        self.taken: dict[int, list[int]] = {}

    def complete(self, s: Slice, row: int) -> None:
        done = len(self.open)
        if done < len(self.edges):
            rest = slice(done, None)
            n = len(self.edges) - done
            more = _open_entries(s, self.edges[rest], self.owners[rest], self.before[rest], np.full(n, self.bound), np.full(n, row), self.sample)
            self.open = np.concatenate([self.open, more])


FAR, MOST = 60.0, 40.0


def _open_entries(s: Slice, edges: np.ndarray, owners: np.ndarray, before: np.ndarray, bounds: np.ndarray, rows: np.ndarray, sample: int) -> np.ndarray:
    """Bounds of all other children at nodes of paths; ``bounds`` and ``rows`` per edge."""
    lat = s.lattice
    with np.errstate(divide="ignore"):
        rest = np.log1p(-np.minimum(lat.prob[edges], 1.0))
    start = lat.start[edges]
    place = np.where(lat.high[start] - lat.low[start] == 1, -np.inf, before + rest)
    where = s.at[owners] - s.offsets[rows] + start - s.limits[s.kind[owners]]
    return truncated(place, bounds, uniforms(s.seeds[rows], sample, where, 1))


def _before(logs: np.ndarray) -> np.ndarray:
    """Sum of the earlier values at each place."""
    return np.concatenate([[0.0], np.cumsum(logs[:-1])]) if len(logs) else logs


def _best(paths: list[Path]) -> tuple[float, Path | None, int]:
    best, owner, where = -np.inf, None, -1
    for p in paths:
        if len(p.open):
            i = int(p.open.argmax())
            if p.open[i] > best:
                best, owner, where = float(p.open[i]), p, i
    return best, owner, where


def sample_slice(s: Slice, k: int) -> tuple[list[list[Path]], np.ndarray]:
    """Up to ``k`` distinct paths of each row, in falling order of their Gumbel values, and the rows' thresholds (the next value)."""
    rows, lat = len(s.offsets) - 1, s.lattice
    occurrences = np.arange(len(s.at))
    edges, counts = s.follow(occurrences, s.limits[s.kind], 1)
    owners = np.repeat(occurrences, counts)
    row = s.row[owners]
    bounds = np.searchsorted(row, np.arange(rows + 1))
    before = np.concatenate([_before(lat.logp[edges[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])] or [np.zeros(0)])
    root = -np.log(-np.log(uniforms(s.seeds, 0, np.zeros(rows, np.int64), 2)))
    near = np.flatnonzero(before >= -FAR)
    open_ = _open_entries(s, edges[near], owners[near], before[near], root[row[near]], row[near], 1)
    limits = np.searchsorted(row[near], np.arange(rows + 1))
    found = []
    for r in range(rows):
        a, b = bounds[r], bounds[r + 1]
        found.append([Path(edges[a:b], owners[a:b], before[a:b], open_[limits[r]:limits[r + 1]], before[b - 1] + lat.logp[edges[b - 1]], root[r], 1)])
    thresholds = np.full(rows, -np.inf)
    for sample in range(2, k + 2):
        branched = []
        for r, paths in enumerate(found):
            if len(paths) < sample - 1:
                continue
            best, path, i = _best(paths)
            if best < MOST - FAR:
                for p in paths:
                    p.complete(s, r)
                best, path, i = _best(paths)
            thresholds[r] = best
            if path is not None and sample <= k:
                branched.append((r, path, i, best))
        if branched:
            _branch(s, branched, found, sample)
    return found, thresholds


def _branch(s: Slice, branched: list, found: list[list[Path]], sample: int) -> None:
    """New paths that leave an open entry each: another child there, then drawn to the end of the row."""
    lat = s.lattice
    cursors, lanes, heads = [], [], []
    for r, path, i, bound in branched:
        edge, owner = int(path.edges[i]), int(path.owners[i])
        start = int(lat.start[edge])
        low, high = int(lat.low[start]), int(lat.high[start])
        taken = path.taken.setdefault(i, [edge])
        weights = lat.prob[low:high].copy()
        weights[np.array(taken) - low] = 0
        place = int(s.at[owner] - s.offsets[r] + start - s.limits[s.kind[owner]])
        seed, spot = s.seeds[r:r + 1], np.array([place])
        drawn = np.cumsum(weights)
        pick = int(np.searchsorted(drawn, float(uniforms(seed, sample, spot, 3)[0]) * drawn[-1], "right"))
        pick = min(pick, int(np.flatnonzero(weights)[-1]))
        taken.append(low + pick)
        weights[pick] = 0
        rest = weights.sum()
        left = len(taken) < high - low and rest > 0
        path.open = path.open.copy()
        path.open[i] = truncated(np.array([path.before[i] + np.log(rest)]), np.array([bound]), uniforms(seed, sample, spot, 1))[0] if left else -np.inf
        following = np.arange(owner, s.first[r + 1])
        cursor = s.limits[s.kind[following]]
        cursor[0] = lat.end[low + pick]
        lanes.append(following)
        cursors.append(cursor)
        heads.append((low + pick, owner))
    occurrence = np.concatenate(lanes)
    edges, counts = s.follow(occurrence, np.concatenate(cursors), sample)
    owners = np.repeat(occurrence, counts)
    ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(x) for x in lanes])].tolist()
    made, a = [], 0
    for (r, path, i, bound), (child, owner), b in zip(branched, heads, ends):
        base = path.before[i] + lat.logp[child]
        before = base + _before(lat.logp[edges[a:b]])
        log_prob = before[-1] + lat.logp[edges[b - 1]] if b > a else base
        near = int(np.searchsorted(-before, FAR, "right"))
        made.append((r, path, i, bound, child, owner, a, b, before, log_prob, near))
        a = b
    # entries of the new parts; those before and at the branch stay with the path that owns them
    spots = np.concatenate([np.arange(m[6], m[6] + m[10]) for m in made])
    sizes = [m[10] for m in made]
    values = np.concatenate([m[8][:m[10]] for m in made])
    open_ = _open_entries(s, edges[spots], owners[spots], values, np.repeat([m[3] for m in made], sizes), np.repeat([m[0] for m in made], sizes), sample)
    at = 0
    for r, path, i, bound, child, owner, a, b, before, log_prob, near in made:
        own = np.concatenate([np.full(i + 1, -np.inf), open_[at:at + near]])
        at += near
        found[r].append(Path(
            np.concatenate([path.edges[:i], [child], edges[a:b]]), np.concatenate([path.owners[:i], [owner], owners[a:b]]),
            np.concatenate([path.before[:i + 1], before]), own, log_prob, bound, sample,
        ))


def piece_ids(s: Slice, paths: list[Path]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of paths one after another, and their number per path; a character spelt in bytes gives one id per byte."""
    if not paths:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    edges = np.concatenate([p.edges for p in paths])
    ends = np.cumsum([len(p.edges) for p in paths])
    ids = s.lattice.ids[edges]
    spelt = np.flatnonzero(ids < 0)
    start = s.lattice.start[edges[spelt]]
    size = s.lattice.end[edges[spelt]] - start
    total = np.ones(len(ids), np.int64)
    total[spelt] = size
    first = np.cumsum(total) - total
    out = np.repeat(ids, total) if len(spelt) and size.max() > 1 else ids.copy()
    if len(spelt):
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(first[spelt], size) + within] = s.vocabulary.byte_ids[s.distinct[np.repeat(start, size) + within]]
    upto = np.concatenate([[0], np.cumsum(total)])[ends]
    return out.astype(np.int32), np.diff(np.concatenate([[0], upto]))


def log_inclusion(log_prob: float, threshold: float) -> float:
    if np.isneginf(threshold):
        return 0.0
    x = log_prob - threshold
    return float(x if x < -30 else np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def spelled(vocabulary: Vocabulary, lists: pa.ListArray) -> list[bytes]:
    """Bytes of lists of piece ids, joined on arrays; nothing for null."""
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.pieces)):
        raise IndexError("a piece id outside the vocabulary")
    sizes = vocabulary.piece_sizes[ids]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    data = vocabulary.piece_bytes[np.repeat(vocabulary.piece_starts[ids] - upto[:-1], sizes) + np.arange(upto[-1])].tobytes()
    each = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    bounds = upto[np.concatenate([[0], np.cumsum(each)])].tolist()
    return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").removeprefix(" ")


def decoded(vocabulary: Vocabulary, lists: pa.ListArray) -> pa.Array:
    """Texts of lists of piece ids."""
    there = lists.is_valid().to_pylist()
    return pa.array([_text(raw) if t else None for raw, t in zip(spelled(vocabulary, lists), there)], pa.string())


def round_trips(vocabulary: Vocabulary, lists: pa.ListArray, texts: list[bytes]) -> pa.StructArray:
    """SHA-256 of the text each list decodes to, and whether it is the given one; a text found again in a row is hashed once."""
    hashes, same, hashed, last = [], [], None, ""
    for raw, text in zip(spelled(vocabulary, lists), texts, strict=True):
        whole = raw == b" " + text
        back = text if whole else _text(raw).encode()
        if back != hashed:
            hashed, last = back, hashlib.sha256(back).hexdigest()
        hashes.append(last)
        same.append(whole or back == text)
    return pa.StructArray.from_arrays([pa.array(hashes, pa.string()), pa.array(same, pa.bool_())], names=["sha256", "same"])


def sample_pieces(docs: DataFrame, key: Column, text: str = "text", k: int = SAMPLES, model: str = MODEL, keep_text: bool = True, decode: bool = False) -> DataFrame:
    """``docs`` (without its text, if not ``keep_text``) with ``samples``: up to ``k`` (ids, log_prob, log_inclusion).

    With ``decode``, the ids of every sample are decoded too; ``decoded`` lists the (sha256, same) of their texts, as ``round_trips`` gives them.

    ``model``: path of the vocabulary on the driver; its bytes (a few hundred KB) are broadcast.
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    given = docs.drop("samples", *["decoded"] * decode).withColumn("_seed", F.xxhash64(key))
    names = given.columns
    at, seed = names.index(text), names.index("_seed")
    own = [i for i, c in enumerate(names) if i != seed and (keep_text or i != at)]
    arrow_type = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("log_inclusion", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(shared.value)
        for batch in batches:
            for start, stop, data, offsets in W.text_slices(batch.column(at), SLICE_BYTES):
                part = batch.slice(start, stop - start)
                present = part.column(at).is_valid().to_numpy(zero_copy_only=False)
                s = Slice(vocabulary, data, offsets, W.mix(part.column(seed).to_numpy().view(np.uint64)))
                found, thresholds = sample_slice(s, k)
                found = [paths if there else [] for paths, there in zip(found, present)]
                number = [len(paths) for paths in found]
                scores = [(p.log_prob, log_inclusion(p.log_prob, t)) for paths, t in zip(found, thresholds) for p in paths]
                flat, sizes = piece_ids(s, [p for paths in found for p in paths])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat))
                both = np.array(scores).reshape(-1, 2)
                structs = pa.StructArray.from_arrays([lists, pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], fields=list(arrow_type.value_type))
                bounds = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
                made = {"samples": pa.ListArray.from_arrays(bounds, structs)}
                if decode:
                    texts = [data[offsets[r]:offsets[r + 1]].tobytes() for r in np.repeat(np.arange(stop - start), number).tolist()]
                    made["decoded"] = pa.ListArray.from_arrays(bounds, round_trips(vocabulary, lists, texts))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in own), *made.values()], names=[*(names[i] for i in own), *made])

    kinds = "".join(f"`{names[i]}` {given.schema[i].dataType.simpleString()}, " for i in own)
    return given.mapInArrow(scan, f"{kinds}samples {SAMPLE_TYPE}" + ", decoded array<struct<sha256:string,same:boolean>>" * decode)


def decode_pieces(df: DataFrame, ids: str | Column, out: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with the text of a list of piece ids; null for null, an id outside the vocabulary is an error."""
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield decoded(vocabulary_of(shared.value), column)

    return df.withColumn(out, decode(ids))


@query("op9_piece_sampling")
def op9_piece_sampling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sample_pieces(docs, F.col("doc_id"), keep_text=False, decode=True)
    return found.select("doc_id", F.posexplode_outer(F.arrays_zip("samples", "decoded")).alias("sample", "s")).select(
        "doc_id", "sample", F.size("s.samples.ids").cast("long").alias("n_pieces"), F.col("s.samples.ids").alias("ids"), "s.samples.log_prob", "s.samples.log_inclusion",
        F.col("s.decoded.sha256").alias("decoded_sha256"), F.col("s.decoded.same").alias("round_trip"),
    )
