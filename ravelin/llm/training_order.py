"""Token ids written in training order as fixed-stride binary shards.

Texts become piece ids with an end mark and are cut into sequences of ``SEQUENCE`` ids (the last one of a text is padded). Sequences are
numbered in the order of the input, and a keyed Feistel permutation moves each number to a place: the network permutes the smallest power
of four that holds the numbers, and results outside their range are permuted again until they fall into it (cycle-walking), which keeps it
a permutation. The order is fixed by the key; neither a shuffle buffer nor a sort by random numbers is needed.

A text of b bytes has at most b + 2 ids, so numbers are given out by bytes, before anything is encoded, and texts are encoded once. Numbers
that no sequence takes leave gaps; a sequence's global slot is the rank of its place among those taken.

1. a scan adds up, per input partition, how many numbers its texts need at most (one sum each comes to the driver);
2. a second scan encodes, numbers, permutes, and sends each sequence to the partition of its range of places;
3. each such partition sorts its places and writes its shard, ``SEQUENCE`` little-endian 16-bit ids each, under a name of its own attempt,
   renamed when whole, so a lost or repeated task leaves no half shard;
4. the shards' numbers of sequences give each shard's first slot. Index (slot, shard, offset, document, place in the document, ids used,
   CRC) and list of shards are tables; the byte of a slot in its shard follows by arithmetic, and reading can go on at any slot.

The two scans must see the same rows in the same partitions, as scans of files do; a partition whose sum differs is an error.

Defined results: null text gives no sequence; empty text gives one with the end mark only; repeated rows and null ids are sequences of
their own; an empty table gives no shards.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm import wordhash as W
from ravelin.llm.piece_sampling import MODEL, Segments
from ravelin.llm.registry import query, table
from ravelin.llm.storage import file_system, new_folder, written
from ravelin.llm.wordhash import U64, mix

SEQUENCE = 256
PER_SHARD = 1 << 15
BYTES_PER_ID = 3
END, PAD = 2, 0
KEY = 0x5EED
ROUNDS = 4
#: Bytes of text encoded at a time, and segments whose ids a worker keeps.
SLICE_BYTES = 1 << 20
KNOWN_SEGMENTS = 200_000


def permuted(numbers: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Slot of each number in 0..n-1: a keyed bijection of that range."""
    half = U64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (U64(1) << half) - U64(1)
    keys = mix(np.arange(1, rounds + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key))
    out = numbers.astype(U64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> half, out[open_] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[open_] = (left << half) | right
        open_ = open_[out[open_] >= U64(n)]
    return out.astype(np.int64)


class Encoder:
    """Ids of texts from the ids of their segments, which no piece crosses; frequent segments are encoded once per worker process."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError("a piece has a blank after another character")
        self.blank = np.array([self.model.piece_to_id("\u2581")], "<u2").tobytes()
        self.known: dict[int, bytes] = {}

    def segments(self, hashes: list[int], texts: list[bytes]) -> list[bytes]:
        """Ids as 16-bit words; every text starts with the blank that the encoder puts in front itself."""
        known = self.known
        out = [known.get(h) for h in hashes]
        missing = [i for i, x in enumerate(out) if x is None]
        found = self.model.encode([texts[i][1:].decode("utf-8", "replace") for i in missing], num_threads=1)
        for i, ids in zip(missing, found):
            out[i] = array("H", ids).tobytes() if texts[i] != b" " else self.blank
        # frequent segments come early; when the table is full, others are encoded again each time
        for i in missing[:max(0, KNOWN_SEGMENTS - len(known))]:
            known[hashes[i]] = out[i]
        return out

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, ids with end marks one after another, their number per row) of the rows with text."""
        present = column.is_valid().to_numpy(zero_copy_only=False)
        for start, stop, data, offsets in W.text_slices(column, SLICE_BYTES):
            s = Segments(data, offsets)
            raw, limits = s.distinct.tobytes(), s.limits.tolist()
            parts = self.segments(s.hashes.tolist(), [raw[a:b] for a, b in zip(limits[:-1], limits[1:])])
            sizes = np.array([len(x) // 2 for x in parts])
            flat = np.frombuffer(b"".join(parts), "<u2")
            each = sizes[s.kind]
            # the dummy blank alone, before an empty text, gives no ids
            empty = np.diff(offsets) == 0
            each[empty[s.row]] = 0
            rows = np.flatnonzero(present[start:stop])
            rank = np.cumsum(present[start:stop]) - 1
            counts = np.bincount(s.row, weights=each, minlength=stop - start).astype(np.int64)[rows] + 1
            ids = np.full(int(counts.sum()), END, np.uint16)
            ends = np.cumsum(each)
            values = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[s.kind] - (ends - each), each)]
            ids[np.arange(len(values)) + np.repeat(rank[s.row], each)] = values
            yield rows + start, ids, counts


@lru_cache(maxsize=2)
def encoder_of(model: bytes) -> Encoder:
    """Built once per worker process."""
    return Encoder(model)


def write_training_order(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, key: int = KEY, sequence: int = SEQUENCE, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards, the list ``shards`` and ``order.json`` below ``folder``; returns the index, a row per sequence.

    ``per_shard``: sequences of a shard, roughly (a text has some ``BYTES_PER_ID`` bytes for each id).
    """
    spark = docs.sparkSession
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    most = F.floor((F.octet_length("text") + 1 + sequence) / sequence)
    sums = rows.where("text is not null").groupBy(F.spark_partition_id().alias("part")).agg(F.sum(most).alias("n")).collect()
    bases, n = {}, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        bases[r["part"]] = (n, n + r["n"])
        n += r["n"]
    width = per_shard * BYTES_PER_ID
    plan = spark.sparkContext.broadcast(bases)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        number, last = plan.value.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for which, ids, counts in encoder.encode(batch.column(1)):
                needed = (lengths[which] + 1 + sequence) // sequence
                each = -(-counts // sequence)
                if (each > needed).any():
                    raise RuntimeError("a text has more ids than bytes")
                total = int(each.sum())
                within = np.arange(total) - np.repeat(np.cumsum(each) - each, each)
                places = permuted(np.repeat(number + np.cumsum(needed) - needed, each) + within, n, key)
                number += int(needed.sum())
                used = np.minimum(np.repeat(counts, each) - within * sequence, sequence)
                data = np.full(total * sequence, PAD, "<u2")
                start = np.cumsum(each) - each
                data[np.arange(len(ids)) + np.repeat(start * sequence - (np.cumsum(counts) - counts), counts)] = ids
                column = pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer((np.arange(total + 1) * 2 * sequence).astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places), pa.array((places // width).astype(np.int32)), batch.column(0).take(pa.array(np.repeat(which, each))), pa.array(within), pa.array(used.astype(np.int32)), column],
                    names=["place", "shard", "doc_id", "seq", "n_ids", "data"],
                )
        if number != last:
            raise RuntimeError("the input changed between the two scans")

    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"place long, shard int, doc_id {kind}, seq long, n_ids int, data binary")
    ranges = placed.repartitionById(max(1, -(-n // width)), F.col("shard")).sortWithinPartitions("place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        out, shard, temporary, held = None, -1, "", 0
        for batch in batches:
            numbers = batch.column(1).to_numpy()
            for a in np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]).tolist():
                if numbers[a] != shard:
                    if out is not None:
                        out.close()
                        fs.move(temporary, shard_path(path, shard))
                    shard, held = int(numbers[a]), 0
                    temporary = f"{path}/attempt-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary)
                part = batch.filter(pa.array(numbers == shard))
                buffers = part.column(5).buffers()
                first = np.frombuffer(buffers[1], np.int32)[part.column(5).offset:]
                block = memoryview(buffers[2])[int(first[0]):int(first[len(part)])]
                out.write(block)
                crc = [zlib.crc32(block[i:i + 2 * sequence]) for i in range(0, len(block), 2 * sequence)]
                at = pa.array(np.arange(held, held + len(part)))
                held += len(part)
                yield pa.RecordBatch.from_arrays([part.column(1), at, *part.columns[2:5], pa.array(crc, pa.int64())], names=["shard", "at", "doc_id", "seq", "n_ids", "crc"])
        if out is not None:
            out.close()
            fs.move(temporary, shard_path(path, shard))

    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    found = written(ranges.mapInArrow(write, f"shard int, at long, doc_id {kind}, seq long, n_ids int, crc long"), "order-index")
    sizes = found.groupBy("shard").agg(F.count("*").alias("n"))
    # one row per shard
    firsts = sizes.withColumn("first", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    firsts.withColumn("first", F.coalesce("first", F.lit(0))).write.parquet(f"{folder}/shards")
    with fs.open_output_stream(f"{path}/order.json") as f:
        f.write(json.dumps({"sequence": sequence, "key": key, "numbers": n}).encode())
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "first")
    return found.join(shards, "shard").select((F.col("first") + F.col("at")).alias("slot"), "shard", (F.col("at") * 2 * sequence).alias("offset"), "doc_id", "seq", "n_ids", "crc")


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.u16"


def read_training_order(spark: SparkSession, folder: str, first: int = 0, last: int | None = None) -> DataFrame:
    """slot, shard, ids (bytes), crc of the slots ``first`` up to ``last`` (exclusive; default: all), each shard read from front to back."""
    fs, path = file_system(folder)
    with fs.open_input_stream(f"{path}/order.json") as f:
        stride = 2 * json.loads(f.read())["sequence"]
    end = F.col("first") + F.col("n")
    stop = end if last is None else F.least(end, F.lit(last))
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "first", F.greatest("first", F.lit(first)).alias("a"), stop.alias("b")).where("a < b")
    shards = shards.repartition(spark.sparkContext.defaultParallelism, "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        for batch in batches:
            for shard, start, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(shard_path(path, shard)) as f:
                    f.seek((a - start) * stride)
                    for at in range(a, b, 4096):
                        n = min(4096, b - at)
                        block = f.read(n * stride)
                        if len(block) != n * stride:
                            raise RuntimeError(f"shard {shard} is short")
                        view = memoryview(block)
                        data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * stride).astype(np.int32)), pa.py_buffer(block)])
                        crc = [zlib.crc32(view[i * stride:(i + 1) * stride]) for i in range(n)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.array([shard] * n, pa.int32()), data, pa.array(crc, pa.int64())], names=["slot", "shard", "ids", "crc"])

    return shards.mapInArrow(read, "slot long, shard int, ids binary, crc long")


@query("op4_training_order")
def op4_training_order(spark, sf_dir):
    """Writes the shards, reads them back in slot order, and gives each sequence's place and whether its bytes are those written."""
    folder = new_folder(spark, "training-order")
    index = write_training_order(table(spark, sf_dir, "documents"), folder)
    back = read_training_order(spark, folder).select("slot", F.col("crc").alias("read_crc"))
    # the planner takes what the shards give for as small as the list of shards, and would broadcast it
    return index.join(back.hint("merge"), "slot", "left").select("slot", "shard", "offset", "doc_id", "seq", "n_ids", "crc", F.coalesce(F.col("crc") == F.col("read_crc"), F.lit(False)).alias("intact"))
