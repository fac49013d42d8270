"""WARC archives: written with revisit records, indexed, and read back by coalesced byte ranges.

Every record is a gzip member of its own, so a record can be read by offset and length alone. Equal payloads of at least
``REVISIT_BYTES`` are kept once, in the record of the smallest page id; the others are revisits that refer to it and carry its digest, and
the payload's length in the HTTP header they repeat.

Reading is index first: a scan of the archives writes offset, length, url, digest, type and ids of each record. Readers then choose records
on the index alone, sort them by file and offset, and fetch them in ranges: neighbours with less than ``GAP`` bytes between them are one
read of at most ``RANGE_BYTES``. Works for archives on any file system that Arrow opens, and for archives of other writers whose records
are gzip members.

The writer joins pages with the few digests that occur more than once; only the digests are grouped (minima before the shuffle). Tasks
name their files themselves and report them when whole, so files of lost attempts are never read.

Defined results: null html is an empty payload; null urls write no target header and come back null; line breaks in urls are
percent-encoded in the header; rows that repeat the smallest id of a payload are all responses; if all ids of a payload are null, all are
responses; extra columns are not written.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.registry import query, table
from ravelin.llm.storage import file_system, new_folder, written

REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
GAP, RANGE_BYTES = 64 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
INDEX = "file string, offset long, length long, page_id string, url string, digest string, record_type string, refers_to string, payload_bytes long"


def with_referrals(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    found = rows.join(firsts, "digest", "left")
    return found.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <{ID}{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, html`` as archives below ``folder``; returns the list of files (file, records, bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        out, name, records, size = None, "", 0, 0

        def report() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records]), pa.array([size])], names=["file", "records", "bytes"])

        for batch in batches:
            for row in range(len(batch)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, records, size = fs.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                data = packed(record(*(c[row].as_py() for c in batch.columns)))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    yield report()
                    out = None
        if out is not None:
            yield report()

    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    return written(with_referrals(pages).mapInArrow(write, "file string, records long, bytes long"), "archives")


class Parsed:
    """Header fields and payload of one record."""

    def __init__(self, data: bytes):
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.type = fields.get("warc-type")
        self.page_id = self._id(fields.get("warc-record-id"))
        self.refers_to = self._id(fields.get("warc-refers-to"))
        url = fields.get("warc-target-uri")
        self.url = None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        self.digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
        http, _, payload = rest[:int(fields.get("content-length", 0))].partition(b"\r\n\r\n")
        self.payload = payload
        lengths = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        self.payload_bytes = int(lengths[0]) if lengths else len(payload)

    @staticmethod
    def _id(field: str | None) -> str | None:
        return None if field is None else field.strip("<>").removeprefix(ID)


def _members(f) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of the members of an open archive, read in blocks; memory: one record and one block."""
    at, buffer, offset = 0, b"", 0
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not buffer:
                buffer = f.read(1 << 20)
                if not buffer:
                    if parts or z.unconsumed_tail:
                        raise RuntimeError("archive ends within a record")
                    return
                at += len(buffer)
            parts.append(z.decompress(buffer))
            buffer = z.unused_data
        end = at - len(buffer)
        yield offset, end - offset, b"".join(parts)
        offset = end


def build_index(files: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives in ``files`` (column file, relative to ``folder``), written as a table."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for offset, length, data in _members(f):
                        p = Parsed(data)
                        rows.append((name, offset, length, p.page_id, p.url, p.digest, p.type, p.refers_to, p.payload_bytes))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 9
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

    names = files.select("file")
    return written(names.repartition(names.sparkSession.sparkContext.defaultParallelism, "file").mapInArrow(scan, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, gap: int = GAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The chosen ``index`` rows with payload and found_digest, fetched in coalesced ranges in file order."""
    names = index.columns
    f_at, o_at, l_at = names.index("file"), names.index("offset"), names.index("length")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[tuple[pa.RecordBatch, int]]]]:
        name, start, end, rows = None, 0, 0, []
        for batch in batches:
            for row, (file, offset, length) in enumerate(zip(batch.column(f_at).to_pylist(), batch.column(o_at).to_pylist(), batch.column(l_at).to_pylist())):
                if rows and (file != name or offset - end > gap or offset + length - start > range_bytes):
                    yield name, start, end, rows
                    rows = []
                if not rows:
                    name, start = file, offset
                end = offset + length
                rows.append((batch, row))
        if rows:
            yield name, start, end, rows

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        opened, f = None, None
        for name, start, end, rows in ranges(batches):
            if name != opened:
                opened, f = name, fs.open_input_file(f"{path}/{name}")
            block = f.read_at(end - start, start)
            payloads, digests = [], []
            for batch, row in rows:
                a = batch.column(o_at)[row].as_py() - start
                p = Parsed(zlib.decompress(block[a:a + batch.column(l_at)[row].as_py()], 31))
                payloads.append(p.payload)
                digests.append(hashlib.sha256(p.payload).hexdigest() if p.type == "response" else p.digest)
            parts, at = [], 0
            while at < len(rows):
                batch, first = rows[at]
                n = 1
                while at + n < len(rows) and rows[at + n][0] is batch:
                    n += 1
                parts.append(batch.slice(first, n))
                at += n
            whole = pa.Table.from_batches(parts).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in whole.columns), pa.array(payloads, pa.binary()), pa.array(digests, pa.string())], names=[*names, "payload", "found_digest"])

    tasks = index.sparkSession.sparkContext.defaultParallelism
    ordered = index.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return ordered.mapInArrow(fetch, f"{kinds}, payload binary, found_digest string")


SQL = """
    with p as (
        select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages
    ), f as (
        select digest, min(page_id) as first, count(*) as k from p where n >= 100 group by digest
    )
    select page_id, n as payload_bytes, digest as payload_digest, case when k > 1 and page_id <> first then 'revisit' else 'response' end as record_type,
        case when k > 1 and page_id <> first then first end as refers_to
    from p left join f using (digest)
"""


@query("op1_warc_ranges", SQL)
def op1_warc_ranges(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = new_folder(spark, "warc")
    index = build_index(write_archives(pages, folder), folder)
    kind = pages.schema["page_id"].dataType
    found = read_records(index, folder)
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"), size.alias("payload_bytes"), F.col("found_digest").alias("payload_digest"), "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
