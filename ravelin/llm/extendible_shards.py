"""Sharding by extendible hashing, with built-in functions only.

A shard is a bucket of rows whose key hash starts with the same bits; the directory maps bit prefixes to shards. All rows start in one
bucket. A bucket over the byte limit splits on its next bit, others stay as they are, until every bucket fits or holds one row.

Splitting is done on sizes, not on rows: a round sums the bytes per bucket and value of the next ``STEP`` bits, adds these sums up to all
shorter prefixes, and takes for each value the shortest prefix that fits. Only rows of values that still don't fit go to the next round.
Sums are combined before they are shuffled and rows are narrow (key, bytes, hashes). The contents move once, when the shards are written: the
directory is a list of disjoint hash ranges, so a scan looks its rows' shards up, and they go to about one task per shard. A directory of
more than ``DIRECTORY_ROWS`` rows isn't broadcast; rows then meet their shard's name by row number, which is a second exchange. The query
lists what it reads back from the files.

Rows of equal keys share all bits of the key hash. When a bucket holds one hash only, splitting goes on over the bits of a second hash, of
the row's number, so one key may be any share of the rows. Such numbers are fixed once the narrow rows are written.

Shard names are the bits, with a dot before those of the second hash; the root is "". Defined results: a null key hashes as the empty
string and a null content has 0 bytes; an empty table has no shards; a row over the limit is a shard alone; repeated rows are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.registry import query, table
from ravelin.llm.storage import new_folder, written

#: Bits of a hash in use, and bits looked at in one round.
BITS, STEP = 56, 8
LIMIT_BYTES = 16 << 20
#: Bits of the cells by which a hash finds its range in the directory, and the most rows (ranges times cells) of a directory that is broadcast.
FIRST_CELLS, SECOND_CELLS = 16, 8
DIRECTORY_ROWS = 500_000
MOST_TASKS = 100_000


def hash_bits(value: Column) -> Column:
    """The first 56 bits of md5 as a long."""
    return F.conv(F.substring(F.md5(value), 1, BITS // 4), 16, 10).cast("long")


def bits_of(value: Column, width: Column) -> Column:
    return F.when(width == 0, F.lit("")).otherwise(F.lpad(F.bin(value), width, F.lit("0")))


def _round(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their shard, rows of values that need more bits); ``rows``: row, key, bytes, first, second, name, level, depth."""
    hashed = F.when(F.col("level") == 0, F.col("first")).otherwise(F.col("second"))
    rows = rows.withColumn("value", F.expr(f"shiftright(case when level = 0 then first else second end, {BITS - STEP} - depth)").bitwiseAND(F.lit((1 << STEP) - 1)))
    cells = rows.groupBy("name", "level", "depth", "value").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), (F.min(hashed) == F.max(hashed)).alias("one_hash"))
    cells = written(cells, "cells")
    prefixes = cells.withColumn("length", F.explode(F.sequence(F.lit(0), F.lit(STEP)))).withColumn("prefix", F.expr(f"shiftright(value, {STEP} - length)"))
    fits = prefixes.groupBy("name", "length", "prefix").agg(F.sum("bytes").alias("total"), F.sum("n").alias("rows")).where((F.col("total") <= limit) | (F.col("rows") == 1))
    shortest = prefixes.join(fits, ["name", "length", "prefix"]).groupBy("name", "value").agg(F.min("length").alias("length"))
    directory = cells.select("name", "value", "one_hash").join(shortest, ["name", "value"], "left")
    found = rows.join(directory, ["name", "value"])
    done = found.where("length is not null").withColumn("shard", F.concat("name", bits_of(F.expr(f"shiftright(value, {STEP} - length)"), F.col("length"))))
    used_up = (F.col("level") == 0) & (F.col("one_hash") | (F.col("depth") + STEP >= BITS))
    more = found.where("length is null").select(
        "row", "key", "bytes", "first", "second",
        F.concat("name", bits_of(F.col("value"), F.lit(STEP)), F.when(used_up, F.lit(".")).otherwise(F.lit(""))).alias("name"),
        F.when(used_up, F.lit(1)).otherwise(F.col("level")).alias("level"),
        F.when(used_up, F.lit(0)).otherwise(F.col("depth") + STEP).alias("depth"),
    )
    return done.select("row", "key", "bytes", "shard"), more


def assign_shards(docs: DataFrame, key: str = "doc_id", content: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """row, key, bytes, shard for each row; ``row`` numbers the rows of this run."""
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("bytes"),
        hash_bits(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("first"),
    )
    rows = narrow.withColumns({"second": hash_bits(F.col("row").cast("string")), "name": F.lit(""), "level": F.lit(0), "depth": F.lit(0)})
    rows, parts = written(rows, "rows"), []
    while not rows.isEmpty():
        done, more = _round(rows, limit)
        parts.append(written(done, "shards"))
        rows = written(more, "rows")
    out = parts[0] if parts else rows.select("row", "key", "bytes", F.lit("").alias("shard"))
    for part in parts[1:]:
        out = out.union(part)
    return out


def with_sizes(rows: DataFrame, key: str) -> DataFrame:
    """doc key, bytes, shard, depth (bits), shard_bytes, shard_rows; ``rows``: key, bytes, shard."""
    sizes = rows.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return rows.join(sizes, "shard").select(F.col("key").alias(key), "bytes", "shard", F.length(F.replace("shard", F.lit("."), F.lit(""))).cast("long").alias("depth"), "shard_bytes", "shard_rows")


def sharded(docs: DataFrame, key: str = "doc_id", content: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """The assignment alone, nothing written: doc key, bytes, shard, depth (bits), shard_bytes, shard_rows."""
    return with_sizes(assign_shards(docs, key, content, limit), key)


def _ranges(bits: Column, name: str, cell_bits: int) -> list[Column]:
    """Hash range [low, high) of a bit prefix, and the cells of the first ``cell_bits`` bits that it touches."""
    low = F.conv(F.rpad(bits, BITS, F.lit("0")), 2, 10).cast("long")
    high = low + F.expr(f"shiftleft(1L, cast({BITS} - length(bits_{name}) as int))")
    cell = lambda c: F.shiftright(c, BITS - cell_bits)
    return [low.alias(f"low_{name}"), high.alias(f"high_{name}"), F.sequence(cell(low), cell(high - 1)).alias(f"cells_{name}")]


def _directories(names: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The directory as hash ranges, listed per cell: prefixes of the key hash (with their shard, or null where the row number's hash goes
    on), ranges of the second hash below those, and the number of shards."""
    shards = written(names.select("shard").distinct(), "directory")
    parts = F.split("shard", r"\.")
    split = shards.select("shard", F.get(parts, 0).alias("bits_first"), F.get(parts, 1).alias("bits_second"))
    first = split.groupBy("bits_first").agg(F.min(F.when(F.col("bits_second").isNull(), F.col("shard"))).alias("shard"))
    first = first.select("bits_first", "shard", *_ranges(F.col("bits_first"), "first", FIRST_CELLS))
    first = first.select("bits_first", "shard", "low_first", "high_first", F.explode("cells_first").alias("cell_first"))
    second = split.where("bits_second is not null")
    second = second.select("bits_first", F.col("shard").alias("shard_second"), *_ranges(F.col("bits_second"), "second", SECOND_CELLS))
    second = second.select("bits_first", "shard_second", "low_second", "high_second", F.explode("cells_second").alias("cell_second"))
    return first, second, shards.count()


def _by_directory(docs: DataFrame, key: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows with their shard, looked up in the scan: the directory is broadcast, nothing is exchanged."""
    hashed = docs.drop("shard").withColumn("_row", F.monotonically_increasing_id())
    hashed = hashed.withColumns({"_first": hash_bits(F.coalesce(F.col(key).cast("string"), F.lit(""))), "_second": hash_bits(F.col("_row").cast("string"))})
    hashed = hashed.withColumns({"cell_first": F.shiftright("_first", BITS - FIRST_CELLS), "cell_second": F.shiftright("_second", BITS - SECOND_CELLS)})
    inside = lambda n: (F.col(f"_{n}") >= F.col(f"low_{n}")) & (F.col(f"_{n}") < F.col(f"high_{n}"))
    one, two = F.broadcast(first).alias("one"), F.broadcast(second).alias("two")
    met = hashed.alias("row").join(one, (F.col("row.cell_first") == F.col("one.cell_first")) & inside("first"))
    met = met.join(two, F.col("one.shard").isNull() & (F.col("one.bits_first") == F.col("two.bits_first")) & (F.col("row.cell_second") == F.col("two.cell_second")) & inside("second"), "left")
    columns = [F.col(f"row.{c}") for c in docs.drop("shard").columns]
    return met.select(*columns, F.concat(F.lit("b"), F.coalesce("one.shard", "two.shard_second")).alias("shard"))


def _by_row(docs: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """Rows with their shard, met by row number: for directories that are too large to broadcast."""
    names = names.select(F.col("row").alias("_row"), F.col("key").alias("_key"), F.concat(F.lit("b"), "shard").alias("shard"))
    rows = docs.drop("shard").withColumn("_row", F.monotonically_increasing_id())
    return rows.join(names, (rows["_row"] == names["_row"]) & F.col(key).eqNullSafe(F.col("_key"))).drop("_row", "_key")


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", content: str = "text", limit: int = LIMIT_BYTES, largest: int = DIRECTORY_ROWS) -> None:
    """Parquet folders ``shard=b<bits>`` below ``folder``, one file each. Contents cross one exchange, to about one task per shard.

    ``docs`` is read twice and must give the same rows in the same partitions, as scans of files do; otherwise this is an error.
    """
    names = assign_shards(docs, key, content, limit)
    first, second, shards = _directories(names)
    first, second = written(first, "directory-first"), written(second, "directory-second")
    small = first.count() + second.count() <= largest
    out = _by_directory(docs, key, first, second) if small else _by_row(docs, key, names)
    out.repartition(max(1, min(shards, MOST_TASKS)), "shard").write.partitionBy("shard").parquet(folder)
    if read_shards(docs, folder).count() != names.count():
        raise RuntimeError("the input changed between the two reads")


def read_shards(docs: DataFrame, folder: str) -> DataFrame:
    """The written rows with ``shard``; ``docs`` gives the columns, since an empty table has no file to tell them."""
    schema = docs.drop("shard").schema.add("shard", "string")
    return docs.sparkSession.read.schema(schema).parquet(folder).withColumn("shard", F.substring("shard", 2, BITS * 2 + 2))


def written_shards(docs: DataFrame, folder: str, key: str = "doc_id", content: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """Writes the shards and lists what the files hold: doc key, bytes, shard, depth (bits), shard_bytes, shard_rows."""
    write_shards(docs, folder, key, content, limit)
    back = read_shards(docs, folder).select(F.col(key).alias("key"), F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("bytes"), "shard")
    return with_sizes(written(back, "listed"), key)


SQL = f"""
    with r as (
        select row_number() over () as rid, doc_id, coalesce(strlen(text), 0) as bytes,
            cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, {BITS // 4}) as bigint) as h from documents
    ), p as (
        select rid, doc_id, bytes, h, d, h >> ({BITS} - d) as prefix from r, range(0, 40) t(d)
    ), s as (
        select d, prefix, sum(bytes) as total, count(*) as n from p group by d, prefix
    ), leaf as (
        select rid, any_value(doc_id) as doc_id, any_value(bytes) as bytes, any_value(h) as h, min(d) as depth
        from p join s using (d, prefix) where total <= {LIMIT_BYTES} or n = 1 group by rid
    )
    select doc_id, bytes, substr(lpad(bin(h), {BITS}, '0'), 1, cast(depth as int)) as shard, depth, cast(total as bigint) as shard_bytes, n as shard_rows
    from leaf join s on s.d = depth and s.prefix = h >> ({BITS} - depth)
"""


@query("op8_extendible_shards", SQL)
def op8_extendible_shards(spark, sf_dir):
    return written_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), new_folder(spark, "sharded"))
