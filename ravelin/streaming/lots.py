"""Lots of a file stream that are closed by the watermark, checked and published once; rows that come too late go to a side table.

Two streams read the same folder, one file after the other:

* ``publish_lots`` keeps the open lots in Spark's state store. A lot leaves it in append mode when the watermark (latest time of all
  earlier batches less the delay) has passed its end, so it is checked and written exactly once, and the state holds open lots only.
* ``route_late_rows`` writes the rows that the first stream no longer counts. It logs each batch's latest time, one row per batch, and
  derives the same watermark from the log; a batch that runs again overwrites its own log entry and its own rows.

Batches without data are off, so that batch k of either stream is file k, also after a restart: the lots that a batch could close are
closed by the next batch that has rows, and a row of batch k is late when its lot was closed before batch k.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.streaming.events import check_lot, exists, lot_stats

NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


@dataclass(frozen=True)
class LotRules:
    """Lots of ``width`` over the time column ``at`` per ``key``; ``delay`` is how long rows are waited for."""

    at: str
    width: str
    delay: str
    key: str
    low: float
    high: float


@contextmanager
def _only_data_batches(spark: SparkSession):
    before = spark.conf.get(NO_DATA_BATCHES, "true")
    spark.conf.set(NO_DATA_BATCHES, "false")
    try:
        yield
    finally:
        spark.conf.set(NO_DATA_BATCHES, before)


def _files(spark: SparkSession, folder: str, schema: T.StructType, at: str) -> DataFrame:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.withColumn(at, F.col(at).cast("timestamp"))


def _run(spark: SparkSession, stream: DataFrame, write, state: str) -> None:
    with _only_data_batches(spark):
        query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()


def publish_lots(spark: SparkSession, folder: str, schema: T.StructType, out: str, state: str, rules: LotRules) -> None:
    """Write the lots closed by each waiting file to ``out/batch=<n>``."""
    rows = _files(spark, folder, schema, rules.at).withWatermark(rules.at, rules.delay)
    lots = lot_stats(rows, rules.at, rules.width, rules.key)
    _run(spark, lots, lambda df, n: check_lot(df, rules.low, rules.high).write.mode("overwrite").parquet(f"{out}/batch={n}"), state)


def _seconds(delay: str) -> F.Column:
    return F.expr(f"interval {delay}")


def route_late_rows(spark: SparkSession, folder: str, schema: T.StructType, out: str, log: str, state: str, rules: LotRules) -> None:
    """Write each file's rows that belong to lots closed before it to ``out/batch=<n>``."""

    def route(df: DataFrame, n: int) -> None:
        # Spark's watermark has milliseconds
        latest = df.agg(F.date_trunc("millisecond", F.max(rules.at)).alias("latest"))
        latest.write.mode("overwrite").parquet(f"{log}/batch={n}")
        closed = None
        if n > 1:
            earlier = spark.read.option("basePath", log).schema("latest timestamp, batch int").parquet(log).where(F.col("batch") < n - 1)
            closed = earlier.agg((F.max("latest") - _seconds(rules.delay)).alias("closed")).first()["closed"]
        late = df.where(F.window(rules.at, rules.width)["end"] <= F.lit(closed).cast("timestamp"))
        late.write.mode("overwrite").parquet(f"{out}/batch={n}")

    _run(spark, _files(spark, folder, schema, rules.at), route, state)


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """All batches written so far, with their number in ``batch``."""
    if not exists(spark, out):
        raise FileNotFoundError(f"no batch has been written to {out}")
    return spark.read.option("basePath", out).parquet(out)


def escalations(lots: DataFrame, key: str) -> DataFrame:
    """Lots outside the band whose previous lot of the same key was outside as well; a missing lot in between ends a series.

    One row per key and lot goes in, so a key's window is as long as its history of lots.
    """
    order = Window.partitionBy(key).orderBy("lot.start")
    previous = lambda c: F.lag(c).over(order)
    outside = (F.col("published") == 0) & (previous("published") == 0) & (previous("lot.end") == F.col("lot.start"))
    return lots.withColumn("escalated", outside).where("escalated").drop("escalated")
