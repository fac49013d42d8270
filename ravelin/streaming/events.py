"""Incremental corpus and batch monitoring on Structured Streaming, each with a batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.text import fingerprint
from ravelin.operators import corpus
from ravelin.session import cut_lineage

Step = Callable[[DataFrame], DataFrame]


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def event_as_of(day: Column, override: str | None = None) -> Column:
    """As-of date of a batch: the caller's, else the latest event date."""
    latest = F.max(F.date_format(day, "yyyy-MM-dd"))
    return F.coalesce(F.lit(override).cast("string"), latest)


class CorpusStore:
    """Passages, pairs, snapshots and diffs of a corpus, one folder per version.

    A version is written under its batch number, so a batch that runs again after a failure
    overwrites its own folder and nothing else. Earlier versions are never touched.
    """

    def __init__(self, spark: SparkSession, root: str, mark: Step, strongest: Step, judge: Step):
        self.spark, self.root = spark, root
        self.mark, self.strongest, self.judge = mark, strongest, judge

    def path(self, kind: str, version: int) -> str:
        return f"{self.root}/{kind}/version={version}"

    def read(self, kind: str, version: int) -> DataFrame:
        return self.spark.read.parquet(self.path(kind, version))

    def _write(self, df: DataFrame, kind: str, version: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(kind, version))
        return self.read(kind, version)

    def on_event(self, batch: DataFrame, version: int) -> None:
        """New passages in, copies marked again over old and new, only new pairs judged, new snapshot and diff out."""
        if batch.isEmpty():
            return
        earlier = [v for v in range(version) if exists(self.spark, self.path("passages", v))]
        parts = [self.read("passages", v) for v in earlier]
        self._write(batch, "passages", version)
        everything = self.read("passages", version)
        for part in parts:
            everything = everything.unionByName(part)
        marked = self.mark(everything)
        strong = self._write(self.strongest(marked), "strong", version)
        candidates = corpus.candidate_pairs(strong)
        known = self.read("pairs", earlier[-1]) if earlier else None
        fresh = candidates if known is None else corpus.fresh_pairs(candidates, known)
        judged = self.judge(fresh)
        # pairs found earlier stay, judged once
        pairs = self._write(judged if known is None else known.unionByName(judged), "pairs", version)
        members = strong if not earlier else self._members(pairs, marked, strong)
        state = self._write(corpus.snapshot(marked, pairs, members), "snapshots", version)
        if earlier:
            self._write(corpus.diff_snapshots(self.read("snapshots", earlier[-1]), state), "diffs", version)

    @staticmethod
    def _members(pairs: DataFrame, marked: DataFrame, strong: DataFrame) -> DataFrame:
        """Members of all pairs, also of those found when another statement was the strongest."""
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        return marked.join(ids, "id", "left_semi")


def run_events(store: CorpusStore, folder: str, schema: T.StructType, checkpoint: str) -> None:
    """Take the files of a folder that have not been seen as one batch, then stop.

    The stream's checkpoint numbers the batches across runs, so the batch number is the version.
    """
    run_files(store.spark, store.on_event, folder, schema, checkpoint)


def run_files(spark: SparkSession, on_event: Callable[[DataFrame, int], None], folder: str, schema: T.StructType, checkpoint: str) -> None:
    stream = spark.readStream.schema(schema).parquet(folder)
    query = (
        stream.writeStream.foreachBatch(lambda df, n: on_event(df, n))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def cached_apply(df: DataFrame, cache: str, key_columns: list[str], compute: Step) -> tuple[DataFrame, DataFrame]:
    """Answer rows from a cache table; compute and append the misses only. Returns (all answers, misses).

    ``compute`` gets one row per missing key and adds ``value``. Keys alone are held against the cache; only the rows of
    those it lacks carry their columns on.
    """
    spark = df.sparkSession
    keyed = df.withColumn("cache_key", fingerprint(*[F.col(c) for c in key_columns]))
    if exists(spark, cache):
        known = spark.read.parquet(cache).select("cache_key")
        missing = keyed.select("cache_key").distinct().join(known, "cache_key", "left_anti")
        wanted = keyed.join(missing, "cache_key", "left_semi")
    else:
        wanted = keyed
    misses = wanted.dropDuplicates(["cache_key"])
    fresh = compute(misses).select("cache_key", "value")
    fresh = cut_lineage(fresh)  # read twice, and the cache it was read against is about to change
    fresh.write.mode("append").parquet(cache)
    # an append that ran twice leaves equal rows: one per key is kept on reading
    stored = spark.read.parquet(cache).dropDuplicates(["cache_key"])
    return keyed.join(stored, "cache_key", "left").drop("cache_key"), fresh


def dedup_apply(df: DataFrame, keys: list[str], compute: Step) -> DataFrame:
    """Compute once per distinct key and fan the results back.

    Rows and answers meet by the fingerprint of the key columns, so texts are neither grouping nor join keys. Null keys
    are a key of their own. ``compute`` gets the key columns of one row per key and keeps what it does not name.
    """
    present = [F.concat(F.col(c).isNotNull().cast("string"), F.lit("\x00"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in keys]
    keyed = df.withColumn("_key", fingerprint(*present))
    answers = compute(keyed.select("_key", *keys).dropDuplicates(["_key"]))
    return keyed.join(answers.drop(*keys), "_key", "left").drop("_key")


def lot_stats(events: DataFrame, at: str, window: str, event_type: str) -> DataFrame:
    """Counts and mean value per lot and type; the same expression for streams and tables."""
    return events.groupBy(F.window(at, window).alias("lot"), event_type).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )


def check_lot(rows: DataFrame, low: float, high: float) -> DataFrame:
    """A lot is published only when its mean value stays in the band."""
    mean = F.col("total") / F.col("n")
    return rows.withColumns({"mean": mean, "published": mean.between(low, high).cast("int")})


def monitor_stream(
    spark: SparkSession, folder: str, glob: str, schema: T.StructType, out: str, checkpoint: str, at: str, window: str,
    delay: str, low: float, high: float,
) -> None:
    """Tumbling lots over a file stream; late rows up to ``delay`` still count; each lot is checked before it is written.

    A trigger writes the lots it changed to ``batch=<n>``; the last batch of a lot holds its state. Lots older than the
    watermark leave the state store.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    query = (
        lot_stats(timed, at, window, "event_type").writeStream.outputMode("update")
        .foreachBatch(lambda df, n: check_lot(df, low, high).write.mode("overwrite").parquet(f"{out}/batch={n}"))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
