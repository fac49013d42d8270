"""Inventories of real folders, and the manifest of a run gathered while the run computes.

Row counts and totals are observed metrics: they are taken where the rows pass, so a manifest costs no second scan of any stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ravelin.sources import files


def _file_system(root: str) -> tuple[pafs.FileSystem, str]:
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[len("file:"):].lstrip("/")
    return (pafs.LocalFileSystem(), root) if "://" not in root else pafs.FileSystem.from_uri(root)


def write_files(df: DataFrame, root: str, path: str, content: str) -> int:
    """Write one file per row below a folder that all tasks reach; a task that runs again writes the same files. Returns their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _file_system(root)
        for batch in batches:
            for name, text in zip(batch["path"], batch["content"]):
                target = f"{base}/{name}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write((text or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    rows = df.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return rows.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _children(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(f.getPath().toString(), f.isDirectory()) for f in system.listStatus(folder)]


def list_folder(spark: SparkSession, root: str, left_out: list[str] = []) -> DataFrame:  # noqa: B006
    """Relative path and size of every file below a folder, without those of some names; contents are not read.

    The folders of the first level are listed as paths of their own, which Spark does in tasks when there are many.
    """
    children = _children(spark, root)
    if not children:
        return spark.createDataFrame([], "path string, bytes long")
    found = files.scan_files(spark, root, [path for path, _ in children])
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(~name.isin(left_out)) if left_out else found


def inventory(spark: SparkSession, root: str, folders: dict[str, str], extensions: dict[str, str], left_out: list[str] = []) -> DataFrame:  # noqa: B006
    """Path, size, source id and kind of every file below a folder."""
    path = F.col("path")
    return list_folder(spark, root, left_out).select("path", "bytes", files.source_id(path).alias("source_id"), files.file_kind(path, folders, extensions).alias("kind"))


class Run:
    """Manifest of a run: inputs, stage rows, outputs, totals and evaluation, as rows (section, name, metric, value)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.observed: list[tuple[str, str, Observation]] = []
        self.rows: list[tuple[str, str, str, float]] = []

    def _watched(self, section: str, name: str, df: DataFrame, totals: dict[str, Column]) -> DataFrame:
        seen = Observation(f"{section}-{name}-{len(self.observed)}")
        self.observed.append((section, name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(m) for m, c in totals.items()])

    def input(self, name: str, df: DataFrame, content: str) -> DataFrame:
        """Rows, bytes and a digest that doesn't depend on the order of the rows: the sum of 32 bits of each content's MD5."""
        part = F.conv(F.substring(F.md5(content), 1, 8), 16, 10).cast("long")
        return self._watched("input", name, df, {"bytes": F.sum(F.octet_length(content)), "digest": F.sum(part)})

    def stage(self, name: str, df: DataFrame, **totals: Column) -> DataFrame:
        return self._watched("stage", name, df, totals)

    def output(self, name: str, df: DataFrame, path: str) -> None:
        """Write JSON lines; the stages above are observed by this very action."""
        files.write_jsonl(self._watched("output", name, df, {}), path)
        made = list_folder(self.spark, path).where(~F.col("path").contains("/_") & ~F.col("path").startswith("_") & ~F.col("path").endswith(".crc"))
        size = made.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        self.rows.append(("output", name, "bytes", float(size["bytes"])))

    def evaluation(self, **values: float) -> None:
        self.rows += [("evaluation", "all", metric, float(v)) for metric, v in values.items()]

    def manifest(self) -> DataFrame:
        rows = list(self.rows)
        for section, name, seen in self.observed:
            rows += [(section, name, metric, float(v or 0)) for metric, v in seen.get.items()]
        return self.spark.createDataFrame(sorted(rows), "section string, name string, metric string, value double")
