"""Named parquet tables under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Tables whose rows are costly to process (long texts, vectors).
HEAVY = {"documents", "pages", "embeddings"}


#: Tasks over which a local session deals the heavy tables, whose test files are one row group each. Unset on a cluster: files are read as they are.
SPREAD_KEY = "spark.ravelin.localSpread"


class Tables:
    """Attribute access to the parquet tables of one directory: ``t.orders``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(self.path(name))
        tasks = self.spark.conf.get(SPREAD_KEY, None)
        return df.repartition(int(tasks)) if tasks and name in HEAVY else df
