"""The corpus pipeline: language, near-duplicates, benchmark leaks, secrets, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next stage's ``docs``. All
stages but the last return the columns of ``documents``:

* language_id drops documents without a letter, and those of which the known languages together hold less than half of the words;
* near_dedup keeps the document of smallest id of each group of near-duplicates (five-word shingles, similarity of 0.8 or more);
* decontaminate drops documents that hold ten consecutive words of a benchmark item;
* mask_secrets replaces secrets by a mark; documents stay;
* encode gives every document's sampled piece ids, decodes them, and tells whether all give the text back.
"""

from __future__ import annotations

import pathlib
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from ravelin.llm import decontaminate as leaks  # noqa: E402
from ravelin.llm import language_mixture, minmax_dedup, piece_sampling, secrets  # noqa: E402
from ravelin.llm.registry import importable, table  # noqa: E402
from ravelin.llm.storage import written  # noqa: E402

DEDUP_WORDS = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_mixture.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax_dedup.keep_first(docs, size=DEDUP_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = piece_sampling.sample_pieces(docs.select("doc_id", "text"), F.col("doc_id"), keep_text=False, decode=True)
    same = F.forall("decoded", lambda d: d["same"])
    return found.select("doc_id", F.size("samples").alias("n_samples"), "samples", F.col("decoded.sha256").alias("decoded_sha256"), same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
CHECK_SQL: dict[str, str] = {}
