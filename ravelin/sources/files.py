"""Readers and writers of files: typed CSV, checked CSV, series, cells, JSON lines, inventories, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ravelin.session import ensure_checkpoint_dir


class InputMismatch(ValueError):
    """A file does not have the agreed shape."""


def scratch(spark: SparkSession, name: str) -> str:
    """New folder below the shared checkpoint folder, so that every executor can reach it."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a declared schema; codes stay text, so leading zeros survive."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def load_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose header must be exactly the schema's columns in order; malformed rows fail the job."""
    found = spark.read.option("header", True).csv(path).columns
    if found != schema.names:
        raise InputMismatch(f"columns {found}, expected {schema.names}")
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def scan_series(df: DataFrame, ids: list[str], id_col: str, columns: list[str]) -> DataFrame:
    """Three columns of a few series; the filter and the columns reach the scan."""
    return df.where(F.col(id_col).isin(ids)).select(*columns)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def scan_files(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """Every file below a folder, or below some paths of it: relative path and size; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths or root)
    # both sides without scheme and leading slashes; paths come percent-encoded
    bare = lambda c: F.regexp_replace(c, "^[a-z]+:/*|^/+", "")
    relative = F.substring(bare(F.col("path")), F.length(bare(F.lit(root.rstrip("/")))) + F.lit(2), F.length("path"))
    return files.select(relative.alias("path"), F.col("length").alias("bytes"))


def source_id(path: Column) -> Column:
    """Numbered prefix of a file stem (letter and two digits), else the whole stem."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    numbered = F.regexp_extract(stem, r"^([EM]\d{2})_", 1)
    return F.when(numbered != "", numbered).otherwise(stem)


def file_kind(path: Column, folders: dict[str, str], extensions: dict[str, str], default: str = "archive") -> Column:
    """Kind by extension, else by first folder; contracts named INV- are invoices."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    parts = F.split(path, "/")
    folder = F.when(F.size(parts) > 1, F.get(parts, 0))
    stem = F.upper(F.element_at(parts, -1))
    by_folder = F.lit(default)
    for name, kind in folders.items():
        by_folder = F.when(folder == name, kind).otherwise(by_folder)
    by_folder = F.when((by_folder == "contract") & stem.startswith("INV-"), "invoice").otherwise(by_folder)
    out = by_folder
    for name, kind in extensions.items():
        out = F.when(extension == name, kind).otherwise(out)
    return out


def read_cells(cells: DataFrame, label: str, offsets: dict[int, int], quality: int) -> DataFrame:
    """Long cells (sheet, row, col, text) to one row per labelled line and year.

    The header is the first row that holds ``label``; the value of a year sits at a fixed offset
    from it, its quality one further. A value that is no number becomes the note.
    """
    header = cells.where(F.col("text") == label).groupBy("sheet").agg(
        F.min(F.struct("row", "col")).alias("h")
    ).select("sheet", F.col("h.row").alias("h_row"), F.col("h.col").alias("h_col"))
    wanted = F.explode(
        F.array(*[F.struct(F.lit(y).alias("year"), F.lit(o).alias("offset")) for y, o in offsets.items()])
    ).alias("w")
    below = cells.join(header, "sheet").where(F.col("row") > F.col("h_row"))
    names = below.where(F.col("col") == 0).select("sheet", "row", F.trim("text").alias("name"))
    values = below.select("sheet", "row", "col", "text", "h_col", wanted).where(
        (F.col("col") == F.col("h_col") + F.col("w.offset")) | (F.col("col") == F.col("h_col") + F.col("w.offset") + quality)
    )
    is_value = F.col("col") == F.col("h_col") + F.col("w.offset")
    paired = values.groupBy("sheet", "row", F.col("w.year").alias("year")).agg(
        F.max(F.when(is_value, F.col("text"))).alias("cell"), F.max(F.when(~is_value, F.col("text"))).alias("mark")
    )
    number = F.col("cell").try_cast("double")
    return names.join(paired, ["sheet", "row"]).select(
        "sheet", "name", "year", number.alias("value"),
        F.when(number.isNotNull(), F.col("mark")).otherwise(F.col("cell")).alias("note"),
    )


def clean_number(col: Column, digits: int = 2) -> Column:
    """Rounded number for a result file; NaN becomes null."""
    return F.round(F.when(~F.isnan(col), col), digits)


def write_decisions(df: DataFrame, path: str, columns: list[str], order: str) -> None:
    """CSV parts with a header, in row order over the parts; no task holds more than its range."""
    parts = df.select(*columns).repartitionByRange(F.col(order)).sortWithinPartitions(order)
    parts.write.mode("errorifexists").option("header", True).option("lineSep", "\n").csv(path)


def validate_decisions(df: DataFrame, identifier: str, decision: str, rows: int, total: int, band: tuple[float, float]) -> DataFrame:
    """One row of checks on a re-read deliverable."""
    per_id = df.groupBy(identifier).agg(F.count(F.lit(1)).alias("k"), F.sum(decision).alias("d"), F.min(decision).alias("lo"), F.max(decision).alias("hi"))
    n = F.sum("k")
    rate = F.sum("d") / n
    return per_id.agg(
        n.alias("n"), F.sum("d").alias("selected"), (n == rows).cast("int").alias("rows_ok"), (F.max("k") == 1).cast("int").alias("ids_unique"),
        ((F.min("lo") >= 0) & (F.max("hi") <= 1)).cast("int").alias("binary"), (F.sum("d") == total).cast("int").alias("total_ok"),
        rate.between(*band).cast("int").alias("rate_ok"),
    )


def to_annex(items: DataFrame, findings: DataFrame, item_keys: list[str], bar_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Strict export of nested items: listed keys only, sheet from the finding when missing; (valid, invalid)."""
    sheets = findings.groupBy("item_id").agg(F.min("sheet").alias("_sheet"))
    joined = items.join(sheets, "item_id", "left").withColumn("sheet", F.coalesce("sheet", "_sheet"))
    bars = F.transform("bars", lambda b: F.struct(*[b[k].alias(k) for k in bar_keys]))
    shaped = joined.select(*item_keys, bars.alias("bars"))
    valid = F.col("sheet").isNotNull() & F.forall("bars", lambda b: b["size"].isNotNull() & (b["qty"] > 0))
    return shaped.where(valid), shaped.where(~valid)


def run_manifest(inputs: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Size, hash and text counts per input; totals come from a rollup over the keys."""
    hashed = inputs.select(
        *keys, F.octet_length(content).alias("_bytes"), F.sha2(F.col(content), 256).alias("_sha"),
        (F.length(F.trim(content)) > 0).cast("int").alias("_text"),
    )
    return hashed.rollup(*keys).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("_bytes").alias("bytes"), F.sum("_text").alias("with_text"),
        F.min("_sha").alias("first_sha"),
    )


def attachments(containers: DataFrame, registry: DataFrame) -> DataFrame:
    """Sub-documents (container, name, sha256) with the known source of the same hash."""
    rows = containers.select("container", F.explode("attachments").alias("a")).select(
        "container", F.col("a.name").alias("name"), F.col("a.sha256").alias("sha256")
    )
    known = registry.groupBy("sha256").agg(F.min("id").alias("same_as"))
    return rows.join(known, "sha256", "left")


def pick_by_prefix(df: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Columns whose normalised header starts with a prefix, renamed."""
    picked = []
    for prefix, name in prefixes.items():
        match = next((c for c in df.columns if c.upper().strip().startswith(prefix)), None)
        if match is None:
            raise InputMismatch(f"no column starts with {prefix}")
        picked.append(F.col(f"`{match}`").alias(name))
    return df.select(*picked)


def compact(col: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(col.cast("string"), F.lit(""))), r"\s+", "")


def merge_runs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a partial rebuild replace the old rows of their keys; the rest stays."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest_run(runs: DataFrame, project: str, at: list[str]) -> DataFrame:
    """Latest run of each project; one row per project and task is shuffled."""
    order = [F.desc(c) for c in at]
    ranked = runs.withColumn("_rn", F.row_number().over(W.partitionBy(project).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def ensure_summary(stored: DataFrame, children: DataFrame, key: str, total: str) -> DataFrame:
    """Stored totals, rebuilt from the child rows where they are missing."""
    rebuilt = children.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return stored.join(rebuilt, key, "left").withColumn(
        total, F.coalesce(F.col(total), F.col("_n"), F.lit(0))
    ).drop("_n")
