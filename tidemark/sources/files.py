"""File, table and SQL sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ordered
from tidemark.sources import batches

# File extension to reader format.
FORMATS = {
    "csv": "csv",
    "json": "json",
    "jsonlines": "jsonlines",
    "jsonl": "jsonlines",
    "parquet": "parquet",
}


def format_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    for part in reversed(name.split(".")):
        if part in FORMATS:
            return FORMATS[part]
    raise ValueError(f"cannot tell the format of {path}")


def read_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str = "auto",
    schema: T.StructType | str | None = None,
    options: Mapping[str, str] | None = None,
    filter_nulls: bool = False,
    null_columns: Sequence[str] = ("data",),
    recursive: bool = False,
) -> DataFrame:
    """CSV, JSON, JSON-lines or parquet files, directories and globs; optional null filter at the scan."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    kind = format_of(listed[0]) if fmt == "auto" else fmt
    reader = spark.read.options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if kind == "csv":
        reader = reader.option("header", "true")
        df = (reader if schema is not None else reader.option("inferSchema", "true")).csv(listed)
    elif kind == "json":
        df = reader.option("multiLine", "true").json(listed)
    elif kind == "jsonlines":
        df = reader.json(listed)
    elif kind == "parquet":
        df = reader.parquet(*listed)
    else:
        raise ValueError(f"unknown format {kind}")
    if filter_nulls:
        df = df.na.drop(subset=[c for c in null_columns if c in df.columns])
    return df


def with_file_time(df: DataFrame, pattern: str = batches.NAME_TIMESTAMP) -> DataFrame:
    """Add ``file_path`` and ``file_time`` from the scan's metadata (call on a fresh file scan)."""
    time = batches.file_time(F.col("_metadata.file_path"), F.col("_metadata.file_modification_time"), pattern)
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), time.alias("file_time"))


def list_files(df: DataFrame, pattern: str = batches.NAME_TIMESTAMP) -> DataFrame:
    """(file_path, file_time) of the files of a scan; reads no data columns."""
    time = batches.file_time(F.col("_metadata.file_path"), F.col("_metadata.file_modification_time"), pattern)
    return df.select(F.col("_metadata.file_path").alias("file_path"), time.alias("file_time")).distinct()


def file_batches(df: DataFrame, period: str = "day", start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with their file's period, ``batch_count`` and ``origin_hash``; files outside the range are skipped."""
    dated = batches.in_range(with_file_time(df), "file_time", start, end)
    files = dated.select("file_path", "file_time").distinct()
    groups = batches.period_groups(files, "file_time", "file_path", period)
    rows = dated.withColumn("period", F.date_trunc(period, "file_time"))
    return rows.join(groups.drop("files"), "period")


def run_queries(spark: SparkSession, queries: Sequence[Mapping[str, str]]) -> DataFrame:
    """Run several SQL queries over JDBC, or over Spark tables when no url is given, and stack the results."""
    out = None
    for q in queries:
        if "url" in q:
            options = {k: v for k, v in q.items() if k != "query"}
            df = spark.read.format("jdbc").options(**options).option("query", q["query"]).load()
        else:
            df = spark.sql(q["query"])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def paged_table(spark: SparkSession, query: str, order: Sequence[str], page_rows: int) -> DataFrame:
    """Rows of a query with ``page``, numbered by a total order over all rows."""
    rows = ordered.row_index(spark.sql(query), [], order, "_i")
    return rows.withColumn("page", F.floor(F.col("_i") / page_rows).cast("long")).drop("_i")


def dedup_entries(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per entry id across polls."""
    return df.dropDuplicates([key])


def watch_directory(
    spark: SparkSession, path: str, fmt: str, schema: T.StructType | str, files_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of files not seen before; recursive, with an optional bound per micro-batch."""
    reader = spark.readStream.format("json" if fmt == "jsonlines" else fmt).schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.load(path)
