"""File, table, Kafka, JDBC and document sinks; merges on plain tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.operators.vectors import upsert
from tidemark.sources.files import format_of
from tidemark.sources.kafka import kafka_rows


def write_file(df: DataFrame, path: str, fmt: str = "auto", overwrite: bool = False, include_header: bool = True) -> None:
    """Fails when the target exists unless ``overwrite``."""
    kind = format_of(path) if fmt == "auto" else fmt
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if kind == "csv":
        writer.option("header", str(include_header).lower()).csv(path)
    elif kind in ("json", "jsonlines"):
        writer.json(path)
    else:
        writer.parquet(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet", overwrite: bool = True) -> None:
    writer = df.write.mode("overwrite" if overwrite else "append").partitionBy(*by).format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)


def write_scores_by_period(df: DataFrame, path: str, user: str, ts: str, features: Sequence[str], score: str, period: str = "day") -> None:
    """user, time, ``<f>_score`` and anomalyScore as CSV, one folder per period."""
    out = df.select(
        F.col(user).alias("user"),
        F.col(ts).alias("time"),
        *[F.col(f"{f}_z_loss").alias(f"{f}_score") for f in features],
        F.col(score).alias("anomalyScore"),
        F.date_format(F.date_trunc(period, ts), "yyyy-MM-dd").alias("period"),
    )
    write_partitioned(out, path, ["period"], "csv")


def write_report(report: DataFrame, path: str, overwrite: bool = False) -> None:
    """A comparison result (one row) as one JSON file, keys in order; nothing is computed if ``path`` exists and stays."""
    write_file(report.select(*sorted(report.columns)).coalesce(1), path, "json", overwrite)


def append_merged(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append; readers merge old and new columns (``read_merged``). Pass fmt="delta" where that is installed."""
    writer = df.write.mode("append").format(fmt)
    (writer.option("mergeSchema", "true") if fmt == "delta" else writer).save(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_kafka(df: DataFrame, bootstrap: str, topic: str, key: str | None = None) -> None:
    kafka_rows(df, key).write.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("topic", topic).save()


def write_table(df: DataFrame, url: str, name: str, properties: Mapping[str, str], append: bool = True) -> None:
    """SQL table by JDBC; several connections write partitions side by side."""
    df.write.mode("append" if append else "overwrite").jdbc(url, name, properties=dict(properties))


def with_missing_columns(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Columns of a target table that the frame lacks, as nulls; target order."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()])


def bulk_documents(df: DataFrame, index: str, id_col: str) -> DataFrame:
    """Action and source lines of a bulk index request, two lines per row in one text column."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(id_col).cast("string").alias("_id")).alias("index")))
    return df.select(F.concat(action, F.lit("\n"), F.to_json(F.struct(*df.columns))).alias("value"))


def merge_into(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], version: str) -> str:
    """Upsert into a versioned parquet table: the new version is written whole beside the old one.

    Nothing is overwritten in place, so a lost executor or a rerun cannot damage what readers see.
    Returns the folder of the new version.
    """
    latest = latest_version_path(spark, path)
    merged = upsert(spark.read.parquet(latest), rows, keys) if latest else rows
    target = f"{path.rstrip('/')}/version={version}"
    merged.write.mode("errorifexists").parquet(target)
    return target


def latest_version_path(spark: SparkSession, path: str) -> str | None:
    """Folder of the highest complete version."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = [
        s.getPath().toString()
        for s in fs.listStatus(root)
        if s.getPath().getName().startswith("version=")
        and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    ]
    return max(done, key=lambda p: int(p.rsplit("version=", 1)[1])) if done else None


def set_status(table: DataFrame, ids: DataFrame, key: str, status: str, stamp: Column) -> DataFrame:
    """The table with ``status`` and ``updated_at`` set on the listed ids."""
    marked = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = table.join(marked, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return joined.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn(
        "updated_at", F.when(hit, stamp).otherwise(F.col("updated_at"))
    ).drop("_hit")


def compact(df: DataFrame, path: str, ts: str, segment: str, rows_per_file: int = 5_000_000) -> None:
    """Rewrite by day, ordered by segment and time. Range partitioning cuts large days or users apart."""
    dated = df.withColumn("date", F.to_date(ts))
    laid_out = dated.repartitionByRange("date", segment, ts).sortWithinPartitions("date", segment, ts)
    laid_out.write.mode("errorifexists").option("maxRecordsPerFile", str(rows_per_file)).partitionBy("date").parquet(path)


def drop_old(df: DataFrame, date: str, as_of: Column, days: int) -> DataFrame:
    """Retention on the partition column: old partitions are pruned, not scanned."""
    return df.filter(F.col(date) >= F.to_date(as_of - F.expr(f"interval {days} days")))


def start_collections(df: DataFrame, path: str, checkpoint: str, interval: str = "1 minute", available_now: bool = False):
    """Stream into vector collections, one folder per ``collection`` value."""
    writer = df.writeStream.format("parquet").partitionBy("collection").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def to_sinks(df: DataFrame, sinks: Mapping[str, Callable[[DataFrame, int], None]], route: str = "route") -> DataStreamWriter:
    """Per micro-batch, the rows of each route go to that route's sink; the batch is computed once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for name, sink in sinks.items():
            sink(batch.filter(F.col(route) == name).drop(route), epoch)
        batch.unpersist()

    return df.writeStream.foreachBatch(write)
