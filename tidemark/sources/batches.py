"""Data-level batching: payload batches, replays, and file selection by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered

# Fixed value: the file-name timestamp pattern, year to second.
NAME_TIMESTAMP = (
    r"(\d{4})-(\d{1,2})-(\d{1,2})[T_ ]?(\d{1,2})?[:_-]?(\d{1,2})?[:_-]?(\d{1,2})?"
)


def payload_batches(
    df: DataFrame,
    order: Sequence[str],
    size: int,
    group_by: Sequence[str] = (),
    timestamp: str | None = None,
    period: str = "day",
) -> DataFrame:
    """Number rows into batches of ``size`` within each group (and period)."""
    keys = list(group_by)
    if timestamp is not None:
        df = df.withColumn("period", F.date_trunc(period, timestamp))
        keys.append("period")
    rows = ordered.row_index(df, keys, order, "_i")
    return rows.withColumn("batch", F.floor(F.col("_i") / size).cast("long")).drop("_i")


def replay(df: DataFrame, timestamp: str, times: int) -> DataFrame:
    """The frame repeated ``times`` times, each copy shifted by one more time span."""
    span = df.agg((F.max(timestamp) - F.min(timestamp)).alias("w")).first()["w"]
    return df.withColumn("replay", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(
        timestamp, F.col(timestamp) + F.lit(span) * F.col("replay")
    )


def repeat(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_r")


def file_time(path: Column, modified: Column, pattern: str = NAME_TIMESTAMP) -> Column:
    """Timestamp named in a file path, else the modification time."""
    name = F.element_at(F.split(path, "/"), -1)

    def part(i: int) -> Column:
        return F.lpad(F.coalesce(F.nullif(F.regexp_extract(name, pattern, i), F.lit("")), F.lit("0")), 2, "0")

    text = F.concat_ws(
        " ",
        F.concat_ws("-", F.regexp_extract(name, pattern, 1), part(2), part(3)),
        F.concat_ws(":", part(4), part(5), part(6)),
    )
    named = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.when(F.regexp_extract(name, pattern, 1) != "", named), modified)


def in_range(df: DataFrame, time: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends inclusive."""
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(time) <= F.lit(end).cast("timestamp"))
    return df


def sample_files(files: DataFrame, time: str, path: str, how: str | float | int, seed: int = 0) -> DataFrame:
    """A period name keeps its first file each; below 1 is a fraction; 1 and above is a count."""
    if isinstance(how, str):
        bucketed = files.withColumn("_p", F.date_trunc(how, time))
        return ordered.top_k(bucketed, ["_p"], 1, F.asc(time), F.asc(path), rank="_rank").drop("_p", "_rank")
    if how < 1:
        return files.sample(fraction=float(how), seed=seed)
    return files.orderBy(F.rand(seed)).limit(int(how))


def period_groups(files: DataFrame, time: str, path: str, period: str = "day") -> DataFrame:
    """Per period: its sorted file list, ``batch_count`` and ``origin_hash``; ``n_groups`` spans empty periods."""
    bucketed = files.withColumn("period", F.date_trunc(period, time))
    span = bucketed.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    step = F.expr(f"interval 1 {period}")
    n_groups = span.select(F.size(F.sequence("lo", "hi", step)).alias("n")).first()["n"]
    grouped = bucketed.groupBy("period").agg(F.sort_array(F.collect_list(path)).alias("files"))
    return grouped.select(
        "period",
        "files",
        F.lit(n_groups).alias("n_groups"),
        F.size("files").alias("batch_count"),
        F.md5(F.concat_ws(",", "files")).alias("origin_hash"),
    )
