"""Splitting rows by user, with the generic copy of every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GENERIC = "generic_user"


def split_users(df: DataFrame, user: str, generic: bool = True, individual: bool = True) -> DataFrame:
    """Each row under its own user and once more under the generic user, as ``split_user``.

    The generic user owns every row: aggregate it (partial sums combine before the shuffle) or index it
    with :mod:`tidemark.operators.ordered`, which splits large keys; never group it into one task.
    """
    names = []
    if individual:
        names.append(F.col(user).cast("string"))
    if generic:
        names.append(F.lit(GENERIC))
    return df.withColumn("split_user", F.explode(F.array(*names)))


def rows_per_key(df: DataFrame, key: str) -> DataFrame:
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.min("n").alias("min_rows"),
        F.max("n").alias("max_rows"),
        F.round(F.avg("n"), 6).alias("avg_rows"),
        F.count(F.lit(1)).alias("users"),
    )


def grouped_rows(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """Rows laid out by key. Range partitioning on (key, row id) may cut a large key across tasks."""
    return df.repartitionByRange(key, row_id).sortWithinPartitions(key, row_id)


def only(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed, key, "left_semi")


def without(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed, key, "left_anti")
