"""Threshold filters, contiguous runs, routing and detection post-processing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered


def over_threshold(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """Rows where any of the columns is strictly above the threshold."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c) > threshold for c in columns]))


def any_element_over(df: DataFrame, array: str, threshold: float) -> DataFrame:
    return df.filter(F.exists(array, lambda x: x > threshold))


def contiguous_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column) -> DataFrame:
    """Rows that hit, with ``row_index`` in the key and ``run``, the number of their unbroken run."""
    indexed = ordered.row_index(df.withColumn("_hit", hit), keys, order, "row_index")
    hits = indexed.filter("_hit").drop("_hit")
    counted = ordered.row_index(hits, keys, order, "_nth")
    return counted.withColumn("run", F.col("row_index") - F.col("_nth")).drop("_nth")


def tag_detections(df: DataFrame, score: str, threshold: float, source: str) -> DataFrame:
    return df.filter(F.col(score) > threshold).withColumn("anomaly_source", F.lit(source))


def detection_summary(df: DataFrame, score: str, threshold: float, source: str) -> DataFrame:
    hit = F.col(score) > threshold
    return df.agg(
        F.first(F.lit(source)).alias("anomaly_source"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(hit).alias("detections"),
        F.round(F.try_divide(100.0 * F.count_if(hit), F.count(F.lit(1))), 4).alias("detection_rate"),
        F.round(F.max(score), 6).alias("max_score"),
        F.round(F.avg(F.when(hit, F.col(score))), 6).alias("mean_detected"),
    )


def routed(df: DataFrame, key: Column, routes: Mapping[str, str]) -> DataFrame:
    """Add ``route``; a key without a route fails the job."""
    out = None
    for value, route in routes.items():
        test = key == value
        out = F.when(test, route) if out is None else out.when(test, route)
    unknown = F.raise_error(F.concat(F.lit("no route for key "), key.cast("string"))).cast("string")
    return df.withColumn("route", out.otherwise(unknown))


def postprocess(df: DataFrame, timestamp: str, numeric: Sequence[str], version: str) -> DataFrame:
    """Formatted event time, model version, and NaN/Inf written as the text ``NaN``."""
    out = df.withColumn("event_time", F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")).withColumn(
        "model_version", F.lit(version)
    )
    for name in numeric:
        c = F.col(name).cast("double")
        bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
        out = out.withColumn(name, F.when(bad, "NaN").otherwise(c.cast("string")))
    return out
