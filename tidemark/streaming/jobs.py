"""Streaming jobs built from the same transformations as the batch ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import risk
from tidemark.operators import sequences as seq


def tumbling_rollup(stream: DataFrame, keys: Sequence[str], ts: str, width: str, value: str, lateness: str = "1 hour") -> DataFrame:
    """Continuous aggregate: a window is final once the watermark passes its end by ``lateness``."""
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.window(ts, width).alias("_w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"), F.max(value).alias("max_value"))
        .select(F.col("_w.start").alias("bucket"), *keys, "n", "avg_value", "max_value")
    )


def sliding_rollup(stream: DataFrame, keys: Sequence[str], ts: str, width: str, slide: str, lateness: str = "1 hour") -> DataFrame:
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.window(ts, width, slide).alias("_w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("bucket"), *keys, "n")
    )


def sessions(stream: DataFrame, keys: Sequence[str], ts: str, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Activity sessions (an extra: the compared system has none)."""
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.session_window(ts, gap).alias("_w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n")
    )


def deduplicated(stream: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    """First arrival of each entry id; ids are forgotten after ``within``, so the state stays bounded."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def latest_per_user(batch: DataFrame, user: str, ts: str, row_id: str) -> DataFrame:
    """Latest event of each user in a micro-batch; on equal times the later arrival wins."""
    return seq.latest_per_key(batch, [user], ts, row_id)


def scored_routes(batch: DataFrame, score: str, threshold: float) -> DataFrame:
    """Tag rows ``anomalies`` or ``clean``; anomalies carry severity and compressed score."""
    hit = F.col(score) > threshold
    return (
        batch.withColumn("route", F.when(hit, "anomalies").otherwise("clean"))
        .withColumn("severity", F.when(hit, risk.severity(F.col(score))))
        .withColumn("anomaly_score", risk.compress_score(F.col(score)))
    )


def detection_record(
    df: DataFrame, user: str, ts: str, z: dict[str, Column], values: dict[str, Column], threshold: float, source: str = "zscore"
) -> DataFrame:
    """Record sent on for each detection: scores, top-3 feature text and all z-scored features as JSON."""
    top = seq.top_features(z, values, len(z))
    largest = F.greatest(*z.values()) if len(z) > 1 else next(iter(z.values()))
    mean = sum(list(z.values())[1:], next(iter(z.values()))) / len(z)
    return df.select(
        F.col(user).alias("user_id"),
        F.col(ts).alias("timestamp"),
        risk.compress_score(mean).alias("anomaly_score"),
        risk.compress_score(largest).alias("max_abs_z"),
        F.lit(threshold).alias("threshold"),
        F.lit(source).alias("anomaly_source"),
        F.lit(1).alias("event_count"),
        F.lit(len(z)).alias("feature_count"),
        seq.top_features_text(F.slice(top, 1, 3)).alias("top_features"),
        F.to_json(
            F.transform(top, lambda t: F.struct(t["name"], t["value"], risk.compress_score(t["abs_z"]).alias("z_score")))
        ).alias("features"),
    ).filter(mean > threshold)


def start_routed(
    stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], sinks: dict[str, Callable[[DataFrame, int], None]],
    checkpoint: str, interval: str | None = None,
):
    """Score each micro-batch with the batch transformations, then write every route to its sink.

    Sinks receive the epoch number, so a replayed batch can overwrite its own output.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = prepare(batch).persist()
        for name, sink in sinks.items():
            sink(rows.filter(F.col("route") == name).drop("route"), epoch)
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def tagged_union(anomalies: DataFrame, clean: DataFrame) -> DataFrame:
    """Both event kinds in one stream, told apart by ``event_type``: one query replaces two consumers."""
    return anomalies.withColumn("event_type", F.lit("anomaly")).unionByName(
        clean.withColumn("event_type", F.lit("clean")), allowMissingColumns=True
    )
