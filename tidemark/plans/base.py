"""Inputs shared by the catalogue: the events table seen as scored detections.

``events`` stands for authentication events: ``event_type`` is the category (and root cause),
``props.k`` the location or device code, ``value`` the numeric feature, ``event_id`` the row id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import risk
from tidemark.session import table

AS_OF = "2024-01-31"

# k as a column of the SQL side, and the scored detections as a sub-select.
K_SQL = "CAST(regexp_extract(props, '[0-9]+') AS BIGINT)"
SEVERITY_SQL = (
    "CASE WHEN score > 5 THEN 'CRITICAL' WHEN score >= 3 THEN 'HIGH' WHEN score >= 2.5 THEN 'MEDIUM' "
    "WHEN score > 2 THEN 'LOW' ELSE 'NONE' END"
)
SCORED_SQL = f"""(
  SELECT s.*, {SEVERITY_SQL} AS severity FROM (
    SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, {K_SQL} AS k,
           CASE WHEN b.sd = 0 THEN 0 ELSE (e.value - b.mean) / b.sd END AS z,
           abs(CASE WHEN b.sd = 0 THEN 0 ELSE (e.value - b.mean) / b.sd END) AS score
    FROM events e JOIN (
      SELECT user_id, avg(value) AS mean, stddev_pop(value) AS sd FROM events GROUP BY user_id
    ) b ON e.user_id = b.user_id
  ) s)"""
DETECTIONS_SQL = f"(SELECT * FROM {SCORED_SQL} WHERE score > 2)"


def k_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").try_cast("bigint")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("k", k_of(F.col("props"))).drop("props")


def with_baseline(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the mean and population deviation of their key, z-score (0 when constant)."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    z = F.when(F.col("sd") == 0, 0.0).otherwise((F.col(value) - F.col("mean")) / F.col("sd"))
    return df.join(stats, keys).withColumn("z", z)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_baseline(keyed_events(spark, sf_dir), ["user_id"], "value")
    return (
        df.withColumn("score", F.abs("z"))
        .withColumn("severity", risk.severity(F.col("score")))
        .drop("mean", "sd")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).filter("score > 2")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")
