"""Travel features between consecutive events of a user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.dashboards import one_row
from tidemark.operators.quantiles import quantiles

# Earth radius (km), speed cap (km/h), impossible-travel thresholds (km/h, km).
EARTH_RADIUS_KM = 6371
SPEED_CAP = 950.0
IMPOSSIBLE_SPEED = 800.0
IMPOSSIBLE_DISTANCE = 500.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null or out-of-range coordinates give 0."""
    valid = lat1.between(-90, 90) & lat2.between(-90, 90) & lon1.between(-180, 180) & lon2.between(-180, 180)
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    distance = EARTH_RADIUS_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
    return F.coalesce(F.when(valid, distance), F.lit(0.0))


def travel_features(
    df: DataFrame, user: str, ts: str, row_id: str, lat: str, lon: str, cap: float = SPEED_CAP
) -> DataFrame:
    """distance_km, ts_delta_hour, travel_speed_kmph; a first event or zero time gap has speed 0."""
    rows = ordered.framed(
        df, [user], [ts, row_id], 1, 0,
        lambda w: {"_lat": F.lag(lat).over(w), "_lon": F.lag(lon).over(w), "_ts": F.lag(ts).over(w)},
    )
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_ts").cast("timestamp"))
    hours = F.coalesce(micros / 3.6e9, F.lit(0.0))
    rows = rows.withColumn("distance_km", haversine_km(F.col("_lat"), F.col("_lon"), F.col(lat), F.col(lon)))
    rows = rows.withColumn("ts_delta_hour", hours)
    speed = F.coalesce(F.try_divide(F.col("distance_km"), F.col("ts_delta_hour")), F.lit(0.0))
    return rows.withColumn("travel_speed_kmph", F.least(speed, F.lit(cap))).drop("_lat", "_lon", "_ts")


def impossible_travel(df: DataFrame, speed: float = IMPOSSIBLE_SPEED, distance: float = IMPOSSIBLE_DISTANCE) -> DataFrame:
    hit = (F.col("travel_speed_kmph") > speed) & (F.col("distance_km") > distance)
    return df.withColumn("impossible_travel", hit)


def travel_statistics(df: DataFrame) -> DataFrame:
    """One row of speed and distance statistics over moving events, with anomaly rates in percent."""
    speed = F.when(F.col("travel_speed_kmph") > 0, F.col("travel_speed_kmph"))
    distance = F.when(F.col("distance_km") > 0, F.col("distance_km"))
    moving = df.withColumn("_s", speed).withColumn("_d", distance)
    total = F.count(F.lit(1))
    base = moving.agg(
        F.avg("_s").alias("mean_speed"), F.max("_s").alias("max_speed"),
        F.avg("_d").alias("mean_distance"), F.max("_d").alias("max_distance"),
        F.try_divide(F.count_if("impossible_travel") * 100.0, total).alias("impossible_rate"),
        F.try_divide(F.count_if(F.col("travel_speed_kmph") > 400) * 100.0, total).alias("high_speed_rate"),
        F.count("_s").alias("valid_events"), total.alias("total_events"),
    )
    speeds = quantiles(moving, [], "_s", {"median_speed": 0.5, "p95_speed": 0.95, "p99_speed": 0.99})
    row = one_row(base, speeds, quantiles(moving, [], "_d", {"median_distance": 0.5}))
    return row.na.fill(0)


def required_speed_pairs(
    df: DataFrame, user: str, ts: str, row_id: str, lat: str, lon: str, limit: float = 900.0
) -> DataFrame:
    """Data-quality check: consecutive events that would need more than ``limit`` km/h."""
    uncapped = travel_features(df, user, ts, row_id, lat, lon, cap=float("inf"))
    return uncapped.filter(F.col("travel_speed_kmph") > limit)
