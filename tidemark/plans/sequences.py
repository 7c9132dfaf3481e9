"""Ordered per-user queries: travel, rolling statistics, training windows, escalation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import risk
from tidemark.operators import ordered, sequences as seq, travel as tr
from tidemark.plans.base import AS_OF, DETECTIONS_SQL, K_SQL, SCORED_SQL, as_of, detections, keyed_events, scored
from tidemark.registry import query

TRAVEL_SQL = f"""(
  WITH c AS (SELECT event_id, user_id, ts, {K_SQL} * 1.5 - 70 AS lat, {K_SQL} * 3.5 - 170 AS lon FROM events),
  p AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ts) OVER w AS pts FROM c
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  h AS (SELECT *, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2) AS a FROM p),
  d AS (SELECT *, coalesce(6371 * 2 * atan2(sqrt(a), sqrt(1 - a)), 0) AS distance_km,
               coalesce((epoch_us(ts) - epoch_us(pts)) / 3.6e9, 0) AS ts_delta_hour FROM h),
  s AS (SELECT *, CASE WHEN ts_delta_hour = 0 THEN 0 ELSE distance_km / ts_delta_hour END AS raw_speed FROM d)
  SELECT event_id, user_id, ts, distance_km, ts_delta_hour, raw_speed, least(raw_speed, 950) AS travel_speed_kmph,
         least(raw_speed, 950) > 800 AND distance_km > 500 AS impossible_travel FROM s)"""


def located(spark, sf_dir):
    return keyed_events(spark, sf_dir).select(
        "event_id", "user_id", "ts", (F.col("k") * 1.5 - 70).alias("lat"), (F.col("k") * 3.5 - 170).alias("lon")
    )


def travelled(spark, sf_dir):
    return tr.impossible_travel(tr.travel_features(located(spark, sf_dir), "user_id", "ts", "event_id", "lat", "lon"))


@query(
    "travel",
    f"SELECT event_id, user_id, round(distance_km, 3) AS distance_km, round(ts_delta_hour, 6) AS ts_delta_hour, round(travel_speed_kmph, 3) AS travel_speed_kmph, impossible_travel FROM {TRAVEL_SQL}",
)
def travel(spark, sf_dir):
    return travelled(spark, sf_dir).select(
        "event_id", "user_id", F.round("distance_km", 3).alias("distance_km"),
        F.round("ts_delta_hour", 6).alias("ts_delta_hour"),
        F.round("travel_speed_kmph", 3).alias("travel_speed_kmph"), "impossible_travel",
    )


@query(
    "travel_stats",
    f"""
    WITH t AS (SELECT *, CASE WHEN travel_speed_kmph > 0 THEN travel_speed_kmph END AS s,
                      CASE WHEN distance_km > 0 THEN distance_km END AS d FROM {TRAVEL_SQL})
    SELECT round(avg(s), 3) AS mean_speed, round(quantile_cont(s, 0.5), 3) AS median_speed, round(max(s), 3) AS max_speed,
           round(quantile_cont(s, 0.95), 3) AS p95_speed, round(quantile_cont(s, 0.99), 3) AS p99_speed,
           round(avg(d), 3) AS mean_distance, round(quantile_cont(d, 0.5), 3) AS median_distance, round(max(d), 3) AS max_distance,
           round(count(*) FILTER (WHERE impossible_travel) * 100.0 / count(*), 4) AS impossible_rate,
           round(count(*) FILTER (WHERE travel_speed_kmph > 400) * 100.0 / count(*), 4) AS high_speed_rate,
           count(s) AS valid_events, count(*) AS total_events FROM t
    """,
)
def travel_stats(spark, sf_dir):
    row = tr.travel_statistics(travelled(spark, sf_dir))
    digits = {"impossible_rate": 4, "high_speed_rate": 4, "valid_events": 0, "total_events": 0}
    return row.select(*[
        F.col(c) if c.endswith("_events") else F.round(c, digits.get(c, 3)).alias(c) for c in row.columns
    ])


@query("required_speed_pairs", f"SELECT user_id, count(*) AS pairs, round(max(raw_speed), 2) AS top_speed FROM {TRAVEL_SQL} WHERE raw_speed > 900 GROUP BY 1")
def required_speed_pairs(spark, sf_dir):
    pairs = tr.required_speed_pairs(located(spark, sf_dir), "user_id", "ts", "event_id", "lat", "lon")
    return pairs.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.max("travel_speed_kmph"), 2).alias("top_speed")
    )


@query("fastest_trips", f"SELECT event_id, user_id, round(travel_speed_kmph, 3) AS travel_speed_kmph FROM {TRAVEL_SQL} ORDER BY travel_speed_kmph DESC, distance_km DESC, event_id LIMIT 5")
def fastest_trips(spark, sf_dir):
    rows = travelled(spark, sf_dir).orderBy(F.desc("travel_speed_kmph"), F.desc("distance_km"), "event_id").limit(5)
    return rows.select("event_id", "user_id", F.round("travel_speed_kmph", 3).alias("travel_speed_kmph"))


@query(
    "change_signal",
    "SELECT event_id, user_id, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def change_signal(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    return seq.change_signal(rows, "user_id", ["ts", "event_id"], "event_type", "changed").select("event_id", "user_id", "changed")


@query(
    "rolling_stats",
    """
    SELECT event_id, user_id, CASE WHEN count(value) OVER w >= 3 THEN round(sum(value) OVER w, 6) END AS rolling_sum,
           CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 6) END AS rolling_mean,
           CASE WHEN count(value) OVER w >= 3 THEN round(stddev_samp(value) OVER w, 6) END AS rolling_std
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
    """,
)
def rolling_stats(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    out = seq.rolling_stats(rows, "user_id", ["ts", "event_id"], "value", 10, 3)
    return out.select("event_id", "user_id", *[F.round(c, 6).alias(c) for c in ("rolling_sum", "rolling_mean", "rolling_std")])


NEW_FROM = "2024-01-21"


@query(
    "train_window",
    f"""
    WITH e AS (SELECT event_id, user_id, ts, ts >= TIMESTAMP '{NEW_FROM}' AS is_new,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS from_end FROM events),
    s AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE is_new) AS fresh FROM e GROUP BY 1)
    SELECT e.event_id, e.user_id FROM e JOIN s USING (user_id)
    WHERE n >= 60 AND fresh >= 20 AND from_end <= greatest(40, fresh)
    """,
)
def train_window(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).select("event_id", "user_id", "ts")
    new = F.col("ts") >= F.lit(NEW_FROM).cast("timestamp_ntz")
    return seq.training_window(rows, "user_id", "ts", "event_id", new, 60, 20, 40).select("event_id", "user_id")


@query(
    "train_window_duration",
    f"""
    WITH s AS (SELECT user_id, count(*) AS n, max(ts) AS latest, min(ts) FILTER (WHERE ts >= TIMESTAMP '{NEW_FROM}') AS first_new,
                 count(*) FILTER (WHERE ts >= TIMESTAMP '{NEW_FROM}') AS fresh FROM events GROUP BY 1)
    SELECT e.event_id, e.user_id FROM events e JOIN s USING (user_id)
    WHERE n >= 60 AND fresh >= 20 AND e.ts >= least(latest - INTERVAL 7 DAY, first_new)
    """,
)
def train_window_duration(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).select("event_id", "user_id", "ts")
    new = F.col("ts") >= F.lit(NEW_FROM).cast("timestamp_ntz")
    return seq.training_window(rows, "user_id", "ts", "event_id", new, 60, 20, "7 days").select("event_id", "user_id")


@query(
    "late_rows_guard",
    """
    WITH h AS (SELECT user_id, max(ts) AS mx, min(ts) AS mn FROM events WHERE event_type <> 'signup' GROUP BY 1),
    j AS (SELECT e.user_id, e.ts, mx, mn FROM events e LEFT JOIN h USING (user_id) WHERE event_type = 'signup'),
    c AS (SELECT user_id, count(*) FILTER (WHERE mx IS NULL OR ts > mx) AS accepted,
                 count(*) FILTER (WHERE ts <= mx) AS rejected, count(*) FILTER (WHERE ts < mn) AS before_history FROM j GROUP BY 1)
    SELECT *, accepted > 0 OR before_history = 0 AS success FROM c
    """,
)
def late_rows_guard(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).select("user_id", "ts", "event_type")
    return seq.batch_verdicts(rows.filter("event_type = 'signup'"), rows.filter("event_type <> 'signup'"), "user_id", "ts")


@query(
    "window_overlap",
    f"""
    SELECT user_id, count(*) AS incoming_rows, count(*) FILTER (WHERE {K_SQL} < 70) AS found_rows,
           count(*) = count(*) FILTER (WHERE {K_SQL} < 70) AS complete
    FROM events WHERE ts >= TIMESTAMP '{NEW_FROM}' GROUP BY 1
    """,
)
def window_overlap(spark, sf_dir):
    rows = keyed_events(spark, sf_dir)
    incoming = rows.filter(F.col("ts") >= F.lit(NEW_FROM).cast("timestamp_ntz"))
    return seq.window_overlap(rows.filter("k < 70"), incoming, "user_id", ["event_id", "user_id", "ts", "value"])


SNAPSHOT_SQL = "(SELECT user_id, CAST(epoch_us(date_trunc('day', ts)) // 86400000000 AS BIGINT) AS snapshot_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)"


@query(
    "consecutive_windows",
    f"""
    WITH s AS (SELECT *, lead(snapshot_id, 2) OVER w AS third, lead(n, 1) OVER w AS n1, lead(n, 2) OVER w AS n2,
                 lead(total, 1) OVER w AS t1, lead(total, 2) OVER w AS t2 FROM {SNAPSHOT_SQL}
               WINDOW w AS (PARTITION BY user_id ORDER BY snapshot_id))
    SELECT user_id, snapshot_id, CASE WHEN third - snapshot_id = 2 THEN snapshot_id || '-' || third ELSE 'dummy' END AS sequence,
           CASE WHEN third - snapshot_id = 2 THEN round(n + n1 + n2 + total + t1 + t2, 3) ELSE -6.0 END AS data_sum
    FROM s
    """,
)
def consecutive_windows(spark, sf_dir):
    day = F.floor(F.unix_micros(F.date_trunc("day", "ts").cast("timestamp")) / 86400000000)
    snapshots = keyed_events(spark, sf_dir).groupBy("user_id", day.alias("snapshot_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )
    out = seq.consecutive_windows(snapshots, ["user_id"], "snapshot_id", ["n", "total"], 3)
    total = F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 3)
    return out.select("user_id", "snapshot_id", "sequence", total.alias("data_sum"))


@query(
    "escalation",
    f"""
    WITH d AS (SELECT * FROM {DETECTIONS_SQL} WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recent FROM d),
    l AS (SELECT *, lag(score) OVER w AS ps, lag(ts) OVER w AS pt, lead(score) OVER w AS ns, lead(ts) OVER w AS nt
          FROM r WHERE recent <= 50 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    f AS (SELECT *, score > ps AND epoch_us(ts) - epoch_us(pt) <= 7200000000 AS up,
                    ns > score AND epoch_us(nt) - epoch_us(ts) <= 7200000000 AS next_up FROM l)
    SELECT event_id, user_id, CASE WHEN up THEN 'Score escalation' WHEN next_up THEN 'Escalation trigger' ELSE '' END AS significance,
           coalesce(round(CASE WHEN up THEN score - ps END, 4), 0) AS score_gain,
           coalesce(round(CASE WHEN up THEN (epoch_us(ts) - epoch_us(pt)) / 6e7 END, 2), 0) AS minutes FROM f
    """,
)
def escalation(spark, sf_dir):
    recent = detections(spark, sf_dir).filter(F.col("ts") >= as_of() - F.expr("interval 30 days"))
    recent = ordered.top_k(recent, ["user_id"], 50, F.desc("ts"), F.desc("event_id"))
    out = seq.escalations(recent, "user_id", "ts", "event_id", "score", 7200)
    return out.select(
        "event_id", "user_id", "significance",
        F.coalesce(F.round("score_gain", 4), F.lit(0.0)).alias("score_gain"),
        F.coalesce(F.round("minutes", 2), F.lit(0.0)).alias("minutes"),
    )


@query(
    "last_row_per_user",
    f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM {SCORED_SQL})
    SELECT event_id, user_id, ts, round(score, 6) AS score, CASE WHEN score > 2 THEN 'anomalies' ELSE 'clean' END AS stream
    FROM r WHERE rk = 1
    """,
)
def last_row_per_user(spark, sf_dir):
    last = seq.latest_per_key(scored(spark, sf_dir), ["user_id"], "ts", "event_id")
    return last.select(
        "event_id", "user_id", "ts", F.round("score", 6).alias("score"),
        F.when(F.col("score") > 2, "anomalies").otherwise("clean").alias("stream"),
    )


@query(
    "top_features",
    f"""
    WITH s AS (SELECT user_id, avg(value) AS mv, stddev_pop(value) AS sv, avg({K_SQL}) AS mk, stddev_pop({K_SQL}) AS sk,
                      avg(hour(ts)) AS mh, stddev_pop(hour(ts)) AS sh FROM events GROUP BY 1),
    z AS (SELECT e.event_id, e.user_id, abs((value - mv) / sv) AS zv, abs(({K_SQL} - mk) / sk) AS zk, abs((hour(ts) - mh) / sh) AS zh
          FROM events e JOIN s USING (user_id)),
    u AS (SELECT event_id, user_id, 'value' AS name, zv AS z FROM z UNION ALL SELECT event_id, user_id, 'k', zk FROM z
          UNION ALL SELECT event_id, user_id, 'hour', zh FROM z),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY z DESC, name DESC) AS rk FROM u),
    m AS (SELECT event_id, greatest(zv, zk, zh) AS max_abs_z, (zv + zk + zh) / 3 AS mean_abs_z FROM z)
    SELECT r.event_id, r.user_id, string_agg(name, ',' ORDER BY rk) AS names, round(max(max_abs_z), 5) AS max_abs_z,
           round(max(CASE WHEN mean_abs_z < 8 THEN mean_abs_z ELSE least(8 + 8 * log10(1 + mean_abs_z) / 15, 15.99) END), 4) AS anomaly_score
    FROM r JOIN m USING (event_id) WHERE rk <= 2 AND mean_abs_z > 1.5 GROUP BY 1, 2
    """,
)
def top_features(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).withColumn("hour", F.hour("ts"))
    names = ["value", "k", "hour"]
    stats = rows.groupBy("user_id").agg(
        *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]
    )
    joined = rows.join(stats, "user_id")
    z = {n: F.abs(F.try_divide(F.col(n) - F.col(f"m_{n}"), F.col(f"s_{n}"))) for n in names}
    out = joined.select(
        "event_id", "user_id",
        seq.top_features(z, {n: F.col(n) for n in names}, 2).alias("top"),
        F.greatest(*z.values()).alias("max_abs_z"),
        (sum(z.values()) / len(names)).alias("mean_abs_z"),
    ).filter("mean_abs_z > 1.5")
    return out.select(
        "event_id", "user_id", F.array_join("top.name", ",").alias("names"),
        F.round("max_abs_z", 5).alias("max_abs_z"),
        risk.compress_score(F.col("mean_abs_z")).alias("anomaly_score"),
    )
