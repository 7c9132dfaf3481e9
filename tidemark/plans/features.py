"""Feature schemas, increments, filters and row-level scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import risk
from tidemark.operators import filters, ordered, schema as sc, users
from tidemark.plans.base import (
    DETECTIONS_SQL,
    K_SQL,
    SCORED_SQL,
    detections,
    events,
    keyed_events,
    scored,
    with_baseline,
)
from tidemark.registry import query
from tidemark.session import scratch_dir


@query(
    "schema_select",
    f"""
    SELECT event_id, user_id AS user_name, event_type IN ('purchase') AS bought,
           event_type AS kind, ts AS time, array_to_string(string_split(event_type, ''), '-') AS spelled,
           user_id || '|' || event_type || '|nan' AS joined, CAST(NULL AS VARCHAR) AS city,
           value * 2 AS doubled
    FROM events WHERE value > 10
    """,
)
def schema_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = sc.FeatureSchema(
        [
            sc.Rename("user_name", "int", "user_id"),
            sc.Bool("bought", "event_type", ["purchase"], ["click", "view", "error", "signup"]),
            sc.Rename("kind", "str", "event_type"),
            sc.DateTime("time", "ts"),
            sc.StringJoin("spelled", "event_type", "-"),
            sc.StringCat("joined", ["user_id", "event_type", "absent"], "|"),
            sc.Plain("city", "str"),
            sc.Derived("doubled", "float", lambda df: F.col("value") * 2),
        ],
        preserve=["^event_id$"],
        row_filter=lambda df: F.col("doubled") > 20,
    )
    return spec.apply(events(spark, sf_dir))


@query("json_flatten", f"SELECT event_id, {K_SQL} AS props_k, CAST(NULL AS VARCHAR) AS props_city FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = sc.flatten_json(events(spark, sf_dir), {"props": "k BIGINT, city STRING"})
    return flat.select("event_id", F.col("`props.k`").alias("props_k"), F.col("`props.city`").alias("props_city"))


GAPS_SQL = f"""
    SELECT event_id, user_id, ts,
           CASE WHEN {K_SQL} < 20 THEN NULL ELSE value END AS amount,
           CASE WHEN {K_SQL} > 80 THEN NULL ELSE event_type END AS kind,
           CASE WHEN {K_SQL} BETWEEN 40 AND 50 THEN NULL ELSE {K_SQL} > 60 END AS flag,
           CASE WHEN {K_SQL} BETWEEN 50 AND 70 THEN NULL ELSE ts END AS seen_at
    FROM events"""


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return keyed_events(spark, sf_dir).select(
        "event_id", "user_id", "ts",
        F.when(k >= 20, F.col("value")).alias("amount"),
        F.when(k <= 80, F.col("event_type")).alias("kind"),
        F.when(~k.between(40, 50), k > 60).alias("flag"),
        F.when(~k.between(50, 70), F.col("ts")).alias("seen_at"),
    )


@query(
    "missing_policy",
    f"""
    WITH g AS ({GAPS_SQL})
    SELECT event_id, user_id, ts, coalesce(amount, 0) AS amount, coalesce(kind, 'unknown') AS kind,
           coalesce(flag, false) AS flag,
           coalesce(last_value(seen_at IGNORE NULLS) OVER
                      (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    first_value(seen_at IGNORE NULLS) OVER
                      (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
           ) AS seen_at
    FROM g
    """,
)
def missing_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.missing_values(with_gaps(spark, sf_dir), "fill", ["user_id"], ["ts", "event_id"])


@query("missing_drop", f"SELECT * FROM ({GAPS_SQL}) WHERE amount IS NOT NULL AND kind IS NOT NULL AND flag IS NOT NULL AND seen_at IS NOT NULL")
def missing_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.missing_values(with_gaps(spark, sf_dir), "drop")


@query("drop_null", f"SELECT * FROM ({GAPS_SQL}) WHERE kind IS NOT NULL")
def drop_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_gaps(spark, sf_dir).na.drop(subset=["kind"])


@query("regex_projection", "SELECT event_id, event_type, value FROM events")
def regex_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("ID", F.col("event_id")).withColumn("_ts_in", F.col("ts"))
    return sc.regex_select(df, include=["^event", "^value$", "^ID$", "^_ts_"])


@query(
    "ensured_columns",
    "SELECT event_id AS _event_id, value, 0 AS logcount, event_type FROM events",
)
def ensured_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumnRenamed("event_id", "_event_id")
    return sc.ensure_columns(df, ["value", "logcount", "event_type", "_event_id"])


@query(
    "truncated_text",
    """
    WITH b AS (SELECT doc_id, text, encode(text) AS raw FROM documents),
    cut AS (
      SELECT doc_id, text, raw,
        CASE WHEN octet_length(raw) <= 101 THEN NULL
             WHEN substr(hex(raw), 101*2+1, 1) NOT IN ('8','9','A','B') THEN 101
             WHEN substr(hex(raw), 100*2+1, 1) NOT IN ('8','9','A','B') THEN 100
             WHEN substr(hex(raw), 99*2+1, 1) NOT IN ('8','9','A','B') THEN 99
             ELSE 98 END AS keep FROM b)
    SELECT doc_id, CASE WHEN keep IS NULL THEN text ELSE decode(unhex(substr(hex(raw), 1, keep*2))) END AS head
    FROM cut
    """,
)
def truncated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.session import table

    return table(spark, sf_dir, "documents").select(
        "doc_id", sc.truncate_bytes(F.col("text"), 101).alias("head")
    )


@query("router_counts", "SELECT CASE WHEN event_type IN ('error') THEN 'alerts' WHEN event_type IN ('click','view') THEN 'browsing' ELSE 'account' END AS route, count(*) AS n FROM events GROUP BY 1")
def router_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = {"error": "alerts", "click": "browsing", "view": "browsing", "purchase": "account", "signup": "account"}
    return filters.routed(events(spark, sf_dir), F.col("event_type"), routes).groupBy("route").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "logcount",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) - 1 AS logcount FROM events",
)
def logcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sc.add_increment(
        events(spark, sf_dir).select("event_id", "user_id", "ts"),
        sc.Increment("logcount", "user_id", "ts"), "event_id",
    )
    return df.select("event_id", "user_id", "logcount")


@query(
    "distinct_increment",
    f"""
    WITH e AS (SELECT event_id, user_id, ts, date_trunc('day', ts) AS d,
                 coalesce(CASE WHEN {K_SQL} < 90 THEN event_type END, 'nan') AS v FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, d, v ORDER BY ts, event_id) = 1 AS is_new FROM e)
    SELECT event_id, user_id, CAST(sum(CASE WHEN is_new THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id, d ORDER BY ts, event_id) AS BIGINT) AS appincrement FROM f
    """,
)
def distinct_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = keyed_events(spark, sf_dir).select(
        "event_id", "user_id", "ts", F.when(F.col("k") < 90, F.col("event_type")).alias("app")
    )
    spec = sc.DistinctIncrement("appincrement", "app", "user_id", "ts")
    return sc.add_increment(df, spec, "event_id").select("event_id", "user_id", "appincrement")


#: A feature file as users write it; the query below stores it and builds its schema from there.
FEATURE_FILE = """
model_features:
  default: [appDisplayName, location]
  travel: [appDisplayName, category, travel_speed_kmph, is_weekend, logcount, locincrement, appincrement]
categorical_features:
  category: {enabled: false}
behavioral_features:
  logcount: {params: {groupby_column: username}}
  locincrement: {params: {input_name: location, groupby_column: username, timestamp_column: timestamp}}
  appincrement: {params: {input_name: appDisplayName, period: week}}
"""


@query(
    "feature_file_schema",
    f"""
    WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS u, ts, date_trunc('day', ts) AS d, date_trunc('week', ts) AS w,
                 event_type AS app, CAST({K_SQL} AS VARCHAR) AS loc, value FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY u, w, app ORDER BY ts, event_id) = 1 AS new_app,
                 row_number() OVER (PARTITION BY u, d, loc ORDER BY ts, event_id) = 1 AS new_loc FROM e)
    SELECT ts AS timestamp, u AS username, app AS "appDisplayName", value AS "location_geoCoordinates_latitude",
           CAST(NULL AS DOUBLE) AS "location_geoCoordinates_longitude", value * 2 AS travel_speed_kmph, dayofweek(ts) IN (0, 6) AS is_weekend,
           loc AS location, row_number() OVER (PARTITION BY u, d ORDER BY ts, event_id) - 1 AS logcount,
           CAST(sum(CASE WHEN new_loc THEN 1 ELSE 0 END) OVER (PARTITION BY u, d ORDER BY ts, event_id) AS BIGINT) AS locincrement,
           CAST(sum(CASE WHEN new_app THEN 1 ELSE 0 END) OVER (PARTITION BY u, w ORDER BY ts, event_id) AS BIGINT) AS appincrement,
           event_id AS _row FROM f
    """,
)
def feature_file_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature set read from a stored file: selected columns, what they need, and counters by day and week."""
    path = f"{scratch_dir(spark, 'features')}/features.yaml"
    spark.createDataFrame([(FEATURE_FILE,)], "value string").coalesce(1).write.text(path)
    rows = keyed_events(spark, sf_dir).select(
        F.col("event_id").alias("_row"), F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("username"),
        F.col("event_type").alias("appDisplayName"), F.col("event_type").alias("category"), F.col("k").cast("string").alias("location"),
        F.col("value").alias("location_geoCoordinates_latitude"), (F.col("value") * 2).alias("travel_speed_kmph"),
        F.dayofweek("ts").isin(1, 7).alias("is_weekend"),
    )
    return sc.from_file(spark, path, "travel", row_id="_row", preserve=["_row"]).apply(rows)


@query(
    "day_increments",
    f"""
    WITH e AS (SELECT event_id, user_id, ts, date_trunc('day', ts) AS d, event_type, {K_SQL} AS k FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, d, event_type ORDER BY ts, event_id) = 1 AS new_app,
                 row_number() OVER (PARTITION BY user_id, d, k ORDER BY ts, event_id) = 1 AS new_loc FROM e)
    SELECT event_id, user_id,
           row_number() OVER w - 1 AS logcount,
           CAST(sum(CASE WHEN new_loc THEN 1 ELSE 0 END) OVER w AS BIGINT) AS locincrement,
           CAST(sum(CASE WHEN new_app THEN 1 ELSE 0 END) OVER w AS BIGINT) AS appincrement
    FROM f WINDOW w AS (PARTITION BY user_id, d ORDER BY ts, event_id)
    """,
)
def day_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = sc.FeatureSchema(
        [
            sc.Plain("event_id", "int"),
            sc.Plain("user_id", "int"),
            sc.Increment("logcount", "user_id", "ts"),
            sc.DistinctIncrement("locincrement", "k", "user_id", "ts"),
            sc.DistinctIncrement("appincrement", "event_type", "user_id", "ts"),
        ],
        row_id="event_id",
    )
    return spec.apply(keyed_events(spark, sf_dir))


@query(
    "generic_split",
    """
    WITH s AS (SELECT CAST(user_id AS VARCHAR) AS split_user, ts, event_id, value FROM events
               UNION ALL SELECT 'generic_user', ts, event_id, value FROM events)
    SELECT split_user, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(value), 6) AS mean_value
    FROM s GROUP BY 1
    """,
)
def generic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = users.split_users(events(spark, sf_dir), "user_id")
    return rows.groupBy("split_user").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.round(F.avg("value"), 6).alias("mean_value"),
    )


@query(
    "user_row_index",
    """
    WITH s AS (SELECT CAST(user_id AS VARCHAR) AS split_user, ts, event_id FROM events
               UNION ALL SELECT 'generic_user', ts, event_id FROM events)
    SELECT split_user, event_id, row_number() OVER (PARTITION BY split_user ORDER BY ts, event_id) - 1 AS row_index FROM s
    """,
)
def user_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = users.split_users(events(spark, sf_dir).select("event_id", "user_id", "ts"), "user_id")
    return ordered.row_index(rows, ["split_user"], ["ts", "event_id"], "row_index").select(
        "split_user", "event_id", "row_index"
    )


@query(
    "rows_per_user",
    "SELECT min(n) AS min_rows, max(n) AS max_rows, round(avg(n), 6) AS avg_rows, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)",
)
def rows_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.rows_per_key(events(spark, sf_dir), "user_id")


@query("group_split", "SELECT event_type, event_id, value FROM events")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.grouped_rows(
        events(spark, sf_dir).select("event_type", "event_id", "value"), "event_type", "event_id"
    )


@query("listed_users", "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 300) GROUP BY 1")
def listed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    skip = df.groupBy("user_id").agg(F.max("value").alias("top")).filter("top > 300").select("user_id")
    return users.without(df, skip, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("threshold_filter", "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE value > 100")
def threshold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.over_threshold(events(spark, sf_dir), ["value"], 100.0).select(
        "event_id", "user_id", F.round("value", 6).alias("value")
    )


@query(
    "any_over_threshold",
    "SELECT vec_id, label FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3)) > 0",
)
def any_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.session import table

    return filters.any_element_over(table(spark, sf_dir, "embeddings"), "embedding", 0.3).select("vec_id", "label")


@query(
    "contiguous_runs",
    """
    WITH h AS (SELECT user_id, event_id, ts, value > 50 AS hit,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    g AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM h WHERE hit)
    SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n,
           min(rn) - 1 AS start_row, max(rn) AS stop_row
    FROM g GROUP BY user_id, island
    """,
)
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).select("user_id", "event_id", "ts", "value")
    return filters.contiguous_runs(df, ["user_id"], ["ts", "event_id"], F.col("value") > 50).groupBy(
        "user_id", "run"
    ).agg(
        F.min("event_id").alias("first_event"),
        F.max("event_id").alias("last_event"),
        F.count(F.lit(1)).alias("n"),
        F.min("row_index").alias("start_row"),
        (F.max("row_index") + 1).alias("stop_row"),
    ).drop("run")


@query(
    "detection_rate",
    f"""
    SELECT 'zscore' AS anomaly_source, count(*) AS total, count(*) FILTER (WHERE score > 2) AS detections,
           round(100.0 * count(*) FILTER (WHERE score > 2) / count(*), 4) AS detection_rate,
           round(max(score), 6) AS max_score, round(avg(score) FILTER (WHERE score > 2), 6) AS mean_detected
    FROM {SCORED_SQL}
    """,
)
def detection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.detection_summary(scored(spark, sf_dir), "score", 2.0, "zscore")


@query("severity_bands", f"SELECT severity, count(*) AS n, round(min(score), 6) AS lowest, round(max(score), 6) AS highest FROM {SCORED_SQL} GROUP BY 1")
def severity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.min("score"), 6).alias("lowest"),
        F.round(F.max("score"), 6).alias("highest"),
    )


@query(
    "score_compress",
    "SELECT event_id, round(CASE WHEN value < 8 THEN value ELSE least(8 + 8 * log10(1 + value) / 15, 15.99) END, 4) AS compressed FROM events",
)
def score_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", risk.compress_score(F.col("value")).alias("compressed"))


@query(
    "postprocessed_scores",
    f"""
    SELECT event_id, user_id, '1.0' AS model_version, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS event_time,
           CASE WHEN k = 0 THEN 'NaN' ELSE CAST(round(z, 4) AS VARCHAR) END AS z_text
    FROM {DETECTIONS_SQL}
    """,
)
def postprocessed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.when(F.col("k") == 0, F.lit(float("nan"))).otherwise(F.round("z", 4))
    df = detections(spark, sf_dir).withColumn("z_text", ratio)
    return filters.postprocess(df, "ts", ["z_text"], "1.0").select(
        "event_id", "user_id", "model_version", "event_time", "z_text"
    )


@query(
    "rounded_times",
    "SELECT event_id, date_trunc('second', ts) AS second_ts, date_trunc('hour', ts) AS hour_ts, CAST(round(epoch_us(ts) / 1000000.0) AS BIGINT) AS rounded_sec FROM events",
)
def rounded_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_id",
        F.date_trunc("second", "ts").alias("second_ts"),
        F.date_trunc("hour", "ts").alias("hour_ts"),
        F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).cast("bigint").alias("rounded_sec"),
    )


@query(
    "user_payload_batches",
    """
    WITH r AS (SELECT event_type, date_trunc('day', ts) AS period,
                 row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) - 1 AS i, value FROM events)
    SELECT event_type, period, i // 25 AS batch, count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY 1, 2, 3
    """,
)
def user_payload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources import batches

    df = batches.payload_batches(
        events(spark, sf_dir).select("event_type", "ts", "event_id", "value"),
        ["ts", "event_id"], 25, group_by=["event_type"], timestamp="ts", period="day",
    )
    return df.groupBy("event_type", "period", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("global_row_ids", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events")
def global_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.row_index(events(spark, sf_dir).select("event_id", "ts"), [], ["ts", "event_id"], "row_id").select(
        "event_id", "row_id"
    )


@query(
    "replayed_events",
    """
    WITH span AS (SELECT max(ts) - min(ts) AS w FROM events)
    SELECT e.event_id, r.i AS replay, e.ts + w * r.i AS ts FROM events e, span, (SELECT unnest(range(3)) AS i) r
    """,
)
def replayed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources import batches

    return batches.replay(events(spark, sf_dir).select("event_id", "ts"), "ts", 3)


@query(
    "min_slice",
    f"""
    WITH e AS (SELECT event_id, user_id, ts, date_trunc('day', ts) AS d, event_type FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, d, event_type ORDER BY ts, event_id) = 1 AS is_new FROM e),
    g AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, d ORDER BY ts, event_id) - 1 AS logcount,
                 CAST(sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, d ORDER BY ts, event_id) AS BIGINT) AS appincrement FROM f)
    SELECT user_id, count(*) AS anomalies, max(s.ts) AS last_seen, round(avg(score), 6) AS avg_score,
           count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
           max(logcount) AS max_logcount, max(appincrement) AS max_appincrement
    FROM {SCORED_SQL} s JOIN g ON s.event_id = g.event_id WHERE score > 2
    GROUP BY user_id ORDER BY anomalies DESC, user_id LIMIT 10
    """,
)
def min_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increments, per-user z-score, threshold, severity and the most anomalous users."""
    increments = [
        sc.Increment("logcount", "user_id", "ts"),
        sc.DistinctIncrement("appincrement", "event_type", "user_id", "ts"),
    ]
    df = sc.add_increments(events(spark, sf_dir).drop("props"), increments, "event_id")
    scored_rows = with_baseline(df, ["user_id"], "value").withColumn("score", F.abs("z"))
    hits = scored_rows.filter("score > 2").withColumn("severity", risk.severity(F.col("score")))
    return (
        hits.groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("anomalies"),
            F.max("ts").alias("last_seen"),
            F.round(F.avg("score"), 6).alias("avg_score"),
            F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
            F.max("logcount").alias("max_logcount"),
            F.max("appincrement").alias("max_appincrement"),
        )
        .orderBy(F.desc("anomalies"), "user_id")
        .limit(10)
    )
