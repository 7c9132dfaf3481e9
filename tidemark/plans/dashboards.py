"""Dashboard-style questions over detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dashboards as dash
from tidemark.plans.base import AS_OF, DETECTIONS_SQL, as_of, detections, events
from tidemark.registry import query
from tidemark.session import table

ANOMALIES_SQL = f"""(
  SELECT event_id AS anomaly_id, user_id, ts, score AS anomaly_score, severity, event_type AS root_cause,
         'k' || CAST(k // 10 AS VARCHAR) AS sub_category, least(score * 15, 100) AS risk_score,
         CASE WHEN k < 40 THEN 'new' WHEN k < 70 THEN 'pending' ELSE 'resolved' END AS status,
         CASE WHEN k >= 10 THEN score >= 2.5 END AS is_anomaly,
         CASE WHEN score < 2.5 AND k >= 70 THEN 'false_positive' END AS verdict
  FROM {DETECTIONS_SQL} q)"""
INVESTIGATIONS_SQL = """(
  SELECT o_orderkey AS investigation_id, o_custkey AS anomaly_id, o_orderdate AS triggered_at,
         CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
         o_totalprice / 500000 AS confidence_score, f.completed_at
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS completed_at FROM lineitem GROUP BY 1) f
    ON f.l_orderkey = o_orderkey)"""
SEVERITIES_SQL = """
  count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count, count(*) FILTER (WHERE severity = 'HIGH') AS high_count,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_count, count(*) FILTER (WHERE severity = 'LOW') AS low_count"""
NOW_SQL = f"TIMESTAMP '{AS_OF}'"


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, k = F.col("score"), F.col("k")
    return detections(spark, sf_dir).select(
        F.col("event_id").alias("anomaly_id"),
        "user_id",
        "ts",
        score.alias("anomaly_score"),
        "severity",
        F.col("event_type").alias("root_cause"),
        F.concat(F.lit("k"), F.floor(k / 10).cast("string")).alias("sub_category"),
        F.least(score * 15, F.lit(100.0)).alias("risk_score"),
        F.when(k < 40, "new").when(k < 70, "pending").otherwise("resolved").alias("status"),
        F.when(k >= 10, score >= 2.5).alias("is_anomaly"),
        F.when((score < 2.5) & (k >= 70), "false_positive").alias("verdict"),
    )


def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("completed_at"))
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "failed")
    return orders.join(shipped, orders["o_orderkey"] == shipped["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("investigation_id"),
        F.col("o_custkey").alias("anomaly_id"),
        F.col("o_orderdate").alias("triggered_at"),
        status.otherwise("pending").alias("status"),
        (F.col("o_totalprice") / 500000).alias("confidence_score"),
        "completed_at",
    )


@query(
    "kpi_row",
    f"""
    SELECT (SELECT count(*) FROM customer) AS total_users, (SELECT count(*) FROM events) + count(*) AS total_events,
           count(*) AS total_anomalies, count(DISTINCT user_id) AS active_users,
           count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_anomalies,
           count(*) FILTER (WHERE severity = 'HIGH') AS high_anomalies,
           count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_anomalies,
           count(*) FILTER (WHERE severity = 'LOW') AS low_anomalies,
           round(coalesce(avg(anomaly_score), 0), 4) AS avg_anomaly_score,
           count(*) FILTER (WHERE status = 'new') AS new_anomalies,
           count(*) FILTER (WHERE status = 'resolved') AS resolved_anomalies,
           count(*) FILTER (WHERE status = 'pending') AS pending_anomalies
    FROM {ANOMALIES_SQL}
    """,
)
def kpi_row(spark, sf_dir):
    return dash.kpi_row(anomalies(spark, sf_dir), table(spark, sf_dir, "customer"), events(spark, sf_dir))


@query("risk_distribution", f"SELECT lower(severity) AS severity, count(*) AS n FROM {ANOMALIES_SQL} GROUP BY 1")
def risk_distribution(spark, sf_dir):
    return dash.risk_distribution(anomalies(spark, sf_dir))


@query(
    "top_users",
    f"""
    WITH a AS (SELECT * FROM {ANOMALIES_SQL}),
    u AS (SELECT c_custkey, c_name, count(*) AS anomaly_count, max(ts) AS last_anomaly_at,
                 round(avg(anomaly_score), 4) AS avg_anomaly_score,
                 count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count
          FROM customer JOIN a ON a.user_id = c_custkey GROUP BY 1, 2 ORDER BY anomaly_count DESC, c_custkey LIMIT 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY anomaly_score DESC, anomaly_id) AS rk FROM a)
    SELECT u.c_name, u.anomaly_count, u.last_anomaly_at, u.avg_anomaly_score, u.critical_count,
           string_agg(r.anomaly_id || ':' || lower(r.severity), ',' ORDER BY r.rk) AS top_anomalies
    FROM u JOIN r ON r.user_id = u.c_custkey AND r.rk <= 10 GROUP BY 1, 2, 3, 4, 5
    """,
)
def top_users(spark, sf_dir):
    ranked = dash.top_users(table(spark, sf_dir, "customer"), anomalies(spark, sf_dir), "c_custkey")
    text = F.array_join(
        F.transform("top_anomalies", lambda a: F.concat_ws(":", a["anomaly_id"].cast("string"), a["severity"])), ","
    )
    return ranked.select(
        "c_name", "anomaly_count", "last_anomaly_at", "avg_anomaly_score", "critical_count",
        text.alias("top_anomalies"),
    )


@query(
    "user_metrics",
    f"""
    WITH a AS (SELECT * FROM {ANOMALIES_SQL}),
    g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, anomaly_id))) / 3.6e9 AS h FROM a),
    n AS (SELECT count(*) AS users FROM customer)
    SELECT round(count(DISTINCT user_id) * 100.0 / max(users), 1) AS exposure_rate,
           round(count(DISTINCT CASE WHEN severity = 'CRITICAL' THEN user_id END) * 100.0 / max(users), 1) AS critical_ratio,
           round(avg(anomaly_score), 4) AS avg_risk_score,
           round(count(*) FILTER (WHERE status = 'resolved') * 100.0 / count(*), 1) AS resolution_rate,
           (SELECT round(avg(h), 2) FROM g) AS mtba_hours
    FROM a, n
    """,
)
def user_metrics(spark, sf_dir):
    return dash.user_metrics(anomalies(spark, sf_dir), table(spark, sf_dir, "customer"))


@query(
    "mean_time_between",
    f"""
    SELECT user_id, count(h) AS gaps, round(avg(h), 4) AS mean_hours FROM (
      SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, anomaly_id))) / 3.6e9 AS h
      FROM {ANOMALIES_SQL}) GROUP BY user_id HAVING count(h) > 0
    """,
)
def mean_time_between(spark, sf_dir):
    gaps = dash.time_between(anomalies(spark, sf_dir)).filter("hours_between is not null")
    return gaps.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("gaps"), F.round(F.avg("hours_between"), 4).alias("mean_hours")
    )


@query(
    "heatmap_daily",
    f"""
    SELECT CAST(ts AS DATE) AS date, count(*) AS count, round(max(anomaly_score), 2) AS max_score,
           count(*) FILTER (WHERE status = 'resolved') AS confirmed_count,
           count(*) FILTER (WHERE verdict = 'false_positive') AS false_positive_count,
           count(*) FILTER (WHERE status = 'new') AS new_count
    FROM {ANOMALIES_SQL} WHERE ts >= {NOW_SQL} - INTERVAL 119 DAY GROUP BY 1
    """,
)
def heatmap_daily(spark, sf_dir):
    return dash.heatmap_daily(anomalies(spark, sf_dir), as_of())


@query(
    "category_ranking",
    f"""
    SELECT root_cause, count(*) AS anomaly_count, count(DISTINCT user_id) AS affected_users,
           round(avg(anomaly_score), 4) AS avg_anomaly_score, round(avg(risk_score), 4) AS avg_risk_score,
           {SEVERITIES_SQL}, max(ts) AS last_seen_at
    FROM {ANOMALIES_SQL} GROUP BY 1 ORDER BY anomaly_count DESC, root_cause LIMIT 5
    """,
)
def category_ranking(spark, sf_dir):
    return dash.root_cause_ranking(anomalies(spark, sf_dir))


@query(
    "maturity",
    f"""
    WITH c AS (SELECT count(*) FILTER (WHERE status = 'resolved') AS resilient,
        count(*) FILTER (WHERE status = 'pending' OR (status = 'new' AND severity IN ('LOW', 'MEDIUM'))) AS managed,
        count(*) FILTER (WHERE status = 'new' AND severity IN ('HIGH', 'CRITICAL')) AS exposed, count(*) AS total
      FROM {ANOMALIES_SQL}),
    s AS (SELECT *, round((resilient * 100.0 + managed * 65 + exposed * 20) / total, 1) AS score FROM c)
    SELECT *, CASE WHEN score >= 80 THEN 'Resilient' WHEN score >= 55 THEN 'Managed' WHEN score >= 30 THEN 'Developing' ELSE 'Exposed' END AS level,
      round(resilient * 100.0 / total, 1) AS resilient_pct, round(managed * 100.0 / total, 1) AS managed_pct,
      round(exposed * 100.0 / total, 1) AS exposed_pct FROM s
    """,
)
def maturity(spark, sf_dir):
    return dash.maturity(anomalies(spark, sf_dir))


@query(
    "trend_7d",
    f"""
    WITH c AS (SELECT lower(severity) AS severity, count(*) FILTER (WHERE ts >= {NOW_SQL} - INTERVAL 7 DAY) AS current,
        count(*) FILTER (WHERE ts < {NOW_SQL} - INTERVAL 7 DAY) AS previous
      FROM {ANOMALIES_SQL} WHERE ts >= {NOW_SQL} - INTERVAL 14 DAY GROUP BY 1)
    SELECT *, CASE WHEN previous = 0 THEN CASE WHEN current > 0 THEN 100.0 ELSE 0.0 END
      ELSE round((current - previous) * 100.0 / previous, 1) END AS delta_pct FROM c
    """,
)
def trend_7d(spark, sf_dir):
    return dash.week_trend(anomalies(spark, sf_dir), as_of())


@query(
    "completion_trend",
    f"""
    SELECT CAST(triggered_at AS DATE) AS day, count(*) AS triggered, count(*) FILTER (WHERE status = 'complete') AS completed,
           count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending,
           round(count(*) FILTER (WHERE status = 'complete') * 100.0 / count(*), 1) AS completion_rate,
           round(avg(confidence_score), 3) AS avg_confidence,
           round(avg((epoch_us(completed_at) - epoch_us(triggered_at)) / 3.6e9), 4) AS avg_duration_hours
    FROM {INVESTIGATIONS_SQL} GROUP BY 1
    """,
)
def completion_trend(spark, sf_dir):
    return dash.completion_trend(investigations(spark, sf_dir))


@query(
    "rhythm",
    f"""
    SELECT isodow(ts) - 1 AS dow, hour(ts) AS hour, count(*) AS total_count, round(avg(anomaly_score), 2) AS avg_score
    FROM {ANOMALIES_SQL} WHERE ts >= {NOW_SQL} - INTERVAL 90 DAY GROUP BY 1, 2
    """,
)
def rhythm(spark, sf_dir):
    return dash.rhythm(anomalies(spark, sf_dir), as_of())


@query(
    "platform_counts",
    f"""
    SELECT (SELECT count(*) FROM customer) AS monitored_users, count(*) AS total_detections,
           count(*) FILTER (WHERE is_anomaly) AS true_positives, count(is_anomaly) AS labeled_records,
           count(DISTINCT root_cause) AS root_cause_count,
           count(DISTINCT user_id) FILTER (WHERE is_anomaly) AS users_with_anomalies,
           (SELECT count(*) FROM orders) AS total_investigations,
           (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS completed_investigations,
           (SELECT count(*) FROM lineitem) AS total_findings
    FROM {ANOMALIES_SQL}
    """,
)
def platform_counts(spark, sf_dir):
    return dash.platform_counts(
        table(spark, sf_dir, "customer"), anomalies(spark, sf_dir),
        table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "complete").alias("status")),
        table(spark, sf_dir, "lineitem"),
    )


@query("user_trend", f"SELECT user_id, CAST(ts AS DATE) AS bucket, count(*) AS count, round(avg(anomaly_score), 2) AS avg_score FROM {ANOMALIES_SQL} GROUP BY 1, 2")
def user_trend(spark, sf_dir):
    return dash.user_trend(anomalies(spark, sf_dir), as_of())


@query(
    "facets",
    f"""
    SELECT 'root_cause' AS facet, root_cause AS value, count(*) AS n FROM {ANOMALIES_SQL} WHERE sub_category IN ('k1', 'k2', 'k3') GROUP BY 2
    UNION ALL SELECT 'sub_category', sub_category, count(*) FROM {ANOMALIES_SQL} WHERE root_cause IN ('error', 'click') GROUP BY 2
    """,
)
def facets(spark, sf_dir):
    return dash.facets(
        anomalies(spark, sf_dir), ["root_cause", "sub_category"],
        {"sub_category": F.col("sub_category").isin("k1", "k2", "k3"), "root_cause": F.col("root_cause").isin("error", "click")},
    )


TIMELINE_SQL = f"""
    SELECT CAST(date_trunc('week', ts) AS DATE) AS period, count(*) AS anomaly_count, round(avg(risk_score), 2) AS avg_risk_score,
           round(max(risk_score), 2) AS max_risk_score, {SEVERITIES_SQL}, count(DISTINCT user_id) AS unique_users_affected
    FROM {ANOMALIES_SQL} WHERE ts >= {NOW_SQL} - INTERVAL 30 DAY GROUP BY 1 ORDER BY 1 DESC LIMIT 60"""


@query("timeline", TIMELINE_SQL)
def timeline(spark, sf_dir):
    return dash.timeline(anomalies(spark, sf_dir), as_of(), 30, "week")


@query(
    "timeline_direction",
    f"""
    WITH p AS ({TIMELINE_SQL.replace("'week'", "'day'")}),
    r AS (SELECT *, row_number() OVER (ORDER BY period DESC) AS rk, count(*) OVER () AS n FROM p),
    h AS (SELECT max(n) AS n, sum(anomaly_count) FILTER (WHERE rk <= n // 2) / max(n // 2) AS newer,
                 sum(anomaly_count) FILTER (WHERE rk > n // 2) / max(n - n // 2) AS older FROM r)
    SELECT CASE WHEN n < 4 THEN 'stable' WHEN newer > older * 1.2 THEN 'increasing'
                WHEN newer < older * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM h
    """,
)
def timeline_direction(spark, sf_dir):
    return dash.timeline_direction(dash.timeline(anomalies(spark, sf_dir), as_of(), 30))


@query(
    "dimension_ranking",
    f"""
    SELECT sub_category AS dimension_value, count(*) AS anomaly_count, round(max(risk_score), 2) AS max_risk_score,
           round(avg(risk_score), 2) AS avg_risk_score, {SEVERITIES_SQL},
           array_to_string(list_sort(list(DISTINCT user_id)), ',') AS affected_users
    FROM {ANOMALIES_SQL} GROUP BY 1 ORDER BY max_risk_score DESC, anomaly_count DESC, 1 LIMIT 10
    """,
)
def dimension_ranking(spark, sf_dir):
    out = dash.dimension_ranking(anomalies(spark, sf_dir), "sub_category")
    return out.withColumn("affected_users", F.array_join("affected_users", ","))


@query(
    "risk_summary",
    f"""
    SELECT CASE WHEN grouping(user_id, day) = 3 THEN 'total' WHEN grouping(user_id, day) = 1 THEN 'user' ELSE 'day' END AS scope,
           coalesce(user_id, -1) AS user_id, day, count(*) AS anomaly_count, {SEVERITIES_SQL},
           round(avg(risk_score), 2) AS avg_risk_score, round(max(risk_score), 2) AS max_risk_score
    FROM (SELECT *, CAST(ts AS DATE) AS day FROM {ANOMALIES_SQL}) GROUP BY GROUPING SETS ((), (user_id), (day))
    """,
)
def risk_summary(spark, sf_dir):
    out = dash.risk_summary(anomalies(spark, sf_dir), as_of())
    return out.withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


@query(
    "cause_summary",
    f"""
    SELECT 'root_cause' AS kind, root_cause AS name, count(*) AS n, round(avg(risk_score), 2) AS avg_risk_score
    FROM {ANOMALIES_SQL} WHERE ts >= {NOW_SQL} - INTERVAL 20 DAY GROUP BY 2
    UNION ALL SELECT 'sub_category', sub_category, count(*), round(avg(risk_score), 2)
    FROM {ANOMALIES_SQL} WHERE ts >= {NOW_SQL} - INTERVAL 20 DAY GROUP BY 2
    """,
)
def cause_summary(spark, sf_dir):
    return dash.cause_summary(anomalies(spark, sf_dir), as_of(), 20)


@query(
    "score_stats",
    f"""
    SELECT count(*) AS n, round(avg(anomaly_score), 4) AS mean_score, round(stddev_samp(anomaly_score), 4) AS std_score,
           round(min(anomaly_score), 4) AS min_score, round(max(anomaly_score), 4) AS max_score,
           round(quantile_cont(anomaly_score, 0.5), 4) AS median_score FROM {ANOMALIES_SQL}
    """,
)
def score_stats(spark, sf_dir):
    return dash.score_stats(anomalies(spark, sf_dir))


@query("coverage", f"SELECT count(*) AS total, count(is_anomaly) AS with_is_anomaly, count(verdict) AS with_verdict, count(root_cause) AS with_root_cause FROM {ANOMALIES_SQL}")
def coverage(spark, sf_dir):
    return dash.coverage(anomalies(spark, sf_dir), ["is_anomaly", "verdict", "root_cause"])


@query("hourly_rollup", f"SELECT date_trunc('hour', ts) AS bucket, user_id, count(*) AS n, round(avg(anomaly_score), 4) AS avg_value, round(max(anomaly_score), 4) AS max_value FROM {ANOMALIES_SQL} GROUP BY 1, 2")
def hourly_rollup(spark, sf_dir):
    return dash.rollup(anomalies(spark, sf_dir), ["user_id"], "1 hour", "anomaly_score")


@query("daily_rollup", f"SELECT date_trunc('day', ts) AS bucket, user_id, root_cause, count(*) AS n, round(avg(anomaly_score), 4) AS avg_value, round(max(anomaly_score), 4) AS max_value FROM {ANOMALIES_SQL} GROUP BY 1, 2, 3")
def daily_rollup(spark, sf_dir):
    return dash.rollup(anomalies(spark, sf_dir), ["user_id", "root_cause"], "1 day", "anomaly_score")


@query("investigation_rollup", f"SELECT date_trunc('hour', triggered_at) AS bucket, status, count(*) AS n, round(avg(confidence_score), 4) AS avg_value, round(max(confidence_score), 4) AS max_value FROM {INVESTIGATIONS_SQL} GROUP BY 1, 2")
def investigation_rollup(spark, sf_dir):
    return dash.rollup(investigations(spark, sf_dir), ["status"], "1 hour", "confidence_score", "triggered_at")


@query(
    "recent_alert",
    f"""
    WITH r AS (SELECT * FROM {ANOMALIES_SQL} WHERE ts >= {NOW_SQL} - INTERVAL 7 DAY),
    m AS (SELECT root_cause, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, root_cause DESC LIMIT 1)
    SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
           count(DISTINCT user_id) AS users, (SELECT root_cause FROM m) AS top_root_cause FROM r
    """,
)
def recent_alert(spark, sf_dir):
    return dash.recent_alert(anomalies(spark, sf_dir), as_of())


@query(
    "labeling_progress",
    f"""
    SELECT count(*) AS total, count(is_anomaly) AS labeled, count(*) FILTER (WHERE is_anomaly) AS true_anomalies,
           count(*) FILTER (WHERE NOT is_anomaly) AS false_positives, count(*) - count(is_anomaly) AS pending,
           round(count(is_anomaly) * 100.0 / count(*), 2) AS progress_pct FROM {ANOMALIES_SQL}
    """,
)
def labeling_progress(spark, sf_dir):
    labelled = F.count("is_anomaly")
    total = F.count(F.lit(1))
    return anomalies(spark, sf_dir).agg(
        total.alias("total"), labelled.alias("labeled"),
        F.count_if(F.col("is_anomaly")).alias("true_anomalies"),
        F.count_if(~F.col("is_anomaly")).alias("false_positives"),
        (total - labelled).alias("pending"),
        F.round(F.try_divide(labelled * 100.0, total), 2).alias("progress_pct"),
    )


@query(
    "detection_overview",
    f"""
    SELECT count(*) AS total, count(DISTINCT user_id) AS unique_users, {SEVERITIES_SQL},
           array_to_string(list_sort(list(DISTINCT root_cause)), ',') AS apps,
           array_to_string(list_sort(list(DISTINCT sub_category)), ',') AS devices FROM {ANOMALIES_SQL}
    """,
)
def detection_overview(spark, sf_dir):
    return anomalies(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("user_id").alias("unique_users"),
        *dash.severity_counts(),
        F.array_join(F.sort_array(F.collect_set("root_cause")), ",").alias("apps"),
        F.array_join(F.sort_array(F.collect_set("sub_category")), ",").alias("devices"),
    )


@query(
    "status_queue",
    f"""
    SELECT anomaly_id, user_id, status, round(risk_score, 4) AS risk_score FROM {ANOMALIES_SQL}
    ORDER BY CASE status WHEN 'pending' THEN 0 WHEN 'resolved' THEN 1 ELSE 2 END,
             is_anomaly DESC NULLS LAST, risk_score DESC NULLS LAST, ts DESC, anomaly_id LIMIT 50
    """,
)
def status_queue(spark, sf_dir):
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "resolved", 1).otherwise(2)
    return (
        anomalies(spark, sf_dir)
        .orderBy(rank, F.col("is_anomaly").desc_nulls_last(), F.col("risk_score").desc_nulls_last(), F.desc("ts"), "anomaly_id")
        .limit(50)
        .select("anomaly_id", "user_id", "status", F.round("risk_score", 4).alias("risk_score"))
    )


@query("latest_anomalies", f"SELECT anomaly_id, ts, lower(severity) AS severity FROM {ANOMALIES_SQL} ORDER BY ts DESC, anomaly_id LIMIT 10")
def latest_anomalies(spark, sf_dir):
    return anomalies(spark, sf_dir).orderBy(F.desc("ts"), "anomaly_id").limit(10).select(
        "anomaly_id", "ts", F.lower("severity").alias("severity")
    )


@query(
    "anomaly_page",
    f"""
    SELECT anomaly_id, ts, severity, count(*) OVER () AS total_items FROM {ANOMALIES_SQL}
    WHERE severity = 'HIGH' AND root_cause ILIKE '%c%' AND ts >= {NOW_SQL} - INTERVAL 25 DAY
    ORDER BY anomaly_score DESC, anomaly_id LIMIT 20 OFFSET 20
    """,
)
def anomaly_page(spark, sf_dir):
    keep = dash.anomaly_predicate(severity="high", root_cause="c", days=25, as_of=as_of())
    shown = dash.page(anomalies(spark, sf_dir).filter(keep), [F.desc("anomaly_score"), F.asc("anomaly_id")], 2, 20)
    return shown.select("anomaly_id", "ts", "severity", "total_items")


@query(
    "anomaly_search",
    f"""
    SELECT anomaly_id, root_cause, sub_category, 'keyword' AS search_type FROM {ANOMALIES_SQL}
    WHERE lower(root_cause) LIKE '%purch%' OR lower(sub_category) LIKE '%purch%' OR lower(root_cause) LIKE '%k7%' OR lower(sub_category) LIKE '%k7%'
    ORDER BY risk_score DESC, ts DESC, anomaly_id LIMIT 25
    """,
)
def anomaly_search(spark, sf_dir):
    order = [F.desc("risk_score"), F.desc("ts"), F.asc("anomaly_id")]
    found = dash.keyword_search(anomalies(spark, sf_dir), ["root_cause", "sub_category"], ["purch", "k7"], order, 25)
    return found.select("anomaly_id", "root_cause", "sub_category", "search_type")


@query(
    "anomaly_search_fallback",
    f"SELECT anomaly_id, root_cause, sub_category, 'top_risk' AS search_type FROM {ANOMALIES_SQL} ORDER BY risk_score DESC, ts DESC, anomaly_id LIMIT 25",
)
def anomaly_search_fallback(spark, sf_dir):
    order = [F.desc("risk_score"), F.desc("ts"), F.asc("anomaly_id")]
    found = dash.keyword_search(anomalies(spark, sf_dir), ["root_cause", "sub_category"], ["no such word"], order, 25)
    return found.select("anomaly_id", "root_cause", "sub_category", "search_type")


@query(
    "user_profile_cards",
    f"""
    WITH a AS (SELECT * FROM {ANOMALIES_SQL}),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, anomaly_id) AS rk FROM a)
    SELECT c_custkey, c_name, count(anomaly_id) AS total, {SEVERITIES_SQL}, round(coalesce(avg(risk_score), 0), 2) AS avg_risk_score,
           round(coalesce(max(risk_score), 0), 2) AS max_risk_score, max(ts) AS last_anomaly_at,
           coalesce(string_agg(CAST(anomaly_id AS VARCHAR), ',' ORDER BY rk) FILTER (WHERE rk <= 5), '') AS recent
    FROM customer LEFT JOIN r ON r.user_id = c_custkey GROUP BY 1, 2
    """,
)
def user_profile_cards(spark, sf_dir):
    from tidemark.operators import ordered

    a = anomalies(spark, sf_dir)
    totals = a.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), *dash.severity_counts(),
        F.round(F.avg("risk_score"), 2).alias("avg_risk_score"),
        F.round(F.max("risk_score"), 2).alias("max_risk_score"),
        F.max("ts").alias("last_anomaly_at"),
    )
    last = ordered.top_k(a, ["user_id"], 5, F.desc("ts"), F.asc("anomaly_id"))
    recent = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "anomaly_id"))).alias("r")).select(
        "user_id", F.array_join(F.col("r.anomaly_id").cast("array<string>"), ",").alias("recent")
    )
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_custkey").alias("user_id"))
    out = users.join(totals, "user_id", "left").join(recent, "user_id", "left").drop("user_id")
    return out.na.fill(0).na.fill("", ["recent"])
