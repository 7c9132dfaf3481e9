"""Joins, versions, comparison and rule-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import remediation
from tidemark.operators import dashboards as dash, tables
from tidemark.plans.base import DETECTIONS_SQL, K_SQL, events, keyed_events
from tidemark.plans.dashboards import ANOMALIES_SQL, anomalies
from tidemark.registry import query
from tidemark.session import scratch_dir, table
from tidemark.sinks import writers


@query(
    "latest_version",
    "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1",
)
def latest_version(spark, sf_dir):
    return tables.latest_version(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query("next_version", "SELECT conv_id, max(turn) + 1 AS next_version FROM conversations GROUP BY 1")
def next_version(spark, sf_dir):
    return tables.next_version(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query(
    "lateral_latest",
    f"""
    SELECT a.anomaly_id, a.severity, c.c_name, n.n_name, coalesce(l.turn, -1) AS version, coalesce(l.role, '') AS author
    FROM {ANOMALIES_SQL} a LEFT JOIN customer c ON c.c_custkey = a.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1) l ON l.conv_id = a.anomaly_id
    """,
)
def lateral_latest(spark, sf_dir):
    latest = tables.latest_version(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")
    people = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    out = anomalies(spark, sf_dir).join(people, F.col("c_custkey") == F.col("user_id"), "left")
    out = out.join(latest, F.col("conv_id") == F.col("anomaly_id"), "left")
    return out.select(
        "anomaly_id", "severity", "c_name", "n_name",
        F.coalesce("turn", F.lit(-1)).alias("version"), F.coalesce("role", F.lit("")).alias("author"),
    )


@query(
    "left_join_users",
    f"""
    SELECT c_custkey, c_name, count(anomaly_id) AS anomaly_count, max(ts) AS last_anomaly_at, round(coalesce(avg(risk_score), 0), 4) AS avg_risk_score,
           count(anomaly_id) FILTER (WHERE severity = 'CRITICAL') AS critical_count
    FROM customer LEFT JOIN {ANOMALIES_SQL} a ON a.user_id = c_custkey GROUP BY 1, 2
    """,
)
def left_join_users(spark, sf_dir):
    totals = anomalies(spark, sf_dir).groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("anomaly_count"), F.max("ts").alias("last_anomaly_at"),
        F.round(F.avg("risk_score"), 4).alias("avg_risk_score"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
    )
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return users.join(totals, "c_custkey", "left").na.fill(0, ["anomaly_count", "avg_risk_score", "critical_count"])


@query(
    "semi_ids",
    f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT user_id FROM {DETECTIONS_SQL})",
)
def semi_ids(spark, sf_dir):
    hit = anomalies(spark, sf_dir).select(F.col("user_id").alias("o_custkey"))
    return tables.in_set(table(spark, sf_dir, "orders"), hit, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "anti_inflight",
    f"SELECT user_id, count(*) AS waiting FROM {ANOMALIES_SQL} WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
)
def anti_inflight(spark, sf_dir):
    busy = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    return tables.not_in_set(anomalies(spark, sf_dir), busy, "user_id").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("waiting")
    )


@query(
    "ordered_json",
    """
    SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_shipdate, l_linenumber, l_partkey, l_returnflag) FILTER (WHERE l_quantity > 30), '') AS findings
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def ordered_json(spark, sf_dir):
    out = tables.children_json(
        table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey",
        ["l_shipdate", "l_linenumber", "l_partkey", "l_returnflag"], [], F.col("l_quantity") > 30, "findings",
    )
    text = F.transform("findings", lambda f: F.concat_ws(":", f["l_linenumber"].cast("string"), f["l_returnflag"]))
    return out.select("o_orderkey", F.array_join(text, ",").alias("findings"))


@query(
    "unnest_counts",
    "SELECT item, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ')) AS item FROM conversations WHERE role = 'assistant') WHERE item <> '' GROUP BY 1",
)
def unnest_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " ")
    return tables.unnest_counts(rows, F.filter(words, lambda w: w != ""))


@query(
    "step_latency",
    """
    WITH n AS (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 100)
    SELECT event_type AS tool, round(avg(value), 4) AS avg_latency, count(*) AS invocations FROM n GROUP BY 1
    """,
)
def step_latency(spark, sf_dir):
    steps = F.array(F.struct(F.col("event_type").alias("tool"), F.col("value").alias("elapsed_ms")))
    out = tables.step_latency(events(spark, sf_dir), [F.desc("ts"), F.asc("event_id")], 100, steps, "tool", "elapsed_ms")
    return out.withColumn("avg_latency", F.round("avg_latency", 4))


@query(
    "union_by_name",
    "SELECT user_id AS id, value AS amount, event_type AS kind, CAST(NULL AS VARCHAR) AS status FROM events UNION ALL SELECT o_custkey, o_totalprice, CAST(NULL AS VARCHAR), o_orderstatus FROM orders",
)
def union_by_name(spark, sf_dir):
    return tables.union_by_name(
        events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("value").alias("amount"), F.col("event_type").alias("kind")),
        table(spark, sf_dir, "orders").select(
            F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status")
        ),
    )


@query(
    "frame_compare",
    f"""
    WITH l AS (SELECT event_id, value, event_type FROM events WHERE {K_SQL} <> 5),
    r AS (SELECT event_id, CASE WHEN {K_SQL} > 90 THEN value + 5 ELSE value END AS value, CASE WHEN {K_SQL} = 1 THEN 'x' ELSE event_type END AS event_type FROM events WHERE {K_SQL} <> 7),
    j AS (SELECT l.event_id AS a, r.event_id AS b, l.event_type = r.event_type AS et, abs(l.value - r.value) <= 0.001 + 0.005 * abs(r.value) AS ev
          FROM l FULL OUTER JOIN r ON l.event_id = r.event_id)
    SELECT count(a) AS total_rows, count(*) FILTER (WHERE et AND ev) AS matching_rows, count(*) FILTER (WHERE NOT et OR NOT ev) AS diff_rows,
           count(*) FILTER (WHERE b IS NULL) AS missing_rows, count(*) FILTER (WHERE a IS NULL) AS extra_rows,
           count(*) FILTER (WHERE NOT ev) AS diff_value, count(*) FILTER (WHERE NOT et) AS diff_event_type FROM j
    """,
)
def frame_compare(spark, sf_dir):
    rows = keyed_events(spark, sf_dir)
    left = rows.filter("k <> 5").select("event_id", "value", "event_type")
    changed = rows.filter("k <> 7").select(
        "event_id", F.when(F.col("k") > 90, F.col("value") + 5).otherwise(F.col("value")).alias("value"),
        F.when(F.col("k") == 1, "x").otherwise(F.col("event_type")).alias("event_type"),
    )
    return tables.compare(left, changed, ["event_id"], ["value", "event_type"])


@query(
    "validation_report",
    f"""
    WITH l AS (SELECT event_id, value, event_type FROM events WHERE {K_SQL} <> 5),
    r AS (SELECT event_id, CASE WHEN {K_SQL} > 90 THEN value + 5 ELSE value END AS value, CASE WHEN {K_SQL} = 1 THEN NULL ELSE event_type END AS event_type FROM events WHERE {K_SQL} <> 7),
    j AS (SELECT l.event_id AS a, r.event_id AS b, l.event_type IS NOT DISTINCT FROM r.event_type AS et, abs(l.value - r.value) <= 0.001 + 0.005 * abs(r.value) AS ev
          FROM l FULL OUTER JOIN r ON l.event_id = r.event_id)
    SELECT count(a) AS total_rows, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND et AND ev) AS matching_rows,
           count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND NOT (et AND ev)) AS diff_rows,
           count(*) FILTER (WHERE b IS NULL) AS missing_rows, count(*) FILTER (WHERE a IS NULL) AS extra_rows,
           count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND NOT ev) AS diff_value,
           count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND NOT et) AS diff_event_type,
           'k' AS extra_columns, 'user_id' AS missing_columns, 'event_type,value' AS matching_columns FROM j
    """,
)
def validation_report(spark, sf_dir):
    """The comparison written as JSON and read back from there."""
    rows = keyed_events(spark, sf_dir)
    left = rows.filter("k <> 5").select("event_id", "user_id", "value", "event_type", F.col("ts").alias("_ts_left"))
    right = rows.filter("k <> 7").select(
        "event_id", "k", F.when(F.col("k") > 90, F.col("value") + 5).otherwise(F.col("value")).alias("value"),
        F.when(F.col("k") != 1, F.col("event_type")).alias("event_type"),
    )
    report = tables.validation_report(left, right, ["event_id"])
    path = f"{scratch_dir(spark, 'report')}/result.json"
    writers.write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.withColumns({c: F.array_join(c, ",") for c in back.columns if c.endswith("_columns")})


@query(
    "row_set_compare",
    f"""
    WITH l AS (SELECT user_id, event_type FROM events WHERE {K_SQL} < 60), r AS (SELECT user_id, event_type FROM events WHERE {K_SQL} >= 40)
    SELECT 'extra' AS kind, count(*) AS n FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)
    UNION ALL SELECT 'missing', count(*) FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)
    UNION ALL SELECT 'matching', count(*) FROM (SELECT * FROM l INTERSECT ALL SELECT * FROM r)
    """,
)
def row_set_compare(spark, sf_dir):
    """Multiset difference by counting each distinct row on both sides: one combinable aggregation."""
    rows = keyed_events(spark, sf_dir)
    sides = rows.groupBy("user_id", "event_type").agg(
        F.count_if(F.col("k") < 60).alias("l"), F.count_if(F.col("k") >= 40).alias("r")
    )
    parts = F.array(
        F.struct(F.lit("extra").alias("kind"), F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("n")),
        F.struct(F.lit("missing").alias("kind"), F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("n")),
        F.struct(F.lit("matching").alias("kind"), F.sum(F.least("l", "r")).alias("n")),
    )
    return sides.agg(parts.alias("p")).select(F.explode("p").alias("p")).select("p.*")


@query(
    "session_list",
    "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_messages FROM conversations GROUP BY 1",
)
def session_list(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    sessions = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return tables.session_counts(sessions, rows, "conv_id")


@query(
    "explanation_stats",
    """
    SELECT role, count(*) AS explanations, count(DISTINCT conv_id) AS detections, CAST(sum(length(text)) AS BIGINT) AS total_tokens,
           round(avg(length(text)), 4) AS avg_tokens, max(turn) AS max_version FROM conversations GROUP BY 1
    """,
)
def explanation_stats(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("explanations"), F.count_distinct("conv_id").alias("detections"),
        F.sum(F.char_length("text")).cast("bigint").alias("total_tokens"),
        F.round(F.avg(F.char_length("text")), 4).alias("avg_tokens"), F.max("turn").alias("max_version"),
    )


@query(
    "drift_metric",
    "SELECT event_type, round(avg(abs(least(value / 100, 1) - 0.5) + 0.5), 6) AS value_drift, "
    f"round(avg(abs({K_SQL} / 100 - 0.5) + 0.5), 6) AS code_drift, "
    f"round((avg(abs(least(value / 100, 1) - 0.5) + 0.5) + avg(abs({K_SQL} / 100 - 0.5) + 0.5)) / 2, 6) AS total_drift FROM events GROUP BY 1",
)
def drift_metric(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).select(
        "event_type", F.least(F.col("value") / 100, F.lit(1.0)).alias("p"), (F.col("k") / 100).alias("q")
    )
    out = tables.drift(rows, "event_type", {"value": "p", "code": "q"})
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("value_drift", "code_drift", "total_drift")])


@query(
    "retrain_trigger",
    """
    WITH t AS (SELECT user_id, count(*) AS trained_rows FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1),
    c AS (SELECT user_id, count(*) AS total_rows FROM events GROUP BY 1)
    SELECT user_id, total_rows, coalesce(trained_rows, 0) AS trained_rows, total_rows - coalesce(trained_rows, 0) AS delta,
           total_rows - coalesce(trained_rows, 0) >= 25 AS due FROM c LEFT JOIN t USING (user_id)
    """,
)
def retrain_trigger(spark, sf_dir):
    rows = events(spark, sf_dir)
    log = rows.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("trained_rows")
    )
    return tables.retrain_due(rows, log, "user_id", 25)


@query(
    "best_entities",
    f"""
    SELECT user_id, event_type AS kind, {K_SQL} // 10 AS text, round(max(value), 4) AS confidence FROM events GROUP BY 1, 2, 3
    """,
)
def best_entities(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).select(
        "user_id", F.col("event_type").alias("kind"), F.floor(F.col("k") / 10).alias("text"), F.round("value", 4).alias("confidence")
    )
    return tables.best_entities(rows, "user_id", "kind", "text", "confidence")


CAUSES_SQL = "CASE root_cause WHEN 'error' THEN 'Brute Force' WHEN 'click' THEN 'Browser Anomaly' WHEN 'purchase' THEN 'Account Takeover' WHEN 'view' THEN 'Data Exfiltration' ELSE 'Strange' END"


@query(
    "remediation_actions",
    f"""
    -- fixed values: the flags of the causes that occur here
    WITH n AS (SELECT * FROM (VALUES
      ('Brute Force', 3, 2, [
        'PCI-DSS v4.0 Req.8.3||account lockout and authentication controls must be enforced', 
        'NCSC Cyber Essentials||Req.4: user access control; accounts must lock after repeated failed attempts', 
        'NIS Regulations 2018, Reg.10||appropriate and proportionate security measures against authentication attacks']::VARCHAR[]),
      ('Browser Anomaly', 3, 1, [
        'NCSC Cyber Essentials||Req.4 (malware protection): browser security configuration must be maintained; unknown browsers indicate potential policy bypass', 
        'NIS Regulations 2018, Reg.10||appropriate and proportionate measures against attacks exploiting unknown or misconfigured browser software', 
        'UK GDPR Art.32||technical measures to ensure integrity of processing; unrecognised browser agent indicates potential session compromise']::VARCHAR[]),
      ('Account Takeover', 4, 1, [
        'PCI-DSS v4.0 Req.12.10||incident response procedure must be activated', 
        'PCI-DSS v4.0 Req.8.2||all user IDs and authentication must be managed to prevent unauthorised access', 
        'UK GDPR Art.32||appropriate technical measures to ensure authorised access to personal data only', 
        'NCSC Cyber Essentials||Req.4: user access control; compromised account must be reviewed immediately']::VARCHAR[]),
      ('Data Exfiltration', 5, 1, [
        'UK GDPR Art.33||potential personal data breach: notification to ICO required within 72 hours', 
        'UK GDPR Art.32||technical and organisational measures to ensure data confidentiality must be reviewed', 
        'PCI-DSS v4.0 Req.12.10||incident response procedure must be activated', 
        'PCI-DSS v4.0 Req.9.4||data access controls and audit trail must be preserved', 
        'NIS Regulations 2018, Reg.10||operator must apply appropriate and proportionate security measures']::VARCHAR[]),
      ('Strange', 3, 0, []::VARCHAR[])) t(cause, actions, autos, flags)),
    s AS (SELECT * FROM (VALUES ('CRITICAL', ['ISO 27001 A.16||information security incident management procedure must be followed']), ('HIGH', ['ISO 27001 A.16||incident must be logged and reviewed within 24h'])) t(severity, flags)),
    a AS (SELECT anomaly_id, severity, {CAUSES_SQL} AS cause FROM {ANOMALIES_SQL})
    SELECT a.anomaly_id, a.cause, n.actions, n.autos AS auto_actions,
           array_to_string(n.flags || coalesce(s.flags, []::VARCHAR[]), ' ## ') AS compliance_flags
    FROM a JOIN n USING (cause) LEFT JOIN s USING (severity)
    """,
)
def remediation_actions(spark, sf_dir):
    cause = F.col("root_cause")
    named = (
        F.when(cause == "error", "Brute Force").when(cause == "click", "Browser Anomaly").when(cause == "purchase", "Account Takeover")
        .when(cause == "view", "Data Exfiltration").otherwise("Strange")
    )
    rows = anomalies(spark, sf_dir).select("anomaly_id", "severity", named.alias("cause"))
    out = remediation.advise(rows, F.col("cause"), F.col("severity"))
    return out.select(
        "anomaly_id", "cause", F.size("actions").alias("actions"),
        F.size(F.filter("actions", lambda x: x["auto_actionable"])).alias("auto_actions"),
        F.array_join("compliance_flags", " ## ").alias("compliance_flags"),
    )
