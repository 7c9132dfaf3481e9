"""Flow, snapshot, profile, statistics and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import people
from tidemark.operators import flows, profiles as prof, snapshots
from tidemark.operators.quantiles import quantiles
from tidemark.plans.base import K_SQL, SCORED_SQL, events, keyed_events, scored
from tidemark.registry import query
from tidemark.session import spread, table

PACKETS_SQL = f"""(
  SELECT event_id, epoch_us(ts) AS t, '10.0.' || (user_id // 250) || '.' || (user_id % 250) || ':' || (1000 + {K_SQL}) || '=192.168.0.1:'
           || CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 ELSE 22 END AS flow_id,
         {K_SQL} & 31 AS flags, CAST(floor(value * 100) AS BIGINT) AS data_len FROM events)"""
FLOWS_SQL = f"""(
  SELECT strftime(make_timestamp(t - t % 60000000 + 60000000), '%Y-%m-%d %H:%M') AS rollup_time, flow_id,
    CAST(sum((flags >> 4) & 1) AS BIGINT) AS ack, CAST(sum((flags >> 3) & 1) AS BIGINT) AS psh, CAST(sum((flags >> 2) & 1) AS BIGINT) AS rst,
    CAST(sum((flags >> 1) & 1) AS BIGINT) AS syn, CAST(sum(flags & 1) AS BIGINT) AS fin,
    CAST(sum(data_len) AS BIGINT) AS data_len, count(*) AS ppm FROM {PACKETS_SQL} GROUP BY 1, 2)"""


def packets(spark, sf_dir):
    port = F.when(F.col("event_type") == "click", 80).when(F.col("event_type") == "view", 443).otherwise(22)
    return keyed_events(spark, sf_dir).select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.concat_ws(".", F.lit("10.0"), F.floor(F.col("user_id") / 250).cast("string"), (F.col("user_id") % 250).cast("string")).alias("src_ip"),
        F.lit("192.168.0.1").alias("dest_ip"),
        (1000 + F.col("k")).alias("src_port"),
        port.alias("dest_port"),
        F.col("k").bitwiseAND(31).alias("flags"),
        F.floor(F.col("value") * 100).cast("bigint").alias("data_len"),
    )


@query(
    "flow_rollup",
    f"""
    SELECT *, round(data_len / ppm, 4) AS bpp, ack + psh + rst + syn + fin AS all_flags,
      round(CASE WHEN ack + psh + rst + syn + fin > 0 THEN (ack + psh) / (ack + psh + rst + syn + fin) ELSE -1 END, 6) AS ackpush_share,
      round(CASE WHEN ack + psh + rst + syn + fin > 0 THEN syn / (ack + psh + rst + syn + fin) ELSE -1 END, 6) AS syn_share FROM {FLOWS_SQL}
    """,
)
def flow_rollup(spark, sf_dir):
    out = flows.flow_rollup(packets(spark, sf_dir))
    return out.select(
        "rollup_time", "flow_id", *flows.FLAGS, "data_len", "ppm", F.round("bpp", 4).alias("bpp"),
        F.col("all").alias("all_flags"),
        F.coalesce(F.round(F.col("`ackpush/all`"), 6), F.lit(-1.0)).alias("ackpush_share"),
        F.coalesce(F.round(F.col("`syn/all`"), 6), F.lit(-1.0)).alias("syn_share"),
    )


@query(
    "flow_joined_back",
    f"""
    SELECT p.event_id, f.rollup_time, f.flow_id, f.ppm, f.data_len FROM {PACKETS_SQL} p
    LEFT JOIN {FLOWS_SQL} f ON f.flow_id = p.flow_id AND f.rollup_time = strftime(make_timestamp(t - t % 60000000 + 60000000), '%Y-%m-%d %H:%M')
    """,
)
def flow_joined_back(spark, sf_dir):
    return flows.packets_with_flow(packets(spark, sf_dir)).select("event_id", "rollup_time", "flow_id", "ppm", "data_len")


PLUGIN_SQL = """CASE l_linenumber WHEN 1 THEN 'ldrmodules' WHEN 2 THEN 'threadlist' WHEN 3 THEN 'envars' WHEN 4 THEN 'handles' WHEN 5 THEN 'handles' ELSE 'vadinfo' END"""


def snapshot_rows(spark, sf_dir):
    """Order lines seen as snapshot rows: supplier = process, ship year = snapshot, line number = plugin."""
    n = F.col("l_linenumber")
    flag = F.col("l_returnflag")
    plugin = (
        F.when(n == 1, "ldrmodules").when(n == 2, "threadlist").when(n == 3, "envars")
        .when(n.isin(4, 5), "handles").otherwise("vadinfo")
    )
    part = F.col("l_partkey").cast("string")
    names = F.when(
        flag == "A", F.concat(F.lit("\\Device\\HarddiskVolume1\\Windows\\f"), part, F.lit(".docx.lock"))
    ).otherwise(F.concat(F.lit("\\Device\\HarddiskVolume1\\Users\\u\\g"), part, F.lit(".txt")))
    return spread(table(spark, sf_dir, "lineitem")).select(
        F.year("l_shipdate").cast("bigint").alias("snapshot_id"),
        F.col("l_shipdate").alias("timestamp"),
        plugin.alias("plugin"),
        F.col("l_suppkey").alias("PID"),
        F.lit("proc").alias("Process"),
        F.when(F.col("l_discount") == 0.1, 2147483647).otherwise(F.col("l_extendedprice").cast("int")).alias("CommitCharge"),
        F.when(n == 1, F.lit("proc.exe")).otherwise(names).alias("Name"),
        F.when(flag == "N", "Key").otherwise("File").alias("Type"),
        F.when(flag == "N", "5").otherwise("2").alias("State"),
        F.when(F.col("l_linestatus") == "O", "31").otherwise("9").alias("WaitReason"),
        F.when(flag == "R", "VadS").otherwise("Vad ").alias("Tag"),
        F.when(F.col("l_linestatus") == "O", "PAGE_READONLY ").otherwise("PAGE_EXECUTE_READWRITE ").alias("Protection"),
        F.when(flag == "A", "1").otherwise("0").alias("PrivateMemory"),
        F.concat(F.lit("C:\\f"), part, F.lit(".dll")).alias("File"),
        F.lit("PATHEXT").alias("Variable"),
        F.when(flag == "A", snapshots.PATH_EXTENSIONS).otherwise("x").alias("Value"),
        F.lit("0x1F").alias("Size"),
        F.lit("C:\\proc.exe").alias("Path"),
        (F.col("l_orderkey") * 10 + n).alias("row_id"),
    )


@query(
    "snapshot_features",
    """
    WITH r AS (SELECT year(l_shipdate) AS snapshot_id, l_suppkey || '_proc' AS pid_process, *, l_linenumber IN (4, 5) AS h, l_linenumber >= 6 AS v,
                 CASE WHEN l_discount <> 0.1 THEN CAST(trunc(l_extendedprice) AS DOUBLE) END AS charge FROM lineitem),
    a AS (SELECT snapshot_id, pid_process,
      count(*) FILTER (WHERE l_linenumber = 3 AND l_returnflag = 'A') AS envars_df_count,
      count(*) FILTER (WHERE l_linenumber = 2) AS threadlist_df_count,
      count(*) FILTER (WHERE l_linenumber = 2 AND l_linestatus = 'O') AS threadlist_df_wait_reason_31,
      count(*) FILTER (WHERE v) AS vads_all, count(*) FILTER (WHERE v AND l_returnflag = 'R') AS vads_count,
      count(*) FILTER (WHERE v AND l_returnflag <> 'R') AS vad_count,
      count(*) FILTER (WHERE v AND l_returnflag = 'A') AS count_private_memory,
      avg(charge) FILTER (WHERE v) AS cc_mean, max(charge) FILTER (WHERE v AND l_returnflag <> 'R') AS cc_max_vad,
      min(charge) FILTER (WHERE v AND l_returnflag = 'R') AS cc_min_vads,
      count(*) FILTER (WHERE v AND l_returnflag = 'R' AND l_discount = 0.1) AS full_vads,
      stddev_pop(charge) FILTER (WHERE v AND l_linestatus <> 'O') AS rwx_std,
      count(*) FILTER (WHERE v AND l_linestatus = 'O' AND l_returnflag = 'R') AS ro_vads,
      count(*) FILTER (WHERE h) AS handles, count(*) FILTER (WHERE h AND l_returnflag = 'N') AS keys,
      count(*) FILTER (WHERE h AND l_returnflag = 'A') AS doubled,
      count(*) FILTER (WHERE h AND l_returnflag = 'R') AS plain,
      count(DISTINCT CASE WHEN h THEN l_partkey || CASE WHEN l_returnflag = 'A' THEN 'a' ELSE 'b' END END) AS names,
      count(*) FILTER (WHERE l_linenumber = 1) AS modules
      FROM r GROUP BY 1, 2)
    SELECT snapshot_id, pid_process, envars_df_count, threadlist_df_count, threadlist_df_wait_reason_31, vad_count, vads_count, count_private_memory,
      round(coalesce(cc_mean, 0), 4) AS get_commit_charge_mean, coalesce(cc_max_vad, 0) AS get_commit_charge_max_vad,
      coalesce(cc_min_vads, 0) AS get_commit_charge_min_vads, full_vads AS count_entire_commit_charge_vads,
      round(coalesce(rwx_std, 0), 4) AS get_commit_charge_std_page_execute_readwrite, ro_vads AS page_readonly_vads_count,
      round(CASE WHEN vads_count > 0 THEN ro_vads / vads_count ELSE 0 END, 6) AS page_readonly_vads_ratio,
      round(CASE WHEN vads_all > 0 THEN vad_count / vads_all ELSE 0 END, 6) AS vad_ratio,
      handles AS handles_df_count, keys AS handles_df_key_count, round(keys / (handles + 1), 6) AS handles_df_key_ratio,
      doubled AS count_double_extension_count_handles, CASE WHEN doubled > 0 THEN 4 ELSE 0 END AS double_extension_len_handles,
      plain AS check_doc_file_handle_count, names AS handles_df_name_unique,
      CASE WHEN doubled + plain > 3 THEN plain ELSE 0 END AS file_users_exists, CASE WHEN doubled + plain > 3 THEN doubled ELSE 0 END AS file_windows_count,
      CASE WHEN modules > 0 THEN 31 ELSE 0 END AS ldrmodules_df_size_int, CASE WHEN modules > 0 THEN 'C:\\proc.exe' ELSE '' END AS ldrmodules_df_path
    FROM a
    """,
)
def snapshot_features(spark, sf_dir):
    out = snapshots.snapshot_features(snapshot_rows(spark, sf_dir), ["docx", "txt", "pdf"])
    rounded = {
        "get_commit_charge_mean": 4, "get_commit_charge_std_page_execute_readwrite": 4, "page_readonly_vads_ratio": 6,
        "vad_ratio": 6, "handles_df_key_ratio": 6,
    }
    names = """snapshot_id pid_process envars_df_count threadlist_df_count threadlist_df_wait_reason_31 vad_count vads_count
        count_private_memory get_commit_charge_mean get_commit_charge_max_vad get_commit_charge_min_vads
        count_entire_commit_charge_vads get_commit_charge_std_page_execute_readwrite page_readonly_vads_count
        page_readonly_vads_ratio vad_ratio handles_df_count handles_df_key_count handles_df_key_ratio
        count_double_extension_count_handles double_extension_len_handles check_doc_file_handle_count handles_df_name_unique
        file_users_exists file_windows_count ldrmodules_df_size_int ldrmodules_df_path""".split()
    return out.select(*[F.round(n, rounded[n]).alias(n) if n in rounded else F.col(n) for n in names])


@query(
    "profile_top_values",
    f"""
    WITH u AS (SELECT user_id, 'event_type' AS dim, event_type AS value FROM events UNION ALL SELECT user_id, 'k', CAST({K_SQL} AS VARCHAR) FROM events),
    c AS (SELECT user_id, dim, value, count(*) AS n FROM u GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id, dim ORDER BY n DESC, value) AS rank FROM c)
    SELECT * FROM r WHERE rank <= 5
    """,
)
def profile_top_values(spark, sf_dir):
    return prof.top_values(keyed_events(spark, sf_dir), "user_id", ["event_type", "k"], 5)


@query(
    "activity_hours",
    """
    WITH h AS (SELECT user_id, hour(ts) AS hour, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total FROM events GROUP BY 1, 2),
    d AS (SELECT user_id, isodow(ts) - 1 AS day, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS total FROM events GROUP BY 1, 2),
    p AS (SELECT user_id, hour, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hour) AS r FROM h),
    grid AS (SELECT user_id, x AS hour FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(24)) AS x)),
    o AS (SELECT g.user_id, string_agg(CAST(g.hour AS VARCHAR), ',' ORDER BY g.hour) AS off_hours FROM grid g LEFT JOIN h ON h.user_id = g.user_id AND h.hour = g.hour
          WHERE h.n IS NULL OR h.n < greatest(1, h.total * 0.01) GROUP BY 1)
    SELECT a.user_id, a.active_from, a.active_to, b.peak_hours, coalesce(o.off_hours, '') AS off_hours, c.typical_days FROM
      (SELECT user_id, coalesce(min(hour) FILTER (WHERE n >= greatest(1, total * 0.05)), -1) AS active_from,
              coalesce(max(hour) FILTER (WHERE n >= greatest(1, total * 0.05)) + 1, -1) AS active_to FROM h GROUP BY 1) a
      JOIN (SELECT user_id, string_agg(CAST(hour AS VARCHAR), ',' ORDER BY hour) AS peak_hours FROM p WHERE r <= 5 GROUP BY 1) b USING (user_id)
      JOIN (SELECT user_id, coalesce(string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) FILTER (WHERE n >= greatest(1, total * 0.10)), '') AS typical_days FROM d GROUP BY 1) c USING (user_id)
      LEFT JOIN o USING (user_id)
    """,
)
def activity_hours(spark, sf_dir):
    out = prof.activity_hours(events(spark, sf_dir), "user_id", "ts")

    def text(c):
        return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)

    return out.select(
        "user_id", F.coalesce("active_from", F.lit(-1)).alias("active_from"), F.coalesce("active_to", F.lit(-1)).alias("active_to"),
        text("peak_hours"), text("off_hours"), text("typical_days"),
    )


COMMON_APPS = ["click", "view", "purchase", "login"]


@query(
    "behaviour_baseline",
    f"""
    WITH e AS (SELECT user_id, ts, event_type AS app, {K_SQL} // 20 AS place FROM events),
    t AS (SELECT user_id, count(*) AS total FROM e GROUP BY 1),
    a AS (SELECT user_id, app, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, app) AS r FROM e GROUP BY 1, 2),
    l AS (SELECT user_id, place, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, place) AS r FROM e GROUP BY 1, 2),
    h AS (SELECT user_id, hour(ts) AS hour, count(*) AS n FROM e GROUP BY 1, 2),
    w AS (SELECT user_id, isodow(ts) - 1 AS day, count(*) AS n FROM e GROUP BY 1, 2),
    d AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS events, count(DISTINCT app) AS apps FROM e GROUP BY 1, 2),
    k AS (SELECT unnest(['click', 'view', 'purchase', 'login']) AS app, unnest(range(4)) AS pos)
    SELECT t.user_id,
      (SELECT coalesce(string_agg(app, ',' ORDER BY r), '') FROM a WHERE a.user_id = t.user_id AND r <= 10 AND n > total * 0.05) AS typical_apps,
      (SELECT string_agg(app, ',' ORDER BY pos) FROM k WHERE app NOT IN (SELECT app FROM a WHERE a.user_id = t.user_id)) AS never_accessed,
      (SELECT string_agg(CAST(place AS VARCHAR), ',' ORDER BY r) FROM l WHERE l.user_id = t.user_id AND r <= 3) AS typical_locations,
      (SELECT CASE WHEN count(*) = 1 THEN 'stationary' WHEN count(*) <= 3 THEN 'occasional' ELSE 'frequent' END FROM l WHERE l.user_id = t.user_id) AS travel_pattern,
      (SELECT coalesce(min(hour), 9) FROM h WHERE h.user_id = t.user_id AND n > total * 0.05) AS work_start,
      (SELECT coalesce(max(hour), 17) FROM h WHERE h.user_id = t.user_id AND n > total * 0.05) AS work_end,
      (SELECT coalesce(string_agg(CAST(day AS VARCHAR), ',' ORDER BY day), '') FROM w WHERE w.user_id = t.user_id AND n > total * 0.05) AS work_days,
      (SELECT CAST(floor(quantile_cont(events, 0.1)) AS INTEGER) FROM d WHERE d.user_id = t.user_id) AS activity_min,
      (SELECT CAST(floor(quantile_cont(events, 0.9)) AS INTEGER) FROM d WHERE d.user_id = t.user_id) AS activity_max,
      (SELECT CAST(floor(quantile_cont(apps, 0.5)) AS INTEGER) FROM d WHERE d.user_id = t.user_id) AS apps_per_day
    FROM t
    """,
)
def behaviour_baseline(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).withColumn("place", F.floor(F.col("k") / 20))
    out = prof.behaviour_baseline(rows, "user_id", "ts", "event_type", "place", COMMON_APPS)
    lists = ["typical_apps", "never_accessed", "typical_locations", "work_days"]
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists})


@query(
    "user_roles",
    """
    WITH a AS (SELECT user_id, list(DISTINCT event_type) AS apps FROM events WHERE value > 60 GROUP BY 1),
    r AS (SELECT *, CASE WHEN list_has_any(apps, ['purchase']) THEN 'sales_marketing' WHEN list_has_any(apps, ['error']) THEN 'engineering' ELSE 'general' END AS role FROM a)
    SELECT user_id, role,
      CASE role WHEN 'sales_marketing' THEN 'Sales Representative' WHEN 'engineering' THEN 'Software Engineer' ELSE 'Operations Analyst' END AS title,
      list_extract(['Junior', 'Mid', 'Senior', 'Principal'], CAST(('0x' || right(md5(CAST(user_id AS VARCHAR)), 1)) AS INTEGER) % 4 + 1) AS seniority
    FROM r
    """,
)
def user_roles(spark, sf_dir):
    apps = events(spark, sf_dir).filter("value > 60").groupBy("user_id").agg(F.collect_set("event_type").alias("apps"))
    role = people.role(F.col("apps"), [("sales_marketing", ["purchase"]), ("engineering", ["error"])])
    return apps.withColumn("role", role).select(
        "user_id", "role", people.job_title(F.col("role"), F.col("apps")).alias("title"),
        people.seniority(F.col("user_id").cast("string")).alias("seniority"),
    )


@query(
    "baseline_stats",
    f"""
    SELECT event_type, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.5), 6) AS p50,
           round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.99), 6) AS p99, round(min(score), 6) AS min,
           round(max(score), 6) AS max, count(*) AS n FROM {SCORED_SQL} GROUP BY 1
    """,
)
def baseline_stats(spark, sf_dir):
    out = prof.score_baseline(scored(spark, sf_dir), ["event_type"], "score")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "p95", "p99", "min", "max")])


BASE_SQL = "(SELECT avg(value) AS m, stddev_pop(value) AS sd, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events)"


@query(
    "score_distribution",
    f"""
    SELECT count(*) AS total_samples, count(*) FILTER (WHERE value > p95) AS above_p95_count, count(*) FILTER (WHERE value > p99) AS above_p99_count,
      count(*) FILTER (WHERE abs((value - m) / sd) > 3) AS above_3std_count,
      round(count(*) FILTER (WHERE value > p95) * 100.0 / count(*), 6) AS above_p95_pct, round(count(*) FILTER (WHERE value > p99) * 100.0 / count(*), 6) AS above_p99_pct,
      round(count(*) FILTER (WHERE abs((value - m) / sd) > 3) * 100.0 / count(*), 6) AS above_3std_pct,
      round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis
    FROM events, {BASE_SQL}
    """,
)
def score_distribution(spark, sf_dir):
    rows = events(spark, sf_dir)
    out = prof.distribution(rows, "value", prof.score_baseline(rows, [], "value"))
    return out.select(*[F.col(c) if c.endswith(("_count", "_samples")) else F.round(c, 6).alias(c) for c in out.columns])


@query(
    "threshold_study",
    f"""
    WITH b AS {BASE_SQL}, q AS (SELECT quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.995) AS p995 FROM events),
    t AS (SELECT 'mean_1sigma' AS rule, m + sd AS v FROM b UNION ALL SELECT 'mean_2sigma', m + 2 * sd FROM b UNION ALL SELECT 'mean_3sigma', m + 3 * sd FROM b
          UNION ALL SELECT 'p90', p90 FROM q UNION ALL SELECT 'p95', p95 FROM q UNION ALL SELECT 'p99', p99 FROM q UNION ALL SELECT 'p995', p995 FROM q)
    SELECT rule, round(v, 6) AS threshold, count(*) FILTER (WHERE value > v) AS hits, round(count(*) FILTER (WHERE value > v) * 100.0 / count(*), 6) AS pct
    FROM events, t GROUP BY 1, 2
    """,
)
def threshold_study(spark, sf_dir):
    rows = events(spark, sf_dir)
    points = {"p90": 0.90, "p95": 0.95, "p99": 0.99, "p995": 0.995}
    out = prof.threshold_study(rows, "value", prof.score_baseline(rows, [], "value"), points)
    return out.select("rule", F.round("threshold", 6).alias("threshold"), "hits", F.round("pct", 6).alias("pct"))


@query(
    "quality_rules",
    f"""
    SELECT 'value_out_of_range' AS rule, count(*) FILTER (WHERE value > 300) AS violations FROM events
    UNION ALL SELECT 'missing_type', count(*) FILTER (WHERE event_type IS NULL OR event_type = '') FROM events
    UNION ALL SELECT 'late_code', count(*) FILTER (WHERE {K_SQL} > 98) FROM events
    UNION ALL SELECT 'duplicate_id', (SELECT count(*) FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 'code_with_many_types', (SELECT count(*) FROM (SELECT {K_SQL} AS k FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1))
    UNION ALL SELECT 'user_with_many_types', (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1))
    """,
)
def quality_rules(spark, sf_dir):
    rows = keyed_events(spark, sf_dir)
    single = prof.quality_rules(
        rows,
        {
            "value_out_of_range": F.col("value") > 300,
            "missing_type": F.col("event_type").isNull() | (F.col("event_type") == ""),
            "late_code": F.col("k") > 98,
        },
    )
    return (
        single.unionByName(prof.duplicates(rows, "event_id", "duplicate_id"))
        .unionByName(prof.many_values(rows, "k", "event_type", "code_with_many_types"))
        .unionByName(prof.many_values(rows, "user_id", "event_type", "user_with_many_types"))
    )


@query(
    "daily_quantiles",
    "SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1",
)
def daily_quantiles(spark, sf_dir):
    out = quantiles(events(spark, sf_dir), ["user_id"], "value", {"median": 0.5, "p90": 0.9})
    return out.select("user_id", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"))


@query(
    "day_hour_pivot",
    "SELECT isodow(ts) - 1 AS dow, " + ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS h{h}" for h in range(24)) + " FROM events GROUP BY 1",
)
def day_hour_pivot(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.weekday("ts").alias("dow"), F.concat(F.lit("h"), F.hour("ts")).alias("h"))
    return rows.groupBy("dow").pivot("h", [f"h{h}" for h in range(24)]).count().na.fill(0)


@query(
    "value_correlation",
    f"SELECT 'value' AS a, 'k' AS b, round(corr(value, {K_SQL}), 6) AS corr FROM events UNION ALL SELECT 'value', 'hour', round(corr(value, hour(ts)), 6) FROM events UNION ALL SELECT 'k', 'hour', round(corr({K_SQL}, hour(ts)), 6) FROM events",
)
def value_correlation(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).withColumn("hour", F.hour("ts"))
    return prof.correlation(rows, ["value", "k", "hour"]).withColumn("corr", F.round("corr", 6))


@query(
    "user_spans",
    "SELECT user_id, count(*) AS events, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS days, round(count(*) / (date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1), 4) AS events_per_day, round(100.0 * count(*) FILTER (WHERE value < 1) / count(*), 4) AS tiny_pct FROM events GROUP BY 1",
)
def user_spans(spark, sf_dir):
    days = F.date_diff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))) + 1
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), days.alias("days"), F.round(F.count(F.lit(1)) / days, 4).alias("events_per_day"),
        F.round(F.count_if(F.col("value") < 1) * 100.0 / F.count(F.lit(1)), 4).alias("tiny_pct"),
    )
