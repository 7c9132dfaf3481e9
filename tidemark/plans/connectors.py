"""Sources and sinks exercised on data that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import stages
from tidemark.operators import filters
from tidemark.plans.base import K_SQL, as_of, events, keyed_events, k_of
from tidemark.registry import query
from tidemark.session import scratch_dir, table
from tidemark.sinks import writers
from tidemark.sources import batches, files, kafka, security_logs
from tidemark.streaming import jobs


@query("csv_source", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value IS NOT NULL GROUP BY 1")
def csv_source(spark, sf_dir):
    path = scratch_dir(spark, "files") + "/events.csv"
    writers.write_file(events(spark, sf_dir).select("event_id", "event_type", "value"), path)
    rows = files.read_files(spark, path, schema="event_id BIGINT, event_type STRING, value DOUBLE", filter_nulls=True, null_columns=["value"])
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("jsonlines_source", f"SELECT {K_SQL} AS k, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1")
def jsonlines_source(spark, sf_dir):
    path = scratch_dir(spark, "files") + "/events.jsonlines"
    rows = events(spark, sf_dir).select("event_id", F.struct(k_of(F.col("props")).alias("k")).alias("props"))
    writers.write_file(rows, path)
    flat = security_logs.flatten(files.read_files(spark, path, schema="event_id BIGINT, props STRUCT<k: BIGINT>"), "_")
    return flat.groupBy(F.col("props_k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


@query("repeated_source", "SELECT event_type, count(*) * 3 AS n FROM events GROUP BY 1")
def repeated_source(spark, sf_dir):
    return batches.repeat(events(spark, sf_dir).select("event_type"), 3).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("audit_records_source", "SELECT 'Account-' || user_id AS account, event_type AS name, count(*) AS n FROM events GROUP BY 1, 2")
def audit_records_source(spark, sf_dir):
    """Audit-trail objects with a ``Records`` array, written as JSON and read back as rows."""
    path = scratch_dir(spark, "audit")
    record = F.struct(
        F.col("event_type").alias("eventName"), F.struct(F.col("user_id").cast("string").alias("accountId")).alias("userIdentity")
    )
    events(spark, sf_dir).select(F.array(record).alias("Records")).write.json(path)
    raw = spark.read.schema("Records ARRAY<STRUCT<eventName: STRING, userIdentity: STRUCT<accountId: STRING>>>").json(path)
    rows = security_logs.flatten(raw.select(F.explode("Records").alias("r")).select("r.*"), strip=True)
    account = F.when(F.col("userIdentityaccountId").rlike(r"^\d+$"), F.concat(F.lit("Account-"), "userIdentityaccountId"))
    return rows.groupBy(account.alias("account"), F.col("eventName").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("zeek_source", "SELECT event_type AS service, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (WHERE value > 50) AS big FROM events GROUP BY 1")
def zeek_source(spark, sf_dir):
    path = scratch_dir(spark, "zeek")
    # Two layouts of the same columns, each file with the header of its own.
    fields = {"uid": ("count", F.col("event_id").cast("string")), "service": ("enum", F.col("event_type")),
              "dur": ("interval", F.col("value").cast("string")), "big": ("bool", F.when(F.col("value") > 50, "T").otherwise("F"))}
    for k, order in enumerate((["uid", "service", "dur", "big"], ["big", "dur", "uid", "service"])):
        head = "\n".join(["#fields\t" + "\t".join(order), "#types\t" + "\t".join(fields[n][0] for n in order)])
        lines = events(spark, sf_dir).filter(F.col("event_id") % 2 == k).withColumn("part", F.spark_partition_id())
        lines = lines.select("part", F.lit(1).alias("place"), F.concat_ws("\t", *[fields[n][1] for n in order]).alias("value"))
        heads = lines.select("part").distinct().select("part", F.lit(0).alias("place"), F.lit(head).alias("value"))
        lines.union(heads).repartition("part").sortWithinPartitions("part", "place").select("value").write.mode("append").text(path)
    rows = security_logs.read_zeek(spark, path)
    return rows.groupBy("service").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("dur"), 4).alias("total"), F.count_if("big").alias("big")
    )


@query(
    "kafka_records",
    "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, 0 AS corrupt FROM events GROUP BY 1",
)
def kafka_records(spark, sf_dir):
    """The Kafka sink's records through the Kafka source's parser; only the broker is left out."""
    sent = kafka.kafka_rows(events(spark, sf_dir).select("event_id", "event_type", "value"), "event_id")
    got = kafka.parse_json_values(sent, "event_id BIGINT, event_type STRING, value DOUBLE")
    return got.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count("_corrupt_record").cast("int").alias("corrupt")
    )


@query("sql_loader", "SELECT kind, count(*) AS n FROM (SELECT event_type AS kind FROM events WHERE value > 50 UNION ALL SELECT o_orderstatus FROM orders) GROUP BY 1")
def sql_loader(spark, sf_dir):
    events(spark, sf_dir).createOrReplaceTempView("tidemark_events")
    table(spark, sf_dir, "orders").createOrReplaceTempView("tidemark_orders")
    rows = files.run_queries(
        spark,
        [{"query": "SELECT event_type AS kind FROM tidemark_events WHERE value > 50"}, {"query": "SELECT o_orderstatus AS kind FROM tidemark_orders"}],
    )
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("paged_rows", "SELECT (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 1000 AS page, o_orderkey FROM orders")
def paged_rows(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("tidemark_orders")
    rows = files.paged_table(spark, "SELECT o_orderkey, o_orderdate FROM tidemark_orders", ["o_orderdate", "o_orderkey"], 1000)
    return rows.select("page", "o_orderkey")


@query(
    "guarded_sql",
    "SELECT user_id, count(*) AS n, round(max(value), 4) AS top FROM events GROUP BY 1 ORDER BY top DESC, user_id LIMIT 100",
)
def guarded_sql(spark, sf_dir):
    events(spark, sf_dir).createOrReplaceTempView("tidemark_events")
    return stages.guarded_sql(
        spark, "SELECT user_id, count(*) AS n, round(max(value), 4) AS top FROM tidemark_events GROUP BY user_id ORDER BY top DESC, user_id"
    )


@query(
    "composed_stages",
    "SELECT event_type, round(value * 2, 4) AS doubled, 'batch' AS origin FROM events WHERE value > 80",
)
def composed_stages(spark, sf_dir):
    @stages.stage(needs=["value"])
    def keep_high(df, threshold=80.0):
        return filters.over_threshold(df, ["value"], threshold)

    doubled = lambda pdf: pdf.assign(doubled=(pdf["value"] * 2).round(4))[["event_type", "doubled"]]
    return stages.run_stages(
        events(spark, sf_dir),
        [
            ("keep_high", {"threshold": 80.0}),
            lambda df: stages.map_batches(df.select("event_type", "value"), doubled, "event_type STRING, doubled DOUBLE"),
            lambda df: df.withColumn("origin", F.lit("batch")),
        ],
    )


@query("period_partitions", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS period, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def period_partitions(spark, sf_dir):
    path = scratch_dir(spark, "scores")
    rows = events(spark, sf_dir).withColumn("value_z_loss", F.col("value"))
    writers.write_scores_by_period(rows, path, "user_id", "ts", ["value"], "value")
    back = spark.read.option("header", "true").schema("user BIGINT, time STRING, value_score DOUBLE, anomalyScore DOUBLE, period STRING").csv(path)
    return back.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("anomalyScore"), 4).alias("total"))


@query(
    "merged_versions",
    "SELECT event_type, count(*) AS n, round(sum(CASE WHEN value > 50 THEN -value ELSE value END), 4) AS total FROM events WHERE value > 50 OR event_type <> 'view' GROUP BY 1",
)
def merged_versions(spark, sf_dir):
    path = scratch_dir(spark, "merge")
    rows = events(spark, sf_dir).select("event_id", "event_type", "value")
    writers.merge_into(spark, path, rows.filter("event_type <> 'view'"), ["event_id"], "1")
    changed = rows.filter("value > 50").withColumn("value", -F.col("value"))
    final = writers.merge_into(spark, path, changed, ["event_id"], "2")
    return spark.read.parquet(final).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "status_update",
    "SELECT CASE WHEN value > 90 THEN 'resolved' ELSE 'new' END AS status, count(*) AS n FROM events GROUP BY 1",
)
def status_update(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "value", F.lit("new").alias("status"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    out = writers.set_status(rows, rows.filter("value > 90"), "event_id", "resolved", as_of())
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("compacted_table", "SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-21' GROUP BY 1")
def compacted_table(spark, sf_dir):
    path = scratch_dir(spark, "compact")
    writers.compact(events(spark, sf_dir), path, "ts", "user_id")
    kept = writers.drop_old(spark.read.parquet(path), "date", as_of(), 10)
    return kept.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("schema_merge", "SELECT count(*) AS n, count(kind) AS with_kind, count(value) AS with_value FROM (SELECT event_id, event_type AS kind, NULL AS value FROM events WHERE value <= 50 UNION ALL SELECT event_id, NULL, value FROM events WHERE value > 50)")
def schema_merge(spark, sf_dir):
    path = scratch_dir(spark, "append")
    rows = events(spark, sf_dir)
    writers.append_merged(rows.filter("value <= 50").select("event_id", F.col("event_type").alias("kind")), path)
    writers.append_merged(rows.filter("value > 50").select("event_id", "value"), path)
    return writers.read_merged(spark, path).agg(
        F.count(F.lit(1)).alias("n"), F.count("kind").alias("with_kind"), F.count("value").alias("with_value")
    )


@query("bulk_documents", "SELECT count(*) AS requests, count(DISTINCT event_id) AS documents FROM events")
def bulk_documents(spark, sf_dir):
    lines = writers.bulk_documents(events(spark, sf_dir), "detections", "event_id")
    ids = F.get_json_object(F.substring_index("value", "\n", 1), "$.index._id")
    return lines.agg(F.count(F.lit(1)).alias("requests"), F.count_distinct(ids).alias("documents"))


@query(
    "latest_in_batch",
    "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)
def latest_in_batch(spark, sf_dir):
    return jobs.latest_per_user(events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "ts")


@query(
    "detection_records",
    f"""
    WITH s AS (SELECT user_id, avg(value) AS mv, stddev_pop(value) AS sv, avg({K_SQL}) AS mk, stddev_pop({K_SQL}) AS sk FROM events GROUP BY 1),
    z AS (SELECT e.user_id, e.event_id, abs((value - mv) / sv) AS zv, abs(({K_SQL} - mk) / sk) AS zk FROM events e JOIN s USING (user_id))
    SELECT user_id, event_id, round((zv + zk) / 2, 4) AS anomaly_score, CASE WHEN zv > zk THEN 'value' ELSE 'k' END AS top_name, 2 AS feature_count
    FROM z WHERE (zv + zk) / 2 > 2
    """,
)
def detection_records(spark, sf_dir):
    rows = keyed_events(spark, sf_dir)
    names = ["value", "k"]
    stats = rows.groupBy("user_id").agg(
        *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]
    )
    joined = rows.join(stats, "user_id")
    z = {n: F.abs((F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}")) for n in names}
    out = jobs.detection_record(joined, "user_id", "event_id", z, {n: F.col(n) for n in names}, 2.0)
    return out.select(
        "user_id", F.col("timestamp").alias("event_id"), "anomaly_score",
        F.substring_index("top_features", "=", 1).alias("top_name"), "feature_count",
    )


@query("tagged_union", "SELECT CASE WHEN value > 100 THEN 'anomaly' ELSE 'clean' END AS event_type, count(*) AS n FROM events GROUP BY 1")
def tagged_union(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "value")
    both = jobs.tagged_union(rows.filter("value > 100"), rows.filter("value <= 100"))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("entry_dedup", f"SELECT count(*) AS entries FROM (SELECT DISTINCT user_id, {K_SQL} FROM events)")
def entry_dedup(spark, sf_dir):
    rows = keyed_events(spark, sf_dir).select(F.concat_ws(":", F.col("user_id").cast("string"), F.col("k").cast("string")).alias("id"), "ts")
    return files.dedup_entries(rows).agg(F.count(F.lit(1)).alias("entries"))


