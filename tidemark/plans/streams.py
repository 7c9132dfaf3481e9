"""Streaming queries, run to completion over the events table and read back from what they wrote."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.base import K_SQL, k_of
from tidemark.registry import query
from tidemark.session import few_local_partitions, scratch_dir, table, table_stream
from tidemark.operators import scoring
from tidemark.sinks import writers
from tidemark.streaming import jobs, scored, state


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return the table it wrote."""
    spark = stream.sparkSession
    out = scratch_dir(spark, name)
    with few_local_partitions(spark):
        running = (
            stream.writeStream.format("parquet").outputMode(mode).option("path", out)
            .option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        )
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def plain_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(
    "stream_rollup",
    """
    SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, round(avg(value), 4) AS avg_value, round(max(value), 4) AS max_value
    FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
    """,
)
def stream_rollup(spark, sf_dir):
    rolled = jobs.tumbling_rollup(event_stream(spark, sf_dir), ["event_type"], "ts", "1 hour", "value")
    out = plain_time(run_to_table(rolled, "rollup"), "bucket")
    return out.select("bucket", "event_type", "n", F.round("avg_value", 4).alias("avg_value"), F.round("max_value", 4).alias("max_value"))


@query(
    "stream_sliding",
    """
    WITH w AS (SELECT date_trunc('hour', ts) - to_hours(i) AS bucket, event_type FROM events, (SELECT unnest(range(12)) AS i))
    SELECT bucket, event_type, count(*) AS n FROM w GROUP BY 1, 2 HAVING bucket + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
    """,
)
def stream_sliding(spark, sf_dir):
    rolled = jobs.sliding_rollup(event_stream(spark, sf_dir), ["event_type"], "ts", "12 hours", "1 hour")
    return plain_time(run_to_table(rolled, "sliding"), "bucket")


@query(
    "stream_dedup",
    f"SELECT count(*) AS entries, count(DISTINCT entry) AS distinct_entries FROM (SELECT DISTINCT user_id * 100 + {K_SQL} AS entry FROM events)",
)
def stream_dedup(spark, sf_dir):
    entries = event_stream(spark, sf_dir).select("ts", (F.col("user_id") * 100 + k_of(F.col("props"))).alias("entry"))
    kept = run_to_table(jobs.deduplicated(entries, "entry", "ts", "40 days"), "dedup")
    return kept.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("entry").alias("distinct_entries"))


@query(
    "stream_route",
    """
    SELECT CASE WHEN value > 100 THEN 'anomalies' ELSE 'clean' END AS route, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1
    """,
)
def stream_route(spark, sf_dir):
    out = scratch_dir(spark, "routes")

    def sink(name):
        # The epoch names the folder, so a replayed micro-batch overwrites its own output.
        return lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{out}/route={name}/epoch={epoch}")

    running = jobs.start_routed(
        event_stream(spark, sf_dir), lambda batch: jobs.scored_routes(batch, "value", 100.0),
        {"anomalies": sink("anomalies"), "clean": sink("clean")}, f"{out}-state",
    )
    running.awaitTermination()
    return spark.read.parquet(out).groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("stream_user_index", "SELECT user_id, count(*) AS n, 0 AS first_index, count(*) - 1 AS last_index, count(*) AS distinct_indexes FROM events GROUP BY 1")
def stream_user_index(spark, sf_dir):
    state.rocksdb(spark)
    rows = event_stream(spark, sf_dir).select("user_id", "event_id")
    indexed = run_to_table(state.with_running_index(rows, "user_id"), "index")
    return indexed.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_index").cast("int").alias("first_index"), F.max("row_index").alias("last_index"),
        F.count_distinct("row_index").alias("distinct_indexes"),
    )


@query(
    "stream_train_window",
    """
    WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS from_end, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, event_id FROM r WHERE n >= 60 AND from_end <= greatest(40, n)
    """,
)
def stream_train_window(spark, sf_dir):
    state.rocksdb(spark)
    rows = event_stream(spark, sf_dir).select("user_id", "event_id", "ts", "value")
    windows = state.training_windows(rows, "user_id", "ts", ["event_id", "ts", "value"], 60, 20, 40)
    out = run_to_table(windows, "windows")
    return out.select(F.col("user").cast("bigint").alias("user_id"), F.col("event_id").cast("bigint").alias("event_id"))


@query(
    "stream_snapshots",
    """
    WITH s AS (SELECT user_id, CAST(epoch_us(date_trunc('day', ts)) // 86400000000 AS BIGINT) AS snapshot_id, count(*) AS n FROM events GROUP BY 1, 2),
    w AS (SELECT user_id, snapshot_id, lead(snapshot_id, 2) OVER v AS third, n + lead(n, 1) OVER v + lead(n, 2) OVER v AS total FROM s WINDOW v AS (PARTITION BY user_id ORDER BY snapshot_id))
    SELECT CAST(user_id AS VARCHAR) AS key, snapshot_id || '-' || third AS sequence, CAST(total AS DOUBLE) AS total FROM w WHERE third - snapshot_id = 2
    """,
)
def stream_snapshots(spark, sf_dir):
    state.rocksdb(spark)
    day = F.floor(F.unix_seconds("ts") / 86400).alias("snapshot_id")
    daily = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", day).agg(
        F.count(F.lit(1)).alias("n")
    )
    # The snapshots are written first: they are what the stream of snapshots reads.
    source = scratch_dir(spark, "snapshots")
    daily.write.parquet(source)
    stream = spark.readStream.schema(daily.schema).parquet(source)
    out = run_to_table(state.snapshot_windows(stream, "user_id", "snapshot_id", ["n"], 3), "snapshot-windows")
    return out.select("key", "sequence", F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("stream_collections", "SELECT 'label_' || label AS collection, count(*) AS n FROM embeddings GROUP BY 1")
def stream_collections(spark, sf_dir):
    """Vectors streamed into one folder per collection."""
    stream = table_stream(spark, sf_dir, "embeddings")
    out = scratch_dir(spark, "collections")
    tagged = stream.withColumn("collection", F.concat(F.lit("label_"), F.col("label").cast("string")))
    writers.start_collections(tagged, out, f"{out}-state", available_now=True).awaitTermination()
    # The schema is given: a stream without rows writes no file to take it from.
    return spark.read.schema(tagged.schema).parquet(out).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@query("stream_newer_only", "SELECT count(*) AS n FROM events")
def stream_newer_only(spark, sf_dir):
    state.rocksdb(spark)
    rows = event_stream(spark, sf_dir).select("user_id", "event_id", "ts")
    return run_to_table(state.newer_only(rows, "user_id", "ts"), "newer").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_timeseries_flags",
    """
    -- the reconstruction keeps the strongest tenth of the frequencies; stated as sums over each 25-bin window
    WITH e AS (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS bin FROM events),
    c AS (SELECT user_id, bin, count(*) AS n FROM e GROUP BY ALL),
    f AS (SELECT user_id, min(bin) AS first FROM c GROUP BY 1),
    m AS (SELECT user_id, bin FROM c JOIN f USING (user_id) WHERE first <= bin - 12),
    s AS (SELECT m.user_id, m.bin, i.i, coalesce(c.n, 0)::DOUBLE AS x FROM m CROSS JOIN (SELECT unnest(range(0, 25)) AS i) i
          LEFT JOIN c ON c.user_id = m.user_id AND c.bin = m.bin - 12 + i.i),
    z AS (SELECT *, avg(x) OVER w AS mu, stddev_pop(x) OVER w AS sd FROM s WINDOW w AS (PARTITION BY user_id, bin)),
    k AS (SELECT user_id, bin, k, sum(x * cos(2 * pi() * k * i / 25)) AS re, -sum(x * sin(2 * pi() * k * i / 25)) AS im,
                 sum((x - mu) * cos(2 * pi() * k * i / 25)) AS cr, sum((x - mu) * sin(2 * pi() * k * i / 25)) AS ci, any_value(sd) AS sd
          FROM z CROSS JOIN (SELECT unnest(range(0, 13)) AS k) GROUP BY ALL),
    p AS (SELECT *, (cr * cr + ci * ci) / 25 / (CASE WHEN sd = 0 THEN 1 ELSE sd * sd END) AS energy FROM k),
    t AS (SELECT user_id, bin, quantile_cont(energy, 0.9) AS least FROM p GROUP BY ALL),
    r AS (SELECT z.user_id, z.bin, z.i, any_value(z.x) AS x,
                 sum(CASE WHEN p.energy < t.least THEN 0 ELSE (CASE WHEN p.k = 0 THEN 1 ELSE 2 END)
                     * (p.re * cos(2 * pi() * p.k * z.i / 25) - p.im * sin(2 * pi() * p.k * z.i / 25)) END) / 25 AS y
          FROM z JOIN p USING (user_id, bin) JOIN t USING (user_id, bin) GROUP BY ALL),
    d AS (SELECT *, abs(y - x) AS err FROM r),
    q AS (SELECT *, avg(err) OVER w AS me, stddev_pop(err) OVER w AS se FROM d WINDOW w AS (PARTITION BY user_id, bin)),
    flags AS (SELECT user_id, bin FROM q WHERE i = 12 AND se > 0 AND abs(err - me) / se >= 3)
    SELECT CAST(e.user_id AS VARCHAR) AS user, e.event_id AS row_id, flags.bin IS NOT NULL AS ts_anomaly
    FROM e LEFT JOIN flags USING (user_id, bin)
    """,
)
def stream_timeseries_flags(spark, sf_dir):
    state.rocksdb(spark)
    folder, columns = scratch_dir(spark, "feed"), ["user_id", "event_id", "ts"]
    feed_in_order(table(spark, sf_dir, "events").select(*columns), "ts", folder, closing=True)
    rows = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return run_to_table(state.windowed_flags(rows, "user_id", "ts", "event_id", zthresh=3), "flags")


def feed_in_order(rows: DataFrame, ts: str, folder: str, parts: int = 3, closing: bool = False) -> None:
    """Write a table as the files of a stream in time order, one per micro-batch.

    ``closing`` adds a last file with one empty row a year later: the end of the input, which moves the
    watermark past every open window, so that a stream that holds rows back gives all of them.
    """
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    span = rows.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    if span["lo"] is None:
        rows.write.parquet(folder)
        return
    width = (span["hi"] - span["lo"]) / parts
    for k in range(parts):
        part = rows.filter(F.col(ts) >= F.lit(span["lo"] + k * width)) if k else rows
        part = part.filter(F.col(ts) < F.lit(span["lo"] + (k + 1) * width)) if k < parts - 1 else part
        part.write.mode("append").parquet(folder)
    if closing:
        end = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != ts]
        last = rows.sparkSession.range(1).select(*end, F.lit(span["hi"] + timedelta(days=365)).cast("timestamp").alias(ts))
        last.select(*rows.columns).write.mode("append").parquet(folder)


SCORED_PARTS = 4
SCORED_SQL = """
    b AS (SELECT min(epoch_us(ts)) AS lo, (max(epoch_us(ts)) - min(epoch_us(ts))) // 4 AS w FROM events),
    p AS (SELECT event_id, user_id, ts, value, event_type AS app, least((epoch_us(ts) - lo) // w, 3) AS part, date_trunc('day', ts) AS day FROM events, b),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS n_today, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n_total,
                 CASE WHEN row_number() OVER (PARTITION BY user_id, day, app ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS fresh FROM p),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS values_today FROM f),
    sp AS (SELECT CAST(user_id AS VARCHAR) AS su, * FROM r WHERE part = 0 UNION ALL SELECT 'generic_user', * FROM r WHERE part = 0),
    st AS (SELECT su, count(*) AS n, avg(value) AS m1, coalesce(nullif(stddev_samp(value), 0), 1) AS s1, avg(n_today) AS m2, coalesce(nullif(stddev_samp(n_today), 0), 1) AS s2,
                  avg(values_today) AS m3, coalesce(nullif(stddev_samp(values_today), 0), 1) AS s3 FROM sp GROUP BY 1),
    cc AS (SELECT su, app, count(*) AS c FROM sp GROUP BY 1, 2),
    ct AS (SELECT su, sum(c) AS n, sum(CASE WHEN c < 3 THEN c ELSE 0 END) AS rare, count(*) FILTER (WHERE c >= 3) AS v FROM cc GROUP BY 1),
    cp AS (SELECT cc.su, app, (c + 1) / (n + v + 1) AS p FROM cc JOIN ct ON ct.su = cc.su WHERE c >= 3),
    co AS (SELECT su, (rare + 1) / (n + v + 1) AS po FROM ct),
    last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, part ORDER BY ts DESC, event_id DESC) = 1),
    ev AS (SELECT coalesce(st.su, 'generic_user') AS su, last.* FROM last LEFT JOIN st ON st.su = CAST(last.user_id AS VARCHAR) AND st.n >= 15),
    l AS (SELECT e.*, pow((value - m1) / s1, 2) AS l1, pow((n_today - m2) / s2, 2) AS l2, pow((values_today - m3) / s3, 2) AS l3, -ln(coalesce(cp.p, po)) AS l4
          FROM (SELECT 'train' AS kind, * FROM sp UNION ALL SELECT 'score', * FROM ev) e JOIN st ON st.su = e.su JOIN co ON co.su = e.su LEFT JOIN cp ON cp.su = e.su AND cp.app = e.app),
    lm AS (SELECT su, avg(l1) AS a1, stddev_pop(l1) AS d1, avg(l2) AS a2, stddev_pop(l2) AS d2, avg(l3) AS a3, stddev_pop(l3) AS d3, avg(l4) AS a4, stddev_pop(l4) AS d4
           FROM l WHERE kind = 'train' GROUP BY 1),
    z AS (SELECT l.*, (abs((l1 - a1) / coalesce(nullif(d1, 0), 1)) + abs((l2 - a2) / coalesce(nullif(d2, 0), 1)) + abs((l3 - a3) / coalesce(nullif(d3, 0), 1))
                       + abs((l4 - a4) / coalesce(nullif(d4, 0), 1))) / 4 AS mean_abs_z FROM l JOIN lm ON lm.su = l.su WHERE kind = 'score')"""


def scored_parts(rows: DataFrame, parts: int = SCORED_PARTS) -> list[DataFrame]:
    """The table in time order, cut into equal spans of time: what arrives between two runs of the stream."""
    us = F.unix_micros("ts")
    span = rows.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first()
    width = max(1, ((span["hi"] or 0) - (span["lo"] or 0)) // parts)
    part = F.least(F.floor((us - F.lit(span["lo"] or 0)) / width), F.lit(parts - 1))
    return [rows.filter(part == k) for k in range(parts)]


@query(
    "stream_scored",
    f"""
    WITH {SCORED_SQL}
    SELECT CASE WHEN mean_abs_z > 1.2 THEN 'anomalies' ELSE 'clean' END AS route, part AS epoch, user_id, event_id, su AS split_user, n_total, n_today, values_today,
           round(mean_abs_z, 5) AS mean_abs_z, CASE WHEN mean_abs_z > 1.2 THEN CASE WHEN mean_abs_z > 5 THEN 'CRITICAL' WHEN mean_abs_z >= 3 THEN 'HIGH'
             WHEN mean_abs_z >= 2.5 THEN 'MEDIUM' WHEN mean_abs_z > 2 THEN 'LOW' ELSE 'NONE' END END AS severity
    FROM z
    """,
)
def stream_scored(spark, sf_dir):
    """Four runs of the scored stream over one checkpoint; both sinks read back, with the epoch that wrote each row."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    parts = scored_parts(rows)
    trained = scored.training_features(parts[0], "user_id", "ts", "event_id", "event_type")
    folder, feed = scratch_dir(spark, "scored"), scratch_dir(spark, "arrivals")
    scoring.save_model(scoring.fit(trained, "user_id", ["value", "n_today", "values_today"], ["event_type"], min_cats=3), f"{folder}/model")
    job = scored.ScoredStream(
        scoring.load_model(spark, f"{folder}/model"), f"{folder}/carry", "user_id", "ts", "event_id", "event_type", 1.2, min_rows=15, every=3,
        sinks={name: scored.epoch_sink(f"{folder}/out", name) for name in ("anomalies", "clean", "late")},
    )
    for part in parts:
        part.write.mode("append").parquet(feed)
        job.start(spark.readStream.schema(rows.schema).parquet(feed), f"{folder}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    columns = ["route", "epoch", "user_id", "event_id", "split_user", "n_total", "n_today", "values_today", "severity"]
    return out.select(*columns, F.round("mean_abs_z", 5).alias("mean_abs_z"))
