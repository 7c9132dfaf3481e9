"""Sources, sinks and stateful streams on files written by the test."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch_dir
from tidemark.sinks import writers
from tidemark.sources import batches, files, kafka, security_logs as sl
from tidemark.streaming import jobs, state


def test_formats_and_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, data string")
    for fmt in ("csv", "jsonlines", "parquet"):
        path = str(tmp_path / f"x.{fmt}")
        writers.write_file(df, path)
        with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
            writers.write_file(df, path)
        writers.write_file(df, path, overwrite=True)
        assert files.read_files(spark, path, filter_nulls=True).count() == 1
    with pytest.raises(ValueError, match="format"):
        files.format_of("x.bin")


def test_file_batches(spark, tmp_path):
    for name in ("log_2022-08-01T10_00_00.json", "log_2022-08-01T12_30_00.json", "log_2022-08-04T00_00_00.json", "other_2022-09-09.json"):
        (tmp_path / name).write_text(json.dumps({"v": name}) + "\n")
    rows = spark.read.schema("v string").json(str(tmp_path))
    got = files.file_batches(rows, "day", "2022-08-01 00:00:00", "2022-08-04 00:00:00").collect()
    assert len(got) == 3 and {r["n_groups"] for r in got} == {4}
    assert sorted((str(r["period"])[:10], r["batch_count"]) for r in got) == [("2022-08-01", 2), ("2022-08-01", 2), ("2022-08-04", 1)]
    assert len({r["origin_hash"] for r in got}) == 2
    listed = files.list_files(rows)
    first = batches.sample_files(listed, "file_time", "file_path", "day").collect()
    assert len(first) == 3 and any("T10" in r["file_path"] for r in first)
    assert batches.sample_files(listed, "file_time", "file_path", 2).count() == 2


def test_cloud_trail(spark, tmp_path):
    for i, account in enumerate(["123", "abc"]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"Records": [{"eventName": "x", "userIdentity": {"accountId": account}}] * 2}, indent=1))
    rows = sl.read_cloud_trail(spark, str(tmp_path), "eventName STRING, userIdentity STRUCT<accountId: STRING>")
    assert sorted(r["userIdentityaccountId"] for r in rows.collect()) == ["Account-123", "Account-123", "abc", "abc"]


def test_sign_ins_and_auth_log(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"time": "t", "properties": {"app_name": "x", "device": {"os": "y"}}}\n')
    schema = "time STRING, properties STRUCT<app_name: STRING, device: STRUCT<os: STRING>>"
    assert sl.read_sign_ins(spark, str(tmp_path), schema).columns == ["time", "propertiesappname", "propertiesdeviceos"]
    assert sl.read_auth_log(spark, str(tmp_path), schema).columns == ["time", "properties.app_name", "properties.device.os"]


def test_zeek(spark, tmp_path):
    (tmp_path / "conn.log").write_text("#separator \\x09\n#fields\tts\tuid\tok\tn\n#types\ttime\tstring\tbool\tcount\n1.5\tC1\tT\t-\n2.5\tC2\tF\t7\n#close x\n")
    got = sl.read_zeek(spark, str(tmp_path))
    assert [tuple(r) for r in got.orderBy("ts").collect()] == [(1.5, "C1", True, None), (2.5, "C2", False, 7)]


def test_snapshots_take_fields_from_the_path(spark, tmp_path):
    folder = tmp_path / "host1" / "snapshot-3-2021-01-01_10_00_00"
    folder.mkdir(parents=True)
    (folder / "envars_2021.json").write_text(json.dumps({"titles": ["PID", "Value"], "data": [["1", "a"], ["2", "b"]]}))
    (folder / "handles_2021.json").write_text("{broken")
    (folder / "vadinfo_2021.json").write_bytes(json.dumps({"titles": ["PID"], "data": [["é"]]}, ensure_ascii=False).encode("latin-1"))
    rows = sl.read_snapshots(spark, str(tmp_path), ["PID", "Value", "Tag"]).orderBy("plugin", "row_id").collect()
    assert [(r["source"], r["snapshot_id"], r["plugin"], r["PID"], r["Value"], r["Tag"]) for r in rows] == [
        ("host1", 3, "envars", "1", "a", None), ("host1", 3, "envars", "2", "b", None), ("host1", 3, "vadinfo", "é", None, None),
    ]


def test_kafka_plans_and_corrupt_records(spark):
    options = kafka.kafka_options("host:1", ["a", "b"], "g", "earliest", 100)
    assert options["subscribe"] == "a,b" and options["maxOffsetsPerTrigger"] == "100"
    raw = spark.createDataFrame([('{"a": 1}',), ("{oops",)], "value string")
    got = kafka.parse_json_values(raw, "a INT").collect()
    assert [(r["a"], r["_corrupt_record"]) for r in got] == [(1, None), (None, "{oops")]


def test_merge_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    writers.merge_into(spark, path, df, ["id"], "9")
    writers.merge_into(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"], "10")
    latest = writers.latest_version_path(spark, path)
    assert latest.endswith("version=10")
    assert sorted(map(tuple, spark.read.parquet(latest).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert writers.with_missing_columns(df, {"v": "string", "w": "int"}).columns == ["v", "w"]




def run(spark, make, parts, schema, tmp_path):
    state.rocksdb(spark)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(source))
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


SCHEMA = "u string, id long, ts timestamp"


def stamped(spark_rows):
    from datetime import datetime, timedelta

    return [(u, i, datetime(2024, 1, 1) + timedelta(minutes=m)) for u, i, m in spark_rows]


def test_running_index_across_batches(spark, tmp_path):
    parts = [stamped([("a", 1, 0), ("b", 2, 0)]), stamped([("a", 3, 1), ("a", 4, 2)])]
    got = run(spark, lambda s: state.with_running_index(s, "u"), parts, SCHEMA, tmp_path)
    assert sorted((r["u"], r["row_index"]) for r in got.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_late_rows_are_dropped(spark, tmp_path):
    parts = [stamped([("a", 1, 5), ("a", 2, 3)]), stamped([("a", 3, 5), ("a", 4, 6), ("b", 5, 0)])]
    got = run(spark, lambda s: state.newer_only(s, "u", "ts"), parts, SCHEMA, tmp_path)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 4, 5]


def test_training_window_state(spark, tmp_path):
    parts = [stamped([("a", i, i) for i in range(3)]), stamped([("a", i, i) for i in range(3, 6)]), stamped([("a", 6, 6)]), stamped([("a", 7, 7), ("a", 8, 8)])]
    got = run(spark, lambda s: state.training_windows(s, "u", "ts", ["id"], 5, 3, 4), parts, SCHEMA, tmp_path)
    # First window: six rows, all new, so none is cut to the four of max_history; second: the last four.
    assert sorted((r["window_rows"], int(r["id"])) for r in got.collect()) == [(4, i) for i in range(5, 9)] + [(6, i) for i in range(6)]


def test_snapshot_windows_roll_over(spark, tmp_path):
    parts = [[("h", 1, 1.0), ("h", 2, 2.0)], [("h", 3, 3.0), ("h", 5, 5.0)]]
    got = run(spark, lambda s: state.snapshot_windows(s, "k", "sid", ["x"], 3), parts, "k string, sid long, x double", tmp_path)
    assert [(r["sequence"], r["data"]) for r in got.collect()] == [("1-3", [1.0, 2.0, 3.0])]


def test_windowed_flags_wait_for_the_window(spark, tmp_path):
    hours = [("a", 1000 * h + n, 60 * h) for h in range(60) for n in range(30 if h == 30 else 1 + h % 2)]
    parts = [stamped([x for x in hours if x[2] < 60 * 20]), stamped([x for x in hours if x[2] >= 60 * 20])]
    got = run(spark, lambda s: state.windowed_flags(s, "u", "ts", "id", min_window_s=43200, zthresh=3), parts, SCHEMA, tmp_path)
    flagged = {r["row_id"] // 1000 for r in got.filter("ts_anomaly").collect()}
    assert flagged == {30} and got.count() == got.select("row_id").distinct().count() < len(hours)


def test_routed_sinks(spark, tmp_path):
    source = tmp_path / "src"
    spark.createDataFrame([(1, 5.0), (2, 0.5)], "id int, score double").write.parquet(str(source))
    stream = spark.readStream.schema("id int, score double").parquet(str(source))
    out = scratch_dir(spark, "t")
    sinks = {n: (lambda rows, epoch, n=n: rows.write.mode("overwrite").parquet(f"{out}/{n}/{epoch}")) for n in ("anomalies", "clean")}
    jobs.start_routed(stream, lambda b: jobs.scored_routes(b, "score", 2.0), sinks, str(tmp_path / "c")).awaitTermination()
    row = spark.read.parquet(f"{out}/anomalies/0").first()
    assert row["id"] == 1 and row["severity"] == "HIGH" and spark.read.parquet(f"{out}/clean/0").count() == 1


def test_compaction_and_scores_by_period(spark, tmp_path):
    df = spark.createDataFrame([("u", f"2024-01-0{d} 00:00:00", 1.0 * d) for d in range(1, 5)], "u string, t string, x_z_loss double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    writers.compact(df, str(tmp_path / "c"), "ts", "u")
    kept = writers.drop_old(spark.read.parquet(str(tmp_path / "c")), "date", F.lit("2024-01-05").cast("timestamp_ntz"), 2)
    assert kept.count() == 2
    writers.write_scores_by_period(df, str(tmp_path / "s"), "u", "ts", ["x"], "x_z_loss")
    assert sorted(p.name for p in (tmp_path / "s").glob("period=*")) == [f"period=2024-01-0{d}" for d in range(1, 5)]
