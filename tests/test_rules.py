"""Results must not depend on size settings, on where a job runs, or on how a stream ends."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import ordered, scoring, snapshots, spectral, tables
from tidemark.sources import batches
from tidemark.sources import security_logs as sl


def test_event_anomalies_do_not_depend_on_the_hot_key_setting(spark):
    signal = np.sin(np.arange(400) / 9.0)
    signal[[111, 250]] += 9
    df = spark.createDataFrame([("u", i, i, float(v)) for i, v in enumerate(signal)], "u string, ts long, id long, v double")
    found = lambda: sorted(r.id for r in spectral.event_anomalies(df, "u", "ts", "id", "v").collect())
    usual = found()
    spark.conf.set(session.HOT_ROWS_KEY, "100")
    try:
        assert found() == usual and usual
    finally:
        spark.conf.unset(session.HOT_ROWS_KEY)


def test_zeek_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.log").write_text("#fields\tts\tuid\n#types\ttime\tstring\n1.5\tC1\n")
    (tmp_path / "b.log").write_text("#fields\tuid\tts\tn\n#types\tstring\ttime\tcount\nC2\t9.5\t3\n")
    rows = sl.read_zeek(spark, str(tmp_path)).select("ts", "uid", "n").orderBy("ts").collect()
    assert [tuple(r) for r in rows] == [(1.5, "C1", None), (9.5, "C2", 3)]
    (tmp_path / "c.log").write_text("#fields\tts\n#types\tstring\nx\n")
    with pytest.raises(ValueError, match="ts is both"):
        sl.read_zeek(spark, str(tmp_path))


def test_latest_rows_sort_no_whole_rows(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("k"), F.lit("text").alias("t"))
    for out in (
        tables.latest_version(df, ["k"], "id"), tables.best_entities(df, "k", "t", "t", "id"), ordered.latest(df, ["k"], "id"),
        batches.sample_files(df.withColumn("ts", F.timestamp_seconds("id")), "ts", "t", "day"),
    ):
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in ordered.latest(df, ["k"], "id").collect()) == list(range(93, 100))


def test_snapshot_features_aggregate_by_hash(spark):
    from tidemark.plans.profiles import snapshot_rows

    plan = snapshots.snapshot_features(snapshot_rows(spark, "/root/testdata/sf0.001"), ["docx"])
    assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_unknown_loss_scalers_are_refused(spark):
    df = spark.createDataFrame([("u", float(i), "c") for i in range(6)], "user string, x double, c string")
    model = scoring.fit(df, "user", ["x"], ["c"])
    assert scoring.score(df, "user", model).count() == 6
    with pytest.raises(ValueError, match="modz"):
        scoring.score(df, "user", model, scaler="modz")
    with pytest.raises(ValueError, match="robust"):
        scoring.fit(df, "user", ["x"], ["c"], scalers=("robust",))


def test_bin_flags_find_a_burst(spark):
    hours = [h for h in range(200) for _ in range(30 if h == 120 else 1)]
    df = spark.createDataFrame([("u", i, h * 3600) for i, h in enumerate(hours)], "u string, id long, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    out = spectral.bin_flags(df, "u", "ts", zthresh=3).collect()
    assert len(out) == len(hours) and {r.s // 3600 for r in out if r.ts_anomaly} == {120}


def test_scratch_folders_are_removed(spark):
    kept, spark.sparkContext._tidemark_folders = getattr(spark.sparkContext, "_tidemark_folders", []), []
    table = session.durable(spark.range(5))
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and session.remove_scratch(spark) == 1 and not folder.exists()
    spark.sparkContext._tidemark_folders = kept


def test_workers_find_the_package_from_anywhere(tmp_path):
    """A job started in another folder, without a path to the sources in its environment."""
    root = Path(__file__).resolve().parents[1]
    job = (
        f"import sys; sys.path.insert(0, {str(root)!r}); import __spark_entry__ as e; from tidemark import session\n"
        "spark = session.local_session('2', shuffle_partitions=2)\n"
        "sys.path.remove(sys.path[0])\n"
        "print('ROWS', e.queries()['cosine_topk'](spark, '/root/testdata/sf0.001').count(), e.queries()['chunk_separators'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", job], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-800:]


def test_a_short_last_segment_joins_the_one_before(spark):
    rows = [(u, float(i), i + k, 500.0 if i == n - 1 else float(i % 2)) for u, n, k in (("a", 101, 0), (None, 105, 1000), ("c", 9, 2000)) for i in range(n)]
    df = spark.createDataFrame(rows, "u string, ts double, id long, v double")
    got = spectral.event_anomalies(df, "u", "ts", "id", "v", segment=100)
    assert sorted(r.id for r in got.collect()) == [100, 1104]
    assert got.columns == df.columns


def test_flags_keep_rows_of_a_null_user(spark):
    rows = [(None if i % 4 == 0 else f"u{i % 2}", i, i * 1800) for i in range(200)]
    df = spark.createDataFrame(rows, "u string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    df = df.withColumn("day", F.to_date("ts"))
    for out in (spectral.timeseries_flags(df, "u", "ts", "day", zthresh=3), spectral.bin_flags(df, "u", "ts", zthresh=3)):
        assert out.count() == 200 and out.filter("u is null").count() == 50


def test_zeek_files_without_a_header_are_refused(spark, tmp_path):
    (tmp_path / "a.log").write_text("#fields\tts\tuid\n#types\ttime\tstring\n1.5\tC1\n")
    (tmp_path / "b.log").write_text("2.5\tC2\n")
    with pytest.raises(ValueError, match="b.log"):
        sl.read_zeek(spark, str(tmp_path))
