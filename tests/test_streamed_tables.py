"""Streams over tables that are folders of files, as large tables are, and over tables without rows."""

from tidemark import registry
from tidemark.plans.streams import event_stream, run_to_table

registry.load_all()
SF = "/root/testdata/sf0.001"


def folder_table(spark, tmp_path, name, rows=None):
    df = spark.read.parquet(f"{SF}/{name}.parquet")
    df = df if rows is None else df.limit(rows)
    df.repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return df


def test_collections_of_a_folder_table(spark, tmp_path):
    rows = folder_table(spark, tmp_path, "embeddings")
    got = registry.QUERIES["stream_collections"](spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in got) == rows.count() > 0
    assert {r["collection"] for r in got} == {f"label_{r['label']}" for r in rows.select("label").distinct().collect()}


def test_collections_without_rows(spark, tmp_path):
    folder_table(spark, tmp_path, "embeddings", rows=0)
    assert registry.QUERIES["stream_collections"](spark, str(tmp_path)).collect() == []


def test_events_of_a_folder_table(spark, tmp_path):
    rows = folder_table(spark, tmp_path, "events")
    assert run_to_table(event_stream(spark, str(tmp_path)), "folder-events").count() == rows.count() > 0
