"""What one task holds in the graph queries does not grow with the table."""

from pyspark.sql import functions as F

from tidemark import registry, session
from tidemark.operators import graph

registry.load_all()


def test_pairs_are_made_unique_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    df = spark.range(2000).select((F.col("id") % 700).alias("c"), (F.col("id") % 900).alias("t"), (F.col("id") % 11).alias("m"))
    edges = graph.transaction_edges(df, "c", "t", "m", 2000)
    assert edges.filter("rel = 'buy'").rdd.getNumPartitions() >= 40
    assert edges.count() == edges.distinct().count() == 2 * (df.select("c", "t").distinct().count() + df.select("t", "m").distinct().count())


def test_entity_sets_score_the_events_once(spark):
    out = registry.QUERIES["user_entity_sets"](spark, "/root/testdata/sf0.001")
    assert "events.parquet" not in out._jdf.queryExecution().executedPlan().toString()
