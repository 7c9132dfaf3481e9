"""The split path of ordered analytics must equal the plain window, also under heavy skew and ties."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import ordered, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """One user with two thirds of the rows, a null user, tied timestamps and null values."""
    rows = []
    for i in range(300):
        user = "big" if i % 3 else (None if i % 9 == 0 else f"u{i % 4}")
        rows.append((user, i // 40, i, f"v{i % 7}" if i % 5 else None, float((i * 37) % 101)))
    return spark.createDataFrame(rows, "user string, ts int, id int, val string, x double").repartition(5).cache()


def values(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def plain():
    return Window.partitionBy("user").orderBy("ts", "id")


def test_blocks_are_bounded(spark, skewed, hot):
    blocks = ordered.blocked(skewed, ["user"], ["ts", "id"])
    assert blocks.hot is not None
    largest = blocks.rows.groupBy("user", ordered.BLOCK).count().agg(F.max("count")).first()[0]
    assert largest < 60


def test_row_index(skewed, hot):
    got = ordered.row_index(skewed, ["user"], ["ts", "id"], "i")
    want = skewed.withColumn("i", F.row_number().over(plain()) - 1)
    assert values(got, "id", "i") == values(want, "id", "i")


def test_row_index_without_keys(skewed, hot):
    got = ordered.row_index(skewed, [], ["ts", "id"], "i")
    assert [r["i"] for r in got.orderBy("ts", "id").collect()] == list(range(300))


def test_running_sum(skewed, hot):
    got = ordered.running_sum(skewed, ["user"], ["ts", "id"], F.col("x"), "s")
    want = skewed.withColumn("s", F.sum("x").over(plain().rowsBetween(Window.unboundedPreceding, 0)))
    assert values(got, "id", "s") == values(want, "id", "s")


def test_running_distinct(skewed, hot):
    got = ordered.running_columns(
        skewed, ["user"], ["ts", "id"], index=["i"], distinct={"n": F.coalesce("val", F.lit("nan"))}
    )
    first = Window.partitionBy("user", "val").orderBy("ts", "id")
    want = skewed.withColumn("new", (F.row_number().over(first) == 1).cast("int")).withColumn(
        "n", F.sum("new").over(plain().rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("i", F.row_number().over(plain()) - 1)
    assert values(got, "id", "n", "i") == values(want, "id", "n", "i")


@pytest.mark.parametrize(("before", "after"), [(1, 0), (0, 2), (9, 3)])
def test_framed(skewed, hot, before, after):
    def columns(w):
        return {"s": F.sum("x").over(w.rowsBetween(-before, after)), "p": F.lag("id").over(w) if before else F.lit(0)}

    got = ordered.framed(skewed, ["user"], ["ts", "id"], before, after, columns)
    want = skewed.withColumns(columns(plain()))
    assert values(got, "id", "s", "p") == values(want, "id", "s", "p")


@pytest.mark.parametrize("forward", [True, False])
def test_fill_last(skewed, hot, forward):
    got = ordered.fill_last(skewed, ["user"], ["ts", "id"], "val", "f", forward)
    if forward:
        pick = F.last("val", True).over(plain().rowsBetween(Window.unboundedPreceding, 0))
    else:
        pick = F.first("val", True).over(plain().rowsBetween(0, Window.unboundedFollowing))
    assert values(got, "id", "f") == values(skewed.withColumn("f", pick), "id", "f")


@pytest.mark.parametrize("keys", [[], ["user"]])
def test_quantiles(skewed, hot, keys):
    got = quantiles.quantiles(skewed, keys, "x", {"a": 0.5, "b": 0.9})
    want = skewed.groupBy(*keys).agg(F.percentile("x", 0.5).alias("a"), F.percentile("x", 0.9).alias("b"))
    rounded = [F.round("a", 9), F.round("b", 9)]
    assert values(got, *keys, *rounded) == values(want, *keys, *rounded)


def test_top_k(skewed):
    got = ordered.top_k(skewed, ["user"], 3, F.desc("x"), F.asc("id"))
    assert got.groupBy("user").count().agg(F.max("count")).first()[0] == 3


def test_checkpoint_folder_comes_from_the_session(spark, skewed):
    session.ensure_checkpoint_dir(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
