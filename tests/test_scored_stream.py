"""The scored stream: restarts, hot users, late rows and the carry between micro-batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import scoring
from tidemark.streaming import carry, scored

SCHEMA = "event_id long, user_id long, value double, event_type string, ts timestamp"


def events(n=240, users=6):
    """User 0 owns half of all rows."""
    start = datetime(2024, 3, 1)
    return [
        (i, 0 if i % 2 else i % users, float(i % 17), "abc"[i % 3] if i % 11 else None, start + timedelta(minutes=37 * i)) for i in range(n)
    ]


def job(spark, folder, model, **sinks):
    own = {name: sinks.get(name) or scored.epoch_sink(f"{folder}/out", name) for name in ("anomalies", "clean", "late")}
    return scored.ScoredStream(model, f"{folder}/carry", "user_id", "ts", "event_id", "event_type", 1.0, every=2, sinks=own)


@pytest.fixture
def model(spark):
    rows = spark.createDataFrame(events()[:120], SCHEMA)
    trained = scored.training_features(rows, "user_id", "ts", "event_id", "event_type")
    return scoring.fit(trained, "user_id", ["value", "n_today", "values_today"], ["event_type"])


def fed(spark, rows, k, feed):
    spark.createDataFrame(rows[k * 60 : (k + 1) * 60], SCHEMA).write.mode("append").parquet(feed)
    return spark.readStream.schema(SCHEMA).parquet(feed)


def written(spark, folder):
    out = spark.read.parquet(f"{folder}/out").select("route", "epoch", "event_id", "n_total", "n_today", "values_today", F.round("mean_abs_z", 6).alias("z"))
    return sorted(map(tuple, out.collect()), key=str)


def test_a_restart_in_the_middle_gives_the_same_files(spark, model):
    results = []
    for broken in (False, True):
        folder, feed = session.scratch_dir(spark, "run"), session.scratch_dir(spark, "feed")
        tries = {"n": 0}

        def clean(rows, epoch, folder=folder, tries=tries, broken=broken):
            tries["n"] += 1
            if broken and epoch == 1 and tries["n"] == 2:
                raise RuntimeError("lost after the anomalies of epoch 1 were written")
            scored.epoch_sink(f"{folder}/out", "clean")(rows, epoch)

        for k in range(3):
            stream = fed(spark, events(), k, feed)
            running = job(spark, folder, model, clean=clean).start(stream, f"{folder}/checkpoint")
            if broken and k == 1:
                with pytest.raises(Exception, match="lost after"):
                    running.awaitTermination()
                running = job(spark, folder, model, clean=clean).start(stream, f"{folder}/checkpoint")
            running.awaitTermination()
        results.append(written(spark, folder))
    assert results[0] == results[1] and {r[1] for r in results[0]} == {0, 1, 2}
    assert {r[0] for r in results[0]} >= {"anomalies", "clean"}


def test_features_of_batches_equal_those_of_the_table(spark, hot):
    """Also where the user with half of the rows is split over tasks (``hot``)."""
    rows = events()
    whole = scored.training_features(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_id", "event_type")
    names = ["event_id", "n_total", "n_today", "values_today"]
    expected = sorted(map(tuple, whole.select(*names).collect()))
    seen, days = {}, {}
    plain = []
    for i, user, _, kind, ts in rows:
        seen[user] = seen.get(user, 0) + 1
        today = days.setdefault((user, ts.date()), [0, set()])
        today[0] += 1
        today[1].add(kind)
        plain.append((i, seen[user], today[0], len(today[1])))
    assert expected == sorted(plain)
    folder, got = session.scratch_dir(spark, "carry"), []
    for epoch in range(3):
        batch = spark.createDataFrame(rows[epoch * 80 : (epoch + 1) * 80], SCHEMA)
        users, values = carry.carries(spark, folder, "user_id", "event_type", ("bigint", "string"), every=2)
        for _ in range(1 + (epoch == 1)):  # one epoch is replayed
            out = session.durable(carry.running_features(batch, users.before(epoch), values.before(epoch), "user_id", "ts", "event_id", "event_type"))
            last = scored.ordered.latest(out, ["user_id"], "ts", "event_id").withColumns({"last_ts": F.col("ts"), "last_id": F.col("event_id")})
            users.write(epoch, last)
            values.write(epoch, out.groupBy("user_id", "event_type").agg(F.max("day").alias("day")))
        got += map(tuple, out.select(*names).collect())
    assert sorted(got) == expected


def test_late_rows_are_kept_apart(spark, model):
    folder, feed = session.scratch_dir(spark, "late"), session.scratch_dir(spark, "feed")
    rows = events()[60:120]
    old = [(1000, 2, 1.0, "a", datetime(2020, 1, 1)), (1001, 99, 1.0, "a", datetime(2020, 1, 1))]
    job(spark, folder, model).start(fed(spark, rows, 0, feed), f"{folder}/c").awaitTermination()
    job(spark, folder, model).start(fed(spark, old, 0, feed), f"{folder}/c").awaitTermination()
    second = [r for r in written(spark, folder) if r[1] == 1]
    assert [(r[0] == "late", r[2], r[3]) for r in sorted(second, key=lambda r: r[2])] == [(True, 1000, None), (False, 1001, 1)]
