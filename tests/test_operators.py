"""Operators against brute force on small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import stages
from tidemark.operators import filters, graph, learning, profiles, schema as sc, search, sequences as seq, spectral, tables, vectors as vec
from tidemark.sinks import writers


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    # A third of the vectors are near copies of one another: one cell holds them all.
    points = np.concatenate([rng.normal(size=(60, 8)), np.ones((30, 8)) + rng.normal(scale=0.01, size=(30, 8))])
    return points, spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")


def brute(points, k, metric):
    out = {}
    for i, p in enumerate(points):
        if metric == "cosine":
            s = points @ p / (np.linalg.norm(points, axis=1) * np.linalg.norm(p))
        else:
            s = -np.linalg.norm(points - p, axis=1)
        order = sorted((j for j in range(len(points)) if j != i), key=lambda j: (-round(s[j], 12), j))
        out[i] = order[:k]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("pivots", [1, 7])
@pytest.mark.parametrize("block", [20000, 13])
def test_knn_join_is_exact(cloud, metric, pivots, block, monkeypatch):
    monkeypatch.setattr(vec, "BLOCK_ROWS", block)
    points, df = cloud
    got = {}
    for r in vec.knn_join(df, "id", "v", 4, metric, pivots=pivots).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    want = brute(points, 4, metric)
    assert {q: [got[q][i] for i in range(1, 5)] for q in got} == want


def test_search_beyond_the_query_bound(cloud, monkeypatch):
    _, df = cloud
    queries = df.filter("id < 9")
    bounded = vec.search(df, queries, 3, "id", "v", "id", "v", exclude_self=True)
    monkeypatch.setattr(vec, "MAX_QUERIES", 2)
    spilled = vec.search(df, queries, 3, "id", "v", "id", "v", exclude_self=True)
    columns = ["query_id", "id", "rank"]
    assert sorted(bounded.select(*columns).collect()) == sorted(spilled.select(*columns).collect())


def test_vector_expressions_and_cold_start(cloud):
    points, df = cloud
    r = df.filter("id < 2").orderBy("id").agg(F.collect_list("v").alias("v")).select(
        vec.cosine(F.col("v")[0], F.col("v")[1]), vec.l2(F.col("v")[0], F.col("v")[1])
    ).first()
    a, b = points[:2]
    assert math.isclose(r[0], a @ b / np.linalg.norm(a) / np.linalg.norm(b)) and math.isclose(r[1], np.linalg.norm(a - b))
    assert not vec.large_enough(df.limit(5)) and vec.large_enough(df)


def slow_points(x, percentile, zthresh):
    """The same definition by plain sums over a Fourier matrix."""
    n = len(x)
    k = np.arange(n)
    dft = np.exp(-2j * np.pi * np.outer(k, k) / n)
    energy = np.abs(dft @ ((x - x.mean()) / x.std())) ** 2 / n
    limit = np.percentile(energy[: n // 2 + 1], percentile)
    full = dft @ x
    for i in range(n):
        if energy[min(i, n - i)] < limit:
            full[i] = 0
    error = np.abs((np.conj(dft) @ full).real / n - x)
    return np.flatnonzero(np.abs(error - error.mean()) / error.std() >= zthresh)


def test_fft_against_definition():
    rng = np.random.default_rng(5)
    for n in (48, 61):
        signal = 10 + 5 * np.sin(2 * np.pi * np.arange(n) / 12) + rng.normal(size=n)
        signal[30] += 25
        for z in (1.5, 2.5, 4):
            assert list(spectral.anomalous_points(signal, 90, z)) == list(slow_points(signal, 90, z))
    assert 30 in spectral.anomalous_points(signal, 90, 3)
    assert len(spectral.anomalous_points(np.full(30, 5.0), 90, 1)) == 0
    assert len(spectral.anomalous_points(np.array([]))) == 0


def test_long_event_signals_are_segmented(spark, hot):
    rows = [("a", i, i, 100.0 if i == 30 else float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "u string, ts int, id int, x double")
    got = spectral.event_anomalies(df, "u", "ts", "id", "x", zthresh=3)
    assert 30 in [r["id"] for r in got.collect()]


def test_timeseries_flags_a_burst(spark):
    rows = [(h, f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", n) for h in range(24 * 10) for n in range(40 if h == 120 else 1 + h % 2)]
    df = spark.createDataFrame([("u", i, t, t[:10]) for i, (_, t, _) in enumerate(rows)], "u string, id int, t string, day string")
    df = df.withColumn("ts", F.to_timestamp("t"))
    out = spectral.timeseries_flags(df, "u", "ts", "day", zthresh=3)
    flagged = {r["t"] for r in out.filter("ts_anomaly").select("t").distinct().collect()}
    assert out.count() == df.count() and flagged == {"2024-01-06 00:00:00"}


def test_increments_bases(spark):
    rows = [("u", "2024-01-01 00:00:01", 0, "a"), ("u", "2024-01-01 00:00:01", 1, None), ("u", "2024-01-01 00:00:02", 2, "a"), ("u", "2024-01-02 00:00:00", 3, "b")]
    df = spark.createDataFrame(rows, "user string, t string, id int, app string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    spec = sc.FeatureSchema(
        [sc.Plain("id", "int"), sc.Increment("logcount", "user", "ts"), sc.DistinctIncrement("apps", "app", "user", "ts")], row_id="id"
    )
    assert [tuple(r) for r in spec.apply(df).orderBy("id").collect()] == [(0, 0, 1), (1, 1, 2), (2, 2, 2), (3, 0, 1)]


def test_schema_errors_and_absent_input(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("maybe",)], "flag string")
    with pytest.raises(ValueError, match="declared"):
        sc.FeatureSchema([sc.Rename("a", "int", "x"), sc.Rename("b", "str", "x")]).apply(df)
    spec = sc.FeatureSchema([sc.Bool("b", "flag", ["yes"], ["no"]), sc.Plain("gone", "float"), sc.ListJoin("l", "gone")])
    out = spec.apply(df)
    assert [r["b"] for r in out.collect()] == [True, False, True] and dict(out.dtypes)["gone"] == "double"
    assert [r["b"] for r in sc.FeatureSchema([sc.Bool("b", "flag", ["yes"], ["no"], None)]).apply(df).collect()] == [True, False, None]
    assert sc.select_features(["a", "b"], ["b", "c", "a"], ["a"]) == ["b"]
    with pytest.raises(ValueError, match="no requested"):
        sc.select_features(["a"], ["b"])
    assert sc.from_config([{"name": "x", "dtype": "str", "from": "flag", "op_type": "rename"}]).apply(df).columns == ["x"]


def test_feature_files(spark, tmp_path):
    config = {
        "model_features": {"default": ["location"], "all": ["category", "appDisplayName", "travel_speed_kmph", "locincrement", "logcount"]},
        "categorical_features": {"category": {"enabled": False}, "location": None},
        "behavioral_features": {"locincrement": {"my_params": {"input_name": "location_country", "period": "month"}}, "logcount": None},
    }
    (tmp_path / "f.json").write_text(json.dumps(config))
    names = lambda s: [c.name for c in s.columns]
    assert names(sc.from_file(spark, str(tmp_path / "f.json"))) == ["timestamp", "username", "location"]
    assert names(sc.from_file(spark, str(tmp_path / "f.json"), "absent")) == ["timestamp", "username", "location"]
    schema = sc.from_file(spark, str(tmp_path / "f.json"), "all", row_id="id", preserve=["id"])
    assert names(schema) == [
        "timestamp", "username", "appDisplayName", "location_country", "location_geoCoordinates_latitude",
        "location_geoCoordinates_longitude", "travel_speed_kmph", "location", "logcount", "locincrement",
    ]
    assert schema.columns[-1].period == "month" and schema.columns[-1].source == "location_country"
    rows = [("2024-01-01 10:00:00", "u", "DE", 1), ("2024-01-09 10:00:00", "u", "FR", 2), ("2024-01-09 10:00:00", "u", "DE", 3), ("2024-02-01 00:00:00", None, None, 4)]
    df = spark.createDataFrame(rows, "timestamp string, username string, location_country string, id long")
    got = [(r.id, r.logcount, r.locincrement, r.travel_speed_kmph) for r in schema.apply(df).orderBy("id").collect()]
    assert got == [(1, 0, 1, None), (2, 0, 2, None), (3, 1, 2, None), (4, 0, 1, None)]
    assert schema.apply(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="unknown features"):
        sc.feature_entries({"model_features": {"default": ["nonsense"]}})
    with pytest.raises(ValueError, match="row_id"):
        sc.from_config([{"name": "n", "op_type": "increment"}]).apply(df)
    with pytest.raises(ValueError, match="twice"):
        sc.from_config([{"name": "n", "dtype": "int"}, {"name": "n", "op_type": "increment"}])
    same = [{"name": "id", "dtype": "int"}, {"name": "n", "op_type": "distinct", "from": "location_country", "period": "month"}]
    coded = sc.FeatureSchema([sc.Plain("id", "int"), sc.DistinctIncrement("n", "location_country", "username", "timestamp", "month")], row_id="id")
    assert sorted(sc.from_config(same, "id").apply(df).collect()) == sorted(coded.apply(df).collect())


def test_validation_report_as_json(spark, tmp_path):
    left = spark.createDataFrame([(1, 1.0, "a", 5), (2, 2.0, None, 5), (3, 3.0, "c", 5)], "id long, v double, s string, only_left int")
    right = spark.createDataFrame([(1, 1.0005, "a", 7), (2, 2.5, None, 7), (4, 3.0, "c", 7)], "id long, v double, s string, _ts_r int")
    path = str(tmp_path / "out.json")
    report = tables.validation_report(left, right, ["id"])
    writers.write_report(report, path)
    (part,) = [p for p in (tmp_path / "out.json").iterdir() if p.name.startswith("part-")]
    got = json.loads(part.read_text())
    assert list(got) == sorted(got) and got == {
        "diff_rows": 1, "diff_s": 0, "diff_v": 1, "extra_columns": [], "extra_rows": 1, "matching_columns": ["s", "v"],
        "matching_rows": 1, "missing_columns": ["only_left"], "missing_rows": 1, "total_rows": 3,
    }
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_report(report, path)
    writers.write_report(tables.validation_report(left, left, ["id"]), path, overwrite=True)
    assert spark.read.json(path).first()["matching_rows"] == 3


def test_router_rejects_unknown_keys(spark):
    with pytest.raises(Exception, match="no route"):
        filters.routed(spark.range(3), F.col("id"), {"0": "a", "1": "b"}).collect()


def test_training_window_keeps_new_rows(spark):
    rows = [("u", i, i, i >= 5) for i in range(20)]
    df = spark.createDataFrame(rows, "u string, ts int, id int, new boolean")
    kept = seq.training_window(df, "u", "ts", "id", F.col("new"), 10, 3, 4)
    assert sorted(r["id"] for r in kept.collect()) == list(range(5, 20))
    assert seq.training_window(df, "u", "ts", "id", F.col("new"), 30, 3, 4).count() == 0


def test_all_old_batch(spark):
    history = spark.createDataFrame([("u", 5), ("u", 9)], "u string, ts int")
    inside = seq.batch_verdicts(spark.createDataFrame([("u", 6)], "u string, ts int"), history, "u", "ts").first()
    before = seq.batch_verdicts(spark.createDataFrame([("u", 1)], "u string, ts int"), history, "u", "ts").first()
    assert (inside["success"], before["success"]) == (True, False)


def test_escalation_labels(spark):
    rows = [("u", f"2024-01-01 0{h}:00:00", i, s) for i, (h, s) in enumerate([(0, 2.0), (1, 3.0), (2, 4.0), (6, 9.0)])]
    df = spark.createDataFrame(rows, "u string, t string, id int, s double").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = [r["significance"] for r in seq.escalations(df, "u", "ts", "id", "s").orderBy("id").collect()]
    assert got == ["Escalation trigger", "Score escalation", "Score escalation", ""]


def test_neighbourhood_hops(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "d", "r"), ("d", "e", "r"), ("b", "a", "r")], "src string, dst string, rel string")
    seeds = spark.createDataFrame([("a",)], "id string")
    got = {r["id"]: r["hops"] for r in graph.neighbourhood(edges, seeds, 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert graph.merge_edges(edges, edges).count() == 5


def test_rrf(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1)], "id string, rank int")
    got = {r["id"]: (round(r["rrf_score"], 9), r["sources"]) for r in search.rrf({"dense": a, "sparse": b}, "id").collect()}
    assert got == {"x": (round(1 / 61, 9), ["dense"]), "y": (round(1 / 62 + 1 / 61, 9), ["dense", "sparse"])}


def test_distribution_matches_pandas(spark):
    import pandas as pd

    values = [1.0, 2.0, 2.0, 3.0, 10.0, 4.0, 7.5]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    got = profiles.distribution(df, "s", profiles.score_baseline(df, [], "s")).first()
    assert math.isclose(got["skewness"], pd.Series(values).skew()) and math.isclose(got["kurtosis"], pd.Series(values).kurtosis())


def test_compare_tolerances(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "x"), (3, 3.0, "y")], "id int, v double, t string")
    b = spark.createDataFrame([(1, 1.004, None), (2, 2.5, "x"), (4, 1.0, "z")], "id int, v double, t string")
    r = tables.compare(a, b, ["id"], ["v", "t"]).first()
    assert (r["matching_rows"], r["diff_rows"], r["missing_rows"], r["extra_rows"], r["diff_v"], r["diff_t"]) == (1, 1, 1, 1, 1, 0)


def test_forecast_follows_the_week(spark):
    rows = [(f"2024-01-{d:02d}", 10 + d + (20 if d % 7 == 0 else 0)) for d in range(1, 29)]
    counts = spark.createDataFrame(rows, "d string, y int").select(F.to_date("d").alias("ds"), "y")
    got = {str(r["ds"]): r["yhat"] for r in learning.forecast(counts, 7).collect()}
    assert len(got) == 7 and abs(got["2024-02-04"] - 65) < 1.5 and abs(got["2024-02-01"] - 42) < 1.5
    assert learning.forecast(counts.limit(5), 7).count() == 0


def test_guarded_sql(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    assert stages.guarded_sql(spark, "select id from numbers where '; drop' <> 'x';").count() == 100
    for bad in ("drop table numbers", "select 1; select 2", "with x as (select 1) insert into y select * from x"):
        with pytest.raises(ValueError, match="SELECT"):
            stages.guarded_sql(spark, bad)


def test_function_source(spark):
    @stages.source("two_parts", "part int, n int", partitions=2)
    def rows(options, part):
        for n in range(int(options.get("rows", 2))):
            yield part, n

    spark.dataSource.register(rows)
    got = spark.read.format("two_parts").option("rows", "3").load()
    assert sorted(map(tuple, got.collect())) == [(p, n) for p in (0, 1) for n in range(3)]


def test_counted(spark):
    df, watch = stages.counted(spark.range(7), "seen")
    df.collect()
    assert watch.get["rows"] == 7


def test_stage_needs_columns(spark):
    @stages.stage(needs=["missing"])
    def step(df):
        return df

    with pytest.raises(ValueError, match="needs columns"):
        stages.run_stages(spark.range(1), ["step"])
