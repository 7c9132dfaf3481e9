import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

from tidemark.operators import trees


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)).round(3)
    y = (x[:, 0] > 0.2) * 2.0 + x[:, 1] * (x[:, 2] > 0)
    data = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double").cache()


@pytest.mark.parametrize("kind", [
    lambda: DecisionTreeRegressor(maxDepth=4), lambda: GBTRegressor(maxIter=4, maxDepth=3, seed=3),
    lambda: RandomForestRegressor(numTrees=5, maxDepth=3, seed=3),
])
def test_scores_equal_those_of_the_ml_model(rows, kind):
    features = ["a", "b", "c"]
    assembled = VectorAssembler(inputCols=features, outputCol="f").transform(rows)
    model = kind().setFeaturesCol("f").setLabelCol("y").fit(assembled)
    expected = {r["id"]: r["prediction"] for r in model.transform(assembled).collect()}
    got = trees.ensemble_scores(rows, trees.from_spark_ml(model, features), features)
    assert got.columns == [*rows.columns, "score"]
    for r in got.collect():
        assert r["score"] == pytest.approx(expected[r["id"]], abs=1e-9)


def test_missing_values_follow_their_branch(spark):
    nodes = [(0, 1, "a", 1.0, 2, 3, 2, None), (0, 2, None, None, None, None, None, 10.0), (0, 3, "b", 0.0, 4, 5, None, None),
             (0, 4, None, None, None, None, None, 20.0), (0, 5, None, None, None, None, None, 30.0),
             (1, 1, None, None, None, None, None, 0.5)]
    table = spark.createDataFrame(nodes, trees.NODE_SCHEMA)
    df = spark.createDataFrame([(1, None, 1.0), (2, 1.0, None), (3, 1.5, None), (4, 2.0, 0.0), (5, float("nan"), 0.0)], "id int, a double, b double")
    got = {r["id"]: r["score"] for r in trees.ensemble_scores(df, table, ["a", "b"], base=1.0).collect()}
    assert got == {1: 11.5, 2: 11.5, 3: 31.5, 4: 21.5, 5: 11.5}
    assert trees.ensemble_scores(df.limit(0), table, ["a", "b"]).count() == 0


def test_boosted_oblivious_trees_learn(rows):
    nodes = trees.fit_oblivious(rows, ["a", "b", "c"], "y", depth=3, trees=8, rate=0.8)
    assert nodes.count() == 8 * 15
    scored = trees.ensemble_scores(rows, nodes, ["a", "b", "c"]).collect()
    y, p = np.array([r["y"] for r in scored]), np.array([r["score"] for r in scored])
    assert ((y - p) ** 2).mean() < 0.5 * y.var()
