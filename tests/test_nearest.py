"""The block comparison of the k-NN join against all pairs in plain numpy, and where it runs."""

import numpy as np
import pytest

from tidemark.operators import vectors as vec


def by_all_pairs(names, q, ids, m, k, metric):
    table = np.round(vec._scores(q, m, metric), 12)
    out = []
    for n, name in enumerate(names):
        order = [j for j in np.lexsort((ids, -table[n])) if ids[j] != name][:k]
        out += [(n, ids[j], table[n, j]) for j in order]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("kind", ["even", "crowd", "copies", "near", "repeated ids", "odd values"])
def test_nearest_equals_all_pairs(metric, kind):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((3011, 16))
    ids = rng.permutation(9000)[:3011]
    if kind == "crowd":
        m[:2500] = m[0]
    elif kind == "copies":
        m = np.repeat(m[:500], 7, 0)[:3011]
    elif kind == "near":  # closer than single precision tells apart
        m[:400] = m[0] + rng.standard_normal((400, 16)) * 1e-8
    elif kind == "repeated ids":
        ids = ids // 30
    elif kind == "odd values":
        m[5], m[6], m[7] = 0, np.nan, m[8]
    m = vec._unit(m) if metric == "cosine" else m
    pick = [n for n in range(0, 3011, 37) if n != 6]
    rows, found, scores = vec._nearest(ids[pick], m[pick], ids, m, 5, metric, None, True)
    expected = by_all_pairs(ids[pick], m[pick], ids, m, 5, metric)
    assert [(r, i) for r, i in zip(rows, found)] == [(r, i) for r, i, _ in expected]
    assert np.allclose(scores, [s for _, _, s in expected], atol=2e-8 if metric == "l2" else 1e-11)


def test_blocks_are_not_merged_into_few_tasks(spark):
    df = spark.createDataFrame([(n, [float(n), 1.0]) for n in range(30)], "id long, v array<double>")
    plan = vec.knn_join(df, "id", "v", 2)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan.split("FlatMapCoGroups")[1]


def test_patterns_read_their_neighbours_once(spark):
    df = spark.createDataFrame([(n, [float(n % 7), 1.0, n * 0.1]) for n in range(40)], "id long, v array<double>")
    payload = df.selectExpr("id", "'c' AS cause", "'10.0.0.1' AS ip", "id AS seen")
    out = vec.neighbour_patterns(vec.knn_join(df, "id", "v", 3), payload, "id", "cause", "ip", "seen")
    assert out.count() == 40
    assert "FlatMapCoGroups" not in out._jdf.queryExecution().executedPlan().toString()
