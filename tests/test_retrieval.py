import math

from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import retrieval

DOCS = [(1, "red fox red"), (2, "red hen"), (3, None), (4, ""), (5, "blue hen fox"), (6, "Red, blue; RED red"), (7, "lone")]


def index_of(spark, rows=DOCS):
    return retrieval.build_index(spark.createDataFrame(rows, "id long, text string"), "id", "text", session.scratch_dir(spark, "idx"))


def test_bm25_by_its_formula(spark):
    index = index_of(spark)
    assert index.documents == 7 and index.mean_length == 13 / 7
    terms = spark.createDataFrame([(2, "red"), (2, "hen"), (9, "missing")], "query long, token string")
    got = {(r["query"], r["doc"]): (r["rank"], r["score"]) for r in retrieval.bm25(index, terms, "query", 5).collect()}

    def part(n, df, tf, length):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (13 / 7)))

    expected = {1: part(7, 3, 2, 3), 5: part(7, 2, 1, 3), 6: part(7, 3, 3, 4)}
    order = sorted(expected, key=lambda d: -expected[d])
    assert {k[1] for k in got} == set(expected) and {k[0] for k in got} == {2}
    for d, score in expected.items():
        assert math.isclose(got[2, d][1], score, rel_tol=1e-12) and got[2, d][0] == order.index(d) + 1


def test_lists_and_fusion(spark):
    index = index_of(spark)
    queries = spark.createDataFrame([(2,), (3,), (7,)], "query long")
    terms = retrieval.query_terms(index, queries, "query", 1)
    assert [tuple(r) for r in terms.collect()] == [(2, "hen")]  # the rarer of two; nothing for texts that share no term
    shared = retrieval.co_mentioned(index, queries, "query", 5, most=2)
    assert [(r["query"], r["doc"], r["shared"]) for r in shared.collect()] == [(2, 5, 1)]
    lists = {"sparse": retrieval.bm25(index, terms, "query", 5), "graph": shared}
    fused = retrieval.hybrid(lists, "query", 3).collect()
    assert [(r["query"], r["doc"], r["rank"], r["sources"]) for r in fused] == [(2, 5, 1, ["sparse", "graph"])]
    assert math.isclose(fused[0]["rrf_score"], 2 / 61)


def test_alike_takes_nulls_as_equal(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "x"), (4, "a", None)], "id long, s string, t string")
    queries = docs.filter("id in (1, 3)").select(F.col("id").alias("query"))
    got = retrieval.alike(docs, queries, "id", "query", ["s", "t"], "id", 5).collect()
    assert [(r["query"], r["doc"], r["rank"]) for r in got] == [(1, 4, 1), (1, 2, 2)]


def test_empty_index(spark):
    index = index_of(spark, [(1, None), (2, "")])
    assert index.postings.count() == 0 and index.documents == 2
    terms = spark.createDataFrame([(1, "red")], "query long, token string")
    assert retrieval.bm25(index, terms, "query", 3).count() == 0
    assert retrieval.build_index(spark.createDataFrame([], "id long, text string"), "id", "text").documents == 0
