"""BM25 over many queries: pairs of query and document are added up where the documents are, in pieces of bounded size."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered, retrieval

WORDS = ["red", "fox", "hen", "blue", "lone", "oak", "ash", "elm", "ivy", "yew"]


@pytest.fixture(scope="module")
def index(spark):
    """120 documents of common words, ids as text, every third one the same as the one before it."""
    rows = []
    for i in range(120):
        j = i - 1 if i % 3 == 2 else i
        rows.append((f"d{i:03}", " ".join(WORDS[(j * a + a * a) % 10] for a in range(1, 3 + j % 7))))
    return retrieval.build_index(spark.createDataFrame(rows, "id string, text string"), "id", "text")


def plainly(index, terms, k):
    """The same ranks by a join and a sum over all pairs."""
    n = F.lit(index.documents)
    idf = F.log(1 + (n - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
    damp = F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / F.lit(index.mean_length))
    hits = index.postings.join(terms, "token").filter(F.col("doc") != F.col("query"))
    scores = hits.groupBy("query", "doc").agg(F.sum(idf * F.col("tf") * 2.2 / damp).alias("score"))
    best = ordered.top_k(scores, ["query"], k, F.round("score", 9).desc(), F.asc("doc"))
    return sorted((r["query"], r["rank"], r["doc"], round(r["score"], 9)) for r in best.collect())


def found(index, terms, k):
    return sorted((r["query"], r["rank"], r["doc"], round(r["score"], 9)) for r in retrieval.bm25(index, terms, "query", k).collect())


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_POSTINGS": 7, "BLOCK_HITS": 5, "CORE_TASKS": 0}, {"BROADCAST_TOKENS": 9}])
def test_pieces_give_the_ranks_of_the_whole(spark, index, monkeypatch, sizes):
    queries = spark.createDataFrame([(f"d{i:03}",) for i in range(0, 120, 4)] + [("none",), (None,)], "query string")
    terms = retrieval.query_terms(index, queries, "query", 3).unionByName(spark.createDataFrame([("other", "red"), (None, "red")], "query string, token string"))
    expected = plainly(index, terms.filter("query is not null"), 4)
    for name, value in sizes.items():
        monkeypatch.setattr(retrieval, name, value)
    got = found(index, terms, 4)
    assert got == expected and len({r[0] for r in got}) > 20


def shuffled(df):
    """Rows that the frame's own query writes to shuffles."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.plan()] if name.endswith("QueryStageExec") else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_pairs_of_query_and_document_are_not_shuffled(spark, index):
    queries = spark.createDataFrame([(f"q{i:03}",) for i in range(200)], "query string")
    terms = queries.crossJoin(spark.createDataFrame([("red",), ("fox",), ("hen",)], "token string"))
    pairs = index.postings.filter("token in ('red', 'fox', 'hen')").select("doc").distinct().count() * 200
    out = retrieval.bm25(index, terms, "query", 2)
    assert 0 < shuffled(out) < pairs / 10 and out.count() == 400


def test_counts_lie_in_order_of_token_and_are_not_joined(index):
    files = {}
    for r in index.counts.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at"), "token").collect():
        files.setdefault(r["f"], []).append((r["at"], r["token"]))
    assert files and all([t for _, t in sorted(rows)] == sorted(t for _, t in rows) for rows in files.values())
    assert "Join" not in index.counts._jdf.queryExecution().executedPlan().toString()


def test_entities_in_more_than_one_broadcast(spark, index, monkeypatch):
    queries = spark.createDataFrame([("d000",), ("d010",), ("d020",)], "query string")
    rows = lambda: sorted(map(tuple, retrieval.co_mentioned(index, queries, "query", 5, most=90).collect()))
    whole = rows()
    monkeypatch.setattr(retrieval, "BROADCAST_TOKENS", 2)
    assert rows() == whole and len(whole) == 15


def test_only_counts_of_asked_entities_are_shuffled(spark):
    rows = [(i, f"w{i // 2} v{i // 4}") for i in range(400)]
    index = retrieval.build_index(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    queries = spark.createDataFrame([(8,)], "query long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = retrieval.co_mentioned(index, queries, "query", 5)
        assert 0 < shuffled(out) < 40
        assert [(r["doc"], r["rank"], r["shared"]) for r in out.orderBy("rank").collect()] == [(9, 1, 2), (10, 2, 1), (11, 3, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
