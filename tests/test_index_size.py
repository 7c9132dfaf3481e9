"""The inverted index: tokens as the SQL splits them, repeated ids, and postings that know their token's documents."""

from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import retrieval, search

ROWS = [
    (1, "Red fox, red"), (1, "FOX"), (None, "red ghost"), (None, "hen"), (2, "É à÷ÿ ÀB×c ſtop İx Kelvin K ΑΣ \U0001d41a9 naïve—cóp"),
    (3, None), (3, ""), (4, "hen " * 40), (5, "a\x00b\n\nc"),
]


def test_counts_equal_the_split_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BATCH_POSTINGS", 3)
    df = spark.createDataFrame(ROWS, "doc long, text string")
    words = df.select("doc", F.explode(search.tokens(F.col("text"))).alias("token"))
    expected = words.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("tf"))
    length = {r["doc"]: r["n"] for r in words.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = retrieval.document_tokens(df).collect()
    assert {(r["doc"], r["token"], r["tf"]) for r in got} == {tuple(r) for r in expected.select("doc", "token", "tf").collect()}
    assert len(got) == expected.count() and all(r["length"] == length[r["doc"]] for r in got)


def test_postings_carry_the_documents_of_their_token(spark):
    index = retrieval.build_index(spark.createDataFrame(ROWS, "id long, text string"), "id", "text")
    docs = {r["token"]: r["docs"] for r in index.terms.collect()}
    rows = index.postings.collect()
    assert rows and all(r["docs"] == docs[r["token"]] and r["doc"] is not None for r in rows)
    assert docs["red"] == 2 and docs["hen"] == 2  # the document without an id counts


def test_more_terms_than_a_broadcast_takes(spark):
    index = retrieval.build_index(spark.createDataFrame(ROWS, "id long, text string"), "id", "text")
    terms = spark.createDataFrame([(9, "hen"), (9, "red"), (8, "fox")], "query long, token string")
    whole = [tuple(r) for r in retrieval.bm25(index, terms, "query", 5).orderBy("query", "rank").collect()]
    spark.conf.set(session.BROADCAST_ROWS_KEY, "1")
    try:
        out = retrieval.bm25(index, terms, "query", 5)
        assert "LeftSemi, BuildRight" in out._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in out.orderBy("query", "rank").collect()] == whole and len(whole) == 3
    finally:
        spark.conf.unset(session.BROADCAST_ROWS_KEY)
