"""The pipeline, stage by stage on its own input, against brute force; and the registered queries."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark import session
from tidemark.llm import mixing, pieces, plans

from .test_operators import brute_near, rows_of


def tuples(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_stages_on_odd_rows(spark, odd, odd_rows):
    """Each stage's decisions, worked out from the rows that its predecessor kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "pieces"]
    docs, rows = odd, [r[:5] for r in odd_rows]
    for name, stage in corpus_pipeline.STAGES:
        out = session.durable(stage(spark, docs, ""))
        if name == "pieces":
            break
        assert out.columns == corpus_pipeline.COLUMNS
        got = tuples(out)
        if name == "language_id":
            kept = {(r[0], r[1]) for r in got}
            assert not {i for i, _ in kept} & {4, 5, 6} and all((i, t) in {r[:2] for r in rows} for i, t in kept)
            assert {1, 2, 3, 14} <= {i for i, _ in kept} and {r[2] for r in got} <= {"en", "fr"}
        if name == "exact_dedup":
            want = {t: max((i for i, x, *_ in rows if x == t), key=lambda i: (i is not None, i or 0)) for _, t, *_ in rows}
            assert sorted((t, i) for i, t, *_ in got) == sorted(want.items())
        if name == "near_dedup":
            component = brute_near(rows, 5, 80)
            assert sorted(i for i, *_ in got) == sorted(i for i, *_ in rows if component[i][1] == i)
        if name == "mixing":
            takes = {r.id: (r.taken, r.size) for r in mixing.mixture(docs).collect()}
            want = sorted(i for i, (taken, size) in takes.items() for _ in range((2 * taken + size) // (2 * size) if size else 0))
            assert sorted(i for i, *_ in got) == want
        docs, rows = out, got
    assert out.count() == len(rows) and out.filter("not round_trip").count() == 0
    vocabulary = pieces.store_of(public_tokenizers.path(corpus_pipeline.VOCABULARY), pieces.ALPHA).vocabulary
    texts = {i: t for i, t, *_ in rows}
    assert all(vocabulary.decode(r.ids) == texts[r.doc_id] for r in out.collect())


def test_stages_of_an_empty_table(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = session.durable(stage(spark, docs, ""))
        assert docs.count() == 0


def test_run_equals_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = session.durable(stage(spark, docs, sf))
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "ids", "inclusion").cast("decimal(38,0)"))).first()
    assert digest(out) == digest(docs) and out.count() > 50


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in plans.QUERIES) == list(range(1, 14)) and set(plans.ORACLES) <= set(plans.QUERIES)


def test_queries_against_sql_and_held_out_languages(spark):
    import oracle

    sf = "/root/testdata/sf0.001"
    duck = oracle.connect(sf)
    for name, sql in plans.ORACLES.items():
        assert oracle.difference(plans.QUERIES[name](spark, sf), duck, sql) is None, name
    rows = rows_of(plans.QUERIES["op10_language_id"](spark, sf), "doc_id")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r[0] for r in rows.values() if r[0].held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
