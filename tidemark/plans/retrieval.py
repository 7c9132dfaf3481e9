"""Vector, text-search and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import risk
from tidemark.operators import graph, ordered, retrieval, search, vectors as vec
from tidemark.plans.base import DETECTIONS_SQL, as_of, detections
from tidemark.registry import query
from tidemark.session import durable, spread, table

CENTROIDS_SQL = """(
  SELECT label, list(mean ORDER BY i) AS centre FROM (
    SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS mean
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1)"""
VEC_SQL = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def centroids(spark, sf_dir):
    """Mean vector of each label: the query set of the searches below, derived from the whole table."""
    parts = embeddings(spark, sf_dir).select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m")))["m"].alias("centre"))


@query(
    "cosine_topk",
    f"""
    WITH s AS (SELECT c.label AS query_id, e.vec_id AS id, list_cosine_similarity({VEC_SQL}, c.centre) AS score FROM embeddings e, {CENTROIDS_SQL} c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM s WHERE score >= 0.1)
    SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 5
    """,
)
def cosine_topk(spark, sf_dir):
    out = vec.search(embeddings(spark, sf_dir), centroids(spark, sf_dir), 5, "vec_id", "embedding", "label", "centre", min_score=0.1)
    return out.withColumn("score", F.round("score", 6))


@query(
    "l2_topk",
    f"""
    WITH s AS (SELECT c.label AS query_id, e.vec_id AS id, list_distance({VEC_SQL}, c.centre) AS score FROM embeddings e, {CENTROIDS_SQL} c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12), id) AS rank FROM s)
    SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 5
    """,
)
def l2_topk(spark, sf_dir):
    out = vec.search(embeddings(spark, sf_dir), centroids(spark, sf_dir), 5, "vec_id", "embedding", "label", "centre", metric="l2")
    return out.withColumn("score", F.round("score", 6))


KNN_SQL = f"""
    WITH v AS (SELECT vec_id, label, {VEC_SQL} AS e FROM embeddings),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM s) WHERE rank <= 5)"""


@query("knn_backfill", KNN_SQL + " SELECT query_id, id, rank, round(score, 6) AS score FROM knn")
def knn_backfill(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return vec.knn_join(rows, "vec_id", "embedding", 5).withColumn("score", F.round("score", 6))


@query(
    "knn_pattern",
    KNN_SQL
    + """,
    p AS (SELECT k.query_id, k.rank, 'cause ' || v.label AS cause, CAST(v.vec_id // 25 AS BIGINT) AS net, v.vec_id AS seen FROM knn k JOIN v ON v.vec_id = k.id),
    c AS (SELECT query_id, cause, count(*) AS n, min(rank) AS f FROM p GROUP BY 1, 2),
    d AS (SELECT query_id, cause, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS o FROM c),
    m AS (SELECT query_id, max(n) >= 3 AS rec FROM (SELECT query_id, net, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1)
    SELECT p.query_id, count(*) AS recurrence_count, min(p.seen) AS first_seen, max(d.cause) AS dominant_root_cause,
           bool_or(m.rec) AS recurrence_detected,
           round(least(1.0, 0.4 + count(*) / 10.0 * 0.4 + CASE WHEN bool_or(m.rec) THEN 0.2 ELSE 0 END), 6) AS confidence
    FROM p JOIN d ON d.query_id = p.query_id AND d.o = 1 JOIN m ON m.query_id = p.query_id GROUP BY 1
    """,
)
def knn_pattern(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    payload = rows.select(
        "vec_id",
        F.concat(F.lit("cause "), F.col("label").cast("string")).alias("cause"),
        F.concat(F.lit("10.0."), F.floor(F.col("vec_id") / 25).cast("string"), F.lit(".7")).alias("ip"),
        F.col("vec_id").alias("seen"),
    )
    found = vec.knn_join(rows, "vec_id", "embedding", 5)
    out = vec.neighbour_patterns(found, payload, "vec_id", "cause", "ip", "seen")
    return out.withColumn("confidence", F.round("confidence", 6))


@query("vector_dimensions", "SELECT len(embedding) AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dimensions(spark, sf_dir):
    return vec.dimension_of(embeddings(spark, sf_dir), "embedding")


@query(
    "vector_upsert",
    """
    WITH stored AS (SELECT vec_id, label FROM embeddings WHERE label < 7), new AS (SELECT vec_id, label + 100 AS label FROM embeddings WHERE label >= 4),
    gone AS (SELECT vec_id FROM embeddings WHERE label = 9)
    SELECT label, count(*) AS n FROM (
      SELECT * FROM stored WHERE vec_id NOT IN (SELECT vec_id FROM new) UNION ALL SELECT * FROM new)
    WHERE vec_id NOT IN (SELECT vec_id FROM gone) GROUP BY 1
    """,
)
def vector_upsert(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    new = rows.filter("label >= 4").withColumn("label", F.col("label") + 100)
    stored = vec.upsert(rows.filter("label < 7"), new, ["vec_id"])
    kept = vec.delete(stored, rows.filter("label = 9"), ["vec_id"])
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("vector_insert_counts", "SELECT count(*) FILTER (WHERE label <> 3) AS inserted, count(*) FILTER (WHERE label = 3) AS failed FROM embeddings")
def vector_insert_counts(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    damaged = rows.withColumn("embedding", F.when(F.col("label") == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    return vec.insert(rows.limit(0), damaged, "embedding", 64)[1]


TOKENS_SQL = """(
  SELECT doc_id, token, sum(w) AS weight FROM (
    SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^0-9a-zà-ÿ]+'), lambda t: t <> '')) AS token, 0.2 AS w FROM documents
    UNION ALL SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(source), '[^0-9a-zà-ÿ]+'), lambda t: t <> '')), 1.0 FROM documents
    UNION ALL SELECT doc_id, lower(lang), 0.4 FROM documents) GROUP BY 1, 2)"""


def token_table(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return search.index(docs, "doc_id", {"source": "A", "lang": "B", "text": "C"})


@query(
    "weighted_fts",
    f"""
    SELECT doc_id, round(sum(ln(1 + weight)), 6) AS rank_score FROM {TOKENS_SQL} WHERE token IN ('en', 'the', 'and')
    GROUP BY 1 HAVING count(*) = 3 ORDER BY sum(ln(1 + weight)) DESC, doc_id LIMIT 20
    """,
)
def weighted_fts(spark, sf_dir):
    words = ["the", "and", "en"]
    found = search.match(token_table(spark, sf_dir), "doc_id", words, 20)
    return found.withColumn("rank_score", F.round("rank_score", 6))


@query(
    "fts_vocabulary",
    f"SELECT token, count(*) AS docs, round(sum(weight), 3) AS weight FROM {TOKENS_SQL} GROUP BY 1",
)
def fts_vocabulary(spark, sf_dir):
    return token_table(spark, sf_dir).groupBy("token").agg(
        F.count(F.lit(1)).alias("docs"), F.round(F.sum("weight"), 3).alias("weight")
    )


@query(
    "rrf_fusion",
    f"""
    WITH longest AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r, lang FROM documents),
    newest AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r, lang FROM documents),
    u AS (SELECT lang, doc_id, r, 0 AS o, 'longest' AS s FROM longest WHERE r <= 20 UNION ALL SELECT lang, doc_id, r, 1, 'newest' FROM newest WHERE r <= 20
          UNION ALL SELECT 'en', doc_id, row_number() OVER (ORDER BY sc DESC, doc_id), 2, 'sparse' FROM (
            SELECT doc_id, sum(ln(1 + weight)) AS sc FROM {TOKENS_SQL} WHERE token IN ('en', 'the') GROUP BY 1 HAVING count(*) = 2 ORDER BY sc DESC, doc_id LIMIT 20)),
    f AS (SELECT lang, doc_id, sum(1.0 / (60 + r)) AS score, string_agg(s, ',' ORDER BY o) AS sources FROM u GROUP BY 1, 2),
    t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 12) DESC, doc_id) AS rank FROM f)
    SELECT lang, doc_id, rank, round(score, 8) AS rrf_score, sources FROM t WHERE rank <= 10
    """,
)
def rrf_fusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    longest = ordered.top_k(docs, ["lang"], 20, F.desc("n_chars"), F.asc("doc_id"))
    newest = ordered.top_k(docs, ["lang"], 20, F.desc("doc_id"))
    sparse = search.match(token_table(spark, sf_dir), "doc_id", ["the", "en"], 20).withColumn("lang", F.lit("en"))
    sparse = ordered.top_k(sparse, ["lang"], 20, F.desc("rank_score"), F.asc("doc_id"))
    fused = search.rrf({"longest": longest, "newest": newest, "sparse": sparse}, "doc_id", keys=["lang"])
    return search.fused_top(fused, ["lang"], "doc_id", 10).select(
        "lang", "doc_id", "rank", F.round("rrf_score", 8).alias("rrf_score"), F.array_join("sources", ",").alias("sources")
    )


HYBRID_SQL = f"""
    tok AS (SELECT doc_id AS doc, token, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^0-9a-zà-ÿ]+'), lambda t: t <> '')) AS token FROM documents) GROUP BY 1, 2),
    len AS (SELECT doc, sum(tf) AS length FROM tok GROUP BY 1), df AS (SELECT token, count(*) AS docs FROM tok GROUP BY 1),
    tot AS (SELECT count(DISTINCT doc_id) AS n, (SELECT sum(tf) FROM tok) / count(DISTINCT doc_id) AS mean FROM documents),
    q AS (SELECT doc_id AS query_id, lang, source FROM documents WHERE doc_id % 100 = 0),
    qt AS (SELECT query_id, token, docs FROM (SELECT query_id, token, docs, row_number() OVER (PARTITION BY query_id ORDER BY docs, token) AS r FROM q JOIN tok ON doc = query_id JOIN df USING (token) WHERE docs > 1) WHERE r <= 8),
    sparse AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc) AS r FROM (
      SELECT query_id, doc, sum(ln(1 + (n - docs + 0.5) / (docs + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
      FROM qt JOIN tok USING (token) JOIN len USING (doc), tot WHERE doc <> query_id GROUP BY 1, 2)),
    graph AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc) AS r FROM (
      SELECT query_id, b.doc, count(*) AS shared FROM q JOIN tok a ON a.doc = query_id JOIN df USING (token) JOIN tok b USING (token) WHERE docs BETWEEN 2 AND 20 AND b.doc <> query_id GROUP BY 1, 2)),
    dense AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc) AS r FROM (
      SELECT query_id, b.vec_id AS doc, list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) AS score
      FROM q JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id <> a.vec_id)),
    alike AS (SELECT query_id, d.doc_id AS doc, row_number() OVER (PARTITION BY query_id ORDER BY d.doc_id DESC) AS r FROM q JOIN documents d ON d.lang IS NOT DISTINCT FROM q.lang AND d.source IS NOT DISTINCT FROM q.source AND d.doc_id <> query_id),
    u AS (SELECT *, 0 AS o, 'dense' AS s FROM dense WHERE r <= 20 UNION ALL SELECT *, 1, 'sparse' FROM sparse WHERE r <= 20 UNION ALL SELECT *, 2, 'graph' FROM graph WHERE r <= 20 UNION ALL SELECT *, 3, 'structured' FROM alike WHERE r <= 20),
    f AS (SELECT query_id, doc, sum(1.0 / (60 + r)) AS score, string_agg(s, ',' ORDER BY o) AS sources FROM u GROUP BY 1, 2)"""


def retrieval_lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    index = retrieval.build_index(spread(docs), "doc_id", "text")
    queries = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"))  # the stated query set
    vectors = embeddings(spark, sf_dir)
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    dense = vec.search(vectors, asked, 20, "vec_id", "embedding", "query_id", "asked", exclude_self=True).withColumnRenamed("id", "doc")
    return {
        "dense": dense.join(queries, "query_id", "left_semi"),
        "sparse": retrieval.bm25(index, retrieval.query_terms(index, queries, "query_id", 8), "query_id", 20),
        "graph": retrieval.co_mentioned(index, queries, "query_id", 20),
        "structured": retrieval.alike(docs, queries, "doc_id", "query_id", ["lang", "source"], "doc_id", 20),
    }


@query("bm25_search", f"WITH {HYBRID_SQL} SELECT query_id, doc, r AS rank FROM sparse WHERE r <= 20")
def bm25_search(spark, sf_dir):
    return retrieval_lists(spark, sf_dir)["sparse"].select("query_id", "doc", "rank")


@query(
    "hybrid_retrieval",
    f"""
    WITH {HYBRID_SQL}
    SELECT query_id, doc, rank, round(score, 8) AS rrf_score, sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc) AS rank FROM f) WHERE rank <= 10
    """,
)
def hybrid_retrieval(spark, sf_dir):
    out = retrieval.hybrid(retrieval_lists(spark, sf_dir), "query_id", 10)
    return out.select("query_id", "doc", "rank", F.round("rrf_score", 8).alias("rrf_score"), F.array_join("sources", ",").alias("sources"))


EDGES_SQL = f"""(
  SELECT 'User:' || user_id AS src, 'Detection:' || event_id AS dst, 'GENERATED' AS rel FROM {DETECTIONS_SQL}
  UNION SELECT 'Detection:' || event_id, 'Application:' || event_type, 'ACCESSED' FROM {DETECTIONS_SQL}
  UNION SELECT 'Detection:' || event_id, 'Location:' || k, 'FROM_LOCATION' FROM {DETECTIONS_SQL})"""


def detection_edges(spark, sf_dir):
    return graph.detection_graph(
        detections(spark, sf_dir), "user_id", "event_id", {"app": "event_type", "location": "k"}
    )


@query(
    "graph_build",
    f"""
    WITH e AS {EDGES_SQL}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)
    SELECT 'node' AS kind, split_part(id, ':', 1) AS name, count(*) AS n FROM v GROUP BY 2
    UNION ALL SELECT 'edge', rel, count(*) FROM e GROUP BY 2
    """,
)
def graph_build(spark, sf_dir):
    return graph.counts(*detection_edges(spark, sf_dir))


@query(
    "khop",
    f"""
    WITH e AS {EDGES_SQL}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    top AS (SELECT src AS seed FROM e WHERE rel = 'GENERATED' GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 5),
    h1 AS (SELECT DISTINCT seed, dst AS id FROM top JOIN b ON b.src = seed),
    h2 AS (SELECT DISTINCT seed, dst AS id FROM h1 JOIN b ON b.src = id),
    h3 AS (SELECT DISTINCT seed, dst AS id FROM h2 JOIN b ON b.src = id),
    a AS (SELECT seed, seed AS id, 0 AS hops FROM top UNION ALL SELECT seed, id, 1 FROM h1 UNION ALL SELECT seed, id, 2 FROM h2 UNION ALL SELECT seed, id, 3 FROM h3),
    m AS (SELECT seed, id, min(hops) AS hops FROM a GROUP BY 1, 2)
    SELECT seed, hops, split_part(id, ':', 1) AS label, count(*) AS n FROM m GROUP BY 1, 2, 3
    """,
)
def khop(spark, sf_dir):
    edges = detection_edges(spark, sf_dir)[1]
    seeds = graph.user_clusters(edges, 1, 5).select(F.col("user").alias("id"))
    reached = graph.neighbourhood(edges, seeds, 3)
    return reached.groupBy("seed", "hops", F.substring_index("id", ":", 1).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "user_subgraph",
    f"WITH e AS {EDGES_SQL} SELECT g.src AS user, l.src AS detection, l.rel, l.dst AS entity FROM e g JOIN e l ON l.src = g.dst WHERE g.rel = 'GENERATED' AND l.rel <> 'GENERATED'",
)
def user_subgraph(spark, sf_dir):
    return graph.user_subgraph(detection_edges(spark, sf_dir)[1])


@query(
    "user_clusters",
    f"WITH e AS {EDGES_SQL} SELECT src AS user, count(*) AS detections FROM e WHERE rel = 'GENERATED' GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 20",
)
def user_clusters(spark, sf_dir):
    return graph.user_clusters(detection_edges(spark, sf_dir)[1], 3, 20)


@query(
    "shared_entity",
    f"""
    WITH e AS {EDGES_SQL}
    SELECT DISTINCT g.dst AS detection, g.src AS user FROM e g LEFT JOIN e l ON l.src = g.dst AND l.rel <> 'GENERATED'
    WHERE g.rel = 'GENERATED' AND (l.dst IN ('Application:error', 'Location:42') OR g.src = 'User:3')
    """,
)
def shared_entity(spark, sf_dir):
    return graph.detections_of(detection_edges(spark, sf_dir)[1], ["Application:error", "Location:42", "User:3"])


@query("entity_usage", f"WITH e AS {EDGES_SQL} SELECT rel, dst AS entity, count(*) AS usage FROM e WHERE rel <> 'GENERATED' GROUP BY 1, 2")
def entity_usage(spark, sf_dir):
    return graph.entity_usage(detection_edges(spark, sf_dir)[1])


@query(
    "entity_coverage",
    f"""
    WITH e AS {EDGES_SQL}, f AS (SELECT src, max(CASE WHEN rel = 'ACCESSED' THEN 1 ELSE 0 END) AS a, max(CASE WHEN rel = 'FROM_LOCATION' THEN 1 ELSE 0 END) AS l
      FROM e WHERE rel <> 'GENERATED' GROUP BY 1)
    SELECT count(*) AS detections, CAST(sum(a) AS BIGINT) AS has_accessed, CAST(sum(l) AS BIGINT) AS has_from_location FROM f
    """,
)
def entity_coverage(spark, sf_dir):
    return graph.entity_coverage(detection_edges(spark, sf_dir)[1], ["ACCESSED", "FROM_LOCATION"])


@query(
    "user_entity_sets",
    f"""
    WITH d AS (SELECT * FROM {DETECTIONS_SQL}),
    a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS r FROM (SELECT DISTINCT user_id, event_type FROM d)),
    l AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k) AS r FROM (SELECT DISTINCT user_id, k FROM d))
    SELECT c.user_id, c.total, c.recent, x.apps, y.places FROM
      (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS recent FROM d GROUP BY 1) c
      JOIN (SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS apps FROM a WHERE r <= 10 GROUP BY 1) x USING (user_id)
      JOIN (SELECT user_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY r) AS places FROM l WHERE r <= 10 GROUP BY 1) y USING (user_id)
    """,
)
def user_entity_sets(spark, sf_dir):
    # Written once: three groupings read the detections, each of which would score all events in its own tasks.
    rows = durable(detections(spark, sf_dir).select("user_id", "ts", "event_type", "k"))
    totals = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ts") > as_of() - F.expr("interval 7 days")).alias("recent"),
    )

    def named(column, out):
        few = ordered.top_k(rows.select("user_id", column).distinct(), ["user_id"], 10, F.asc(column))
        return few.groupBy("user_id").agg(
            F.array_join(F.sort_array(F.collect_list(column)).cast("array<string>"), ",").alias(out)
        )

    return totals.join(named("event_type", "apps"), "user_id").join(named("k", "places"), "user_id")


HETERO_SQL = """(
  SELECT DISTINCT 'client:' || o_custkey AS c, 'transaction:' || o_orderkey AS t, 'merchant:' || l_suppkey AS m
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def transaction_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"])


@query(
    "hetero_edges",
    f"""
    WITH b AS {HETERO_SQL}, e AS (SELECT c AS src, t AS dst, 'buy' AS rel FROM b UNION SELECT t, c, 'bought' FROM b UNION SELECT t, m, 'issued' FROM b UNION SELECT m, t, 'sell' FROM b)
    SELECT rel, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY 1
    """,
)
def hetero_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").count()  # from the files' footers
    edges = graph.transaction_edges(transaction_rows(spark, sf_dir), "o_custkey", "o_orderkey", "l_suppkey", rows)
    return edges.groupBy("rel").agg(
        F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets")
    )


@query(
    "neighbour_mean",
    f"""
    WITH b AS {HETERO_SQL},
    s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders),
    f AS (SELECT 'transaction:' || o_orderkey AS id, (o_totalprice - m) / (0.0001 + sd) AS price FROM orders, s),
    sell AS (SELECT DISTINCT t, m FROM b),
    h1 AS (SELECT m AS id, avg(price) AS price FROM sell JOIN f ON f.id = t GROUP BY 1)
    SELECT t AS id, round(avg(h1.price), 6) AS price FROM sell JOIN h1 ON h1.id = m GROUP BY 1
    """,
)
def neighbour_mean(spark, sf_dir):
    rows = transaction_rows(spark, sf_dir)
    transaction, merchant = graph.vertex("transaction", F.col("o_orderkey")), graph.vertex("merchant", F.col("l_suppkey"))
    edges = graph.paired_edges(rows, transaction, merchant, "issued", "sell")
    orders = graph.standardise(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    features = orders.select(graph.vertex("transaction", F.col("o_orderkey")).alias("id"), F.col("o_totalprice").alias("price"))
    out = graph.neighbour_mean(edges, features, ["price"], 2)
    return out.withColumn("price", F.round("price", 6))
