"""Property graph as vertex and edge tables, and traversals as edge joins.

Edge joins group by the joined vertex. Traversals carry distinct (seed, vertex) frontiers, never paths, and
neighbour aggregates combine before the shuffle; AQE splits skewed join partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import by_key, durable

# Entity category, vertex label and edge name of detection-to-entity links.
ENTITY_EDGES = [
    ("app", "Application", "ACCESSED"),
    ("device", "Device", "FROM_DEVICE"),
    ("location", "Location", "FROM_LOCATION"),
    ("browser", "Browser", "USED_BROWSER"),
    ("os", "OperatingSystem", "ON_OS"),
    ("ip", "IPAddress", "FROM_IP"),
    ("client", "ClientApp", "VIA_CLIENT"),
]


def vertex(label: str, key: Column) -> Column:
    return F.concat(F.lit(label + ":"), key.cast("string"))


def detection_graph(df: DataFrame, user: str, detection: str, entities: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(vertices(id, label), edges(src, dst, rel)) of users, detections and their entities, without repeats."""
    named = {category: (label, rel) for category, label, rel in ENTITY_EDGES}
    links = [
        F.struct(
            vertex("User", F.col(user)).alias("src"),
            vertex("Detection", F.col(detection)).alias("dst"),
            F.lit("GENERATED").alias("rel"),
        )
    ]
    for category, column in entities.items():
        label, rel = named[category]
        links.append(
            F.when(
                F.col(column).isNotNull(),
                F.struct(
                    vertex("Detection", F.col(detection)).alias("src"),
                    vertex(label, F.col(column)).alias("dst"),
                    F.lit(rel).alias("rel"),
                ),
            )
        )
    edges = df.select(F.explode(F.array_compact(F.array(*links))).alias("e")).select("e.*").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.withColumn("label", F.substring_index("id", ":", 1)), edges


def merge_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent: an edge already stored is not added again."""
    return stored.unionByName(new).distinct()


def counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = vertices.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    links = edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.unionByName(links)


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, hops) of every vertex within ``depth`` undirected hops, with its shortest distance."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = both.distinct()
    reached = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops"))
    frontier = reached
    for hop in range(1, depth + 1):
        step = (
            frontier.join(both, frontier["id"] == both["src"])
            .select("seed", F.col("dst").alias("id"))
            .distinct()
            .join(reached.select("seed", "id"), ["seed", "id"], "left_anti")
            .withColumn("hops", F.lit(hop))
        )
        frontier = durable(step) if hop < depth else step
        reached = reached.unionByName(frontier)
    return reached


def user_subgraph(edges: DataFrame) -> DataFrame:
    """(user, detection, rel, entity): two edge joins from each user."""
    made = edges.filter("rel = 'GENERATED'").select(F.col("src").alias("user"), F.col("dst").alias("detection"))
    links = edges.filter("rel <> 'GENERATED'").select(F.col("src").alias("detection"), "rel", F.col("dst").alias("entity"))
    return made.join(links, "detection")


def user_clusters(edges: DataFrame, minimum: int, k: int) -> DataFrame:
    return (
        edges.filter("rel = 'GENERATED'")
        .groupBy(F.col("src").alias("user"))
        .agg(F.count(F.lit(1)).alias("detections"))
        .filter(F.col("detections") >= minimum)
        .orderBy(F.desc("detections"), "user")
        .limit(k)
    )


def detections_of(edges: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Distinct (detection, user) that touch any of the named entities, or belong to a named user."""
    made = edges.filter("rel = 'GENERATED'").select(F.col("dst").alias("detection"), F.col("src").alias("user"))
    by_entity = edges.filter(F.col("dst").isin(*entities) & (F.col("rel") != "GENERATED")).select(
        F.col("src").alias("detection")
    )
    by_user = made.filter(F.col("user").isin(*entities)).select("detection")
    return made.join(by_entity.unionByName(by_user).distinct(), "detection", "left_semi")


def entity_usage(edges: DataFrame) -> DataFrame:
    return edges.filter("rel <> 'GENERATED'").groupBy("rel", F.col("dst").alias("entity")).agg(
        F.count(F.lit(1)).alias("usage")
    )


def entity_coverage(edges: DataFrame, rels: Sequence[str]) -> DataFrame:
    """How many detections have at least one edge of each kind."""
    flags = edges.filter("rel <> 'GENERATED'").groupBy("src").agg(
        *[F.max((F.col("rel") == r).cast("int")).alias(r) for r in rels]
    )
    return flags.agg(
        F.count(F.lit(1)).alias("detections"), *[F.sum(r).cast("bigint").alias(f"has_{r.lower()}") for r in rels]
    )


def paired_edges(df: DataFrame, a: Column, b: Column, forth: str, back: str, rows: int = 0) -> DataFrame:
    """Edges in both directions between two columns; each pair is made unique once, before it is doubled.

    ``rows``, when known, bounds what a task makes unique at once.
    """
    pairs = by_key(df.select(a.alias("a"), b.alias("b")), "a", "b", rows=rows).distinct()
    ends = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(forth).alias("rel")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.lit(back).alias("rel")),
    )
    return pairs.select(F.explode(ends).alias("e")).select("e.*")


def transaction_edges(df: DataFrame, client: str, transaction: str, merchant: str, rows: int = 0) -> DataFrame:
    """Four typed edges per transaction row: buy, bought, issued, sell."""
    c, t, m = (vertex(n, F.col(x)) for n, x in (("client", client), ("transaction", transaction), ("merchant", merchant)))
    return paired_edges(df, c, t, "buy", "bought", rows).unionByName(paired_edges(df, t, m, "issued", "sell", rows))


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / (1e-4 + sample deviation), per column over the whole table."""
    stats = df.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns]
    ).first()
    return df.withColumns(
        {c: (F.col(c) - F.lit(stats[f"_m_{c}"])) / (F.lit(1e-4) + F.lit(stats[f"_s_{c}"])) for c in columns}
    )


def neighbour_mean(edges: DataFrame, features: DataFrame, columns: Sequence[str], hops: int = 1) -> DataFrame:
    """Mean of the neighbours' features, repeated per hop: the aggregation step of a graph convolution."""
    current = features.select("id", *columns)
    for _ in range(hops):
        message = edges.select("src", "dst").join(current.withColumnRenamed("id", "src"), "src")
        current = message.groupBy(F.col("dst").alias("id")).agg(*[F.avg(c).alias(c) for c in columns])
    return current
