"""What the text operators share: session settings, row-safe joins for hot groups, connected components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import session

#: Rows of one Arrow batch handed to Python: texts are long, so batches are short.
BATCH_ROWS = "256"
BATCH_BYTES = str(8 << 20)
#: Heavy groups treated apart by ``name_groups`` and ``attach``; a group outside them has at most 1/1000 of the rows.
HEAVY_GROUPS = 1000
HEAVY_LEAST = 64
#: White space of the contracts: space and \x09-\x0D, so a word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: What an operator's tasks remember in a Python worker for its next tasks, by operator. Workers outlive stages, so only
#: the operator that runs keeps anything: see ``remembered``.
REMEMBERED: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """The store of the operator that now runs in this worker; what others remembered there goes."""
    others = [name for name in REMEMBERED if name != owner]
    for name in others:
        REMEMBERED[name].clear()
        del REMEMBERED[name]
    if others:
        gc.collect()
    return REMEMBERED.setdefault(owner, {})


def prepare(spark: SparkSession) -> SparkSession:
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return session.table(spark, sf_dir, "documents")


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) only, so that extra columns of any name cannot clash; a null text is the empty text."""
    prepare(docs.sparkSession)
    return docs.select(
        docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )


def release(spark: SparkSession) -> None:
    """Between written tables: let Spark notice that earlier shuffles are unreachable, so that their files go.

    Spark's listeners hold the query that ended last until another one ends, so a query of one row comes first.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``session.durable`` wrote and no later step reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path_of = sc._jvm.org.apache.hadoop.fs.Path
        root = path_of(sc._jsc.sc().getCheckpointDir().get()).toUri().getPath()
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = path_of(folder)
            if path.toUri().getPath().startswith(f"{root}/table-"):
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def heavy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that own most rows, at most HEAVY_GROUPS of them: small enough to broadcast whatever the input."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("heavy_rows"))
    return counts.filter(F.col("heavy_rows") >= HEAVY_LEAST).orderBy(F.desc("heavy_rows"), *keys).limit(HEAVY_GROUPS)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def attach(rows: DataFrame, stats: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Left join of per-group ``stats`` (unique in ``keys``) to rows, whole even if a group owns a third of them.

    The largest groups, known by their ``size`` column, are joined by broadcast (at most HEAVY_GROUPS rows); all
    other groups are small, so a shuffled join deals them out evenly. Both frames are read more than once:
    pass written tables. Key columns must not be null.
    """
    top = stats.filter(F.col(size) >= HEAVY_LEAST).orderBy(F.desc(size), *keys).limit(HEAVY_GROUPS)
    near = rows.join(F.broadcast(top), keys, "inner")
    far = rows.join(F.broadcast(top.select(*keys)), keys, "left_anti").join(stats, keys, "left")
    return near.unionByName(far)


def components(links: DataFrame, spark: SparkSession) -> DataFrame:
    """Connected components of undirected ``links`` (a, b): rows (node, root), root the smallest node reachable.

    Alternates two local steps until nothing changes: every node's larger neighbours are tied to its smallest
    neighbour, then every node's smaller neighbours are. The number of rounds grows with the logarithm of the
    longest path, and a step never lists the pairs of a group. Each round is written and read again.
    """
    edges = session.durable(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = session.durable(
            both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("size"))
        )
        large = attach(both.filter("v > u"), least, ["u"], "size").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = session.durable(large.filter("u <> v").distinct())
        low = session.durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")))
        tied = attach(large, low, ["u"], "size")
        edges = session.durable(
            tied.select("u", F.col("m").alias("v"))
            .unionByName(tied.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")
        ).first()
        # Settled when every node has one smaller neighbour and a round changes nothing.
        if tuple(now) == before and now[0] == now[2]:
            break
        before = tuple(now)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
