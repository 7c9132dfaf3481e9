"""Exact dedup by deterministic block naming, in DataFrame functions only.

A text is cut into blocks of fixed size. Blocks are sorted and get integer names: (hash, rank), where the rank
is the block's place among the different blocks of one hash, found by comparing their content. So equal blocks
have equal names and different blocks have different names, without any trust in the hash. Adjacent names are
then paired and the pairs named in the same way, halving the row count, until each document is one name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common

#: Characters of a block.
BLOCK = 4096


def integer_names(rows: DataFrame, keys: list[str], spread_by: str) -> DataFrame:
    """Replace ``keys`` by a name (h, r), equal exactly for rows with equal keys (null equals null).

    Blocks are dealt out by hash and sorted. The at most 1,000 heaviest hashes are named apart: their few
    different keys are found by a partial aggregation and joined back by broadcast, and their rows are spread
    by ``spread_by``, so that no block, however common, meets in one task.
    """
    rows = rows.withColumn("h", F.xxhash64(*keys))
    top = common.heavy(rows.select("h"), ["h"]).select("h")
    by_content = Window.partitionBy("h").orderBy(*keys)
    hot = (
        rows.join(F.broadcast(top), "h", "left_semi")
        .select("h", *keys)
        .distinct()
        .withColumn("hot_r", F.dense_rank().over(by_content))
    )
    hot = hot.select(F.col("h").alias("hot_h"), "hot_r", *[F.col(k).alias(f"hot_{k}") for k in keys])
    match = F.col("h") == F.col("hot_h")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"hot_{k}"))
    marked = rows.join(F.broadcast(hot), match, "left")
    is_hot = F.col("hot_r").isNotNull()
    marked = marked.select(
        *[c for c in rows.columns if c not in keys],
        "hot_r",
        F.when(is_hot, F.pmod(F.col(spread_by), F.lit(1009))).otherwise(-1).alias("lane"),
        *[F.when(~is_hot, F.col(k)).alias(k) for k in keys],
    )
    ranked = Window.partitionBy("h", "lane").orderBy(*keys)
    named = marked.withColumn("r", F.coalesce("hot_r", F.dense_rank().over(ranked)))
    return named.drop("hot_r", "lane", *keys)


def named_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: (row, id, text_sha256, level, h, r); (level, h, r) is the text's identity.

    A null text counts as empty. ``row`` tells rows apart that share an id.
    """
    base = common.text_rows(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    pieces = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    )
    blocks = base.select(
        "row",
        "id",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.greatest(F.lit(1), F.ceil(F.char_length("text") / F.lit(block))).cast("long").alias("n"),
        F.posexplode(pieces).alias("pos", "block"),
    )
    level = session.durable(integer_names(blocks, ["block"], "row"))
    longest = level.agg(F.max("n")).first()[0] or 1
    done = level.filter("n = 1").withColumn("level", F.lit(0)).drop("pos", "n")
    who = level.filter("pos = 0 and n > 1").select("row", "id", "text_sha256")
    names = level.filter("n > 1").select("row", "n", "pos", "h", "r")
    finished = []
    for k in range(1, math.ceil(math.log2(longest)) + 1 if longest > 1 else 1):
        even = F.col("pos") % 2 == 0
        pairs = names.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("half")).agg(
            F.max("n").alias("n"),
            F.max(F.when(even, F.col("h"))).alias("h1"),
            F.max(F.when(even, F.col("r"))).alias("r1"),
            F.max(F.when(~even, F.col("h"))).alias("h2"),
            F.max(F.when(~even, F.col("r"))).alias("r2"),
        )
        pairs = pairs.select(
            "row", F.ceil(F.col("n") / 2).cast("long").alias("n"), F.col("half").alias("pos"), "h1", "r1", "h2", "r2"
        )
        named = session.durable(integer_names(session.durable(pairs), ["h1", "r1", "h2", "r2"], "row"))
        finished.append(named.filter("n = 1").select("row", F.lit(k).alias("level"), "h", "r"))
        names = named.filter("n > 1").select("row", "n", "pos", "h", "r")
    columns = ["row", "id", "text_sha256", "level", "h", "r"]
    out = done.select(*columns)
    for part in finished:
        out = out.unionByName(part.join(who, "row").select(*columns))
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Groups of equal texts: (row, id, keep_id, group_size, kept, text_sha256), one row per input row.

    The row with the largest id stays. Of repeated rows with that same id one stays (the first read); a null id
    loses against any other. All empty and null texts are one group. An empty table gives no rows.
    """
    keys = ["level", "h", "r"]
    named = session.durable(named_documents(docs, id_col, text_col, block))
    stats = session.durable(named.groupBy(*keys).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")))
    rows = session.durable(common.attach(named, stats, keys, "group_size"))
    stays = rows.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy(*keys).agg(F.min("row").alias("row"))
    stays = stays.select("row", F.lit(True).alias("stays"))
    return rows.join(stays, "row", "left").select(
        "row", "id", "keep_id", "group_size", F.coalesce("stays", F.lit(False)).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The input's rows, all columns, without the copies that ``exact_groups`` drops."""
    common.prepare(docs.sparkSession)
    stays = exact_groups(docs, id_col, text_col, block).filter("kept")
    stays = session.durable(stays.select(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha")))
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    keyed = docs.withColumns({"__key": docs[id_col].cast("long"), "__text": F.sha2(text, 256)})
    match = keyed["__key"].eqNullSafe(stays["__id"]) & (keyed["__text"] == stays["__sha"])
    out = keyed.join(stays, match, "left_semi")
    # An id may come more than once with one text; only then are whole rows compared again.
    if docs.groupBy(docs[id_col].cast("long").alias("id")).count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates(["__key", "__text"])
    return out.drop("__key", "__text")
