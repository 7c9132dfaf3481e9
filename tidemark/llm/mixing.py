"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The mix is ``share`` of all words. Sources get targets by weight, none above ``most`` times its own size. The mix is
cut into blocks of equal size; blocks go to sources, and within a source to its shards, one after the other by
the highest quotient votes / (2 n + 1). A shard lays its documents end to end in a seeded order, so a document
covers a stretch of blocks. Whole rounds of a shard's quota take every block; the rest of the quota takes the blocks
that come first in the seeded order, so at most one document of a shard is taken in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common

SHARE, MOST = 1.5, 2
#: Words of a block, and words and rows of a shard at which a source is cut into more of them.
BLOCK, SHARD, SHARD_ROWS = 50, 2_000_000, 100_000
SEED = "mix-1"
#: The weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text):
    return F.regexp_count(text, F.lit(common.WORD)).cast("long")


def apportion(parties: DataFrame, within: str, votes: str, seats: str, key: str) -> DataFrame:
    """Add ``quota``: Sainte-Laguë seats of each party among those equal in ``within``; ties go to the smaller key.

    A party's n-th further seat costs the quotient votes / (2 n + 1). A divisor a little too large and one a
    little too small bracket the last quotient that wins: seats are certain up to the first count, and only the
    quotients between both counts, about two for each party, are listed and ranked.
    """
    group = Window.partitionBy(within)
    p = parties.withColumns(
        {"all_votes": F.sum(votes).over(group), "parties": F.count(F.when(F.col(votes) > 0, 1)).over(group)}
    )
    slack = F.col("parties") / 2 + 1
    low = F.try_divide(F.greatest(F.lit(0.0), F.col(seats) - slack), "all_votes")
    high = F.try_divide(F.col(seats) + slack, "all_votes")
    p = p.withColumns(
        {
            "sure": F.when(F.col(votes) > 0, F.floor(F.col(votes) * low + 0.5)).otherwise(0).cast("long"),
            "hope": F.when(F.col(votes) > 0, F.floor(F.col(votes) * high + 0.5) + 1).otherwise(0).cast("long"),
        }
    )
    p = p.withColumn("open_seats", F.col(seats) - F.sum("sure").over(group))
    quotients = (
        p.filter("hope > sure")
        .select(within, key, votes, "open_seats", F.explode(F.sequence("sure", F.col("hope") - 1)).alias("n"))
        .withColumn("quotient", F.col(votes) / (2 * F.col("n") + 1))
    )
    order = Window.partitionBy(within).orderBy(F.desc("quotient"), key)
    won = quotients.withColumn("place", F.row_number().over(order)).filter("place <= open_seats")
    won = won.groupBy(within, key).agg(F.count("*").alias("won"))
    out = p.join(won, [within, key], "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0)))
    return out.select(*parties.columns, "quota")


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add weight and target to (source, source_size), one row per source.

    Sources by code point, null last, weigh 5, 2, 1, repeating. Shares go by weight; a target stops at ``most``
    times its size and the excess is shared again. That equals filling all sources at one rate per weight: those
    with the smallest size per weight are full first, and what is left over gives the others' rate.
    """
    names = [F.col("source").isNull(), F.col("source")]
    rows = Window.orderBy(*names)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(rows) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sources.withColumn("weight", weight)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy(F.col("source_size") / F.col("weight"), *names).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    s = s.withColumns(
        {
            "left": F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)),
            "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)),
        }
    )
    s = s.withColumn("full", F.col("cap") <= F.col("left") / F.col("open") * F.col("weight"))
    # The first source in that order that isn't full fixes the rate: nobody has less open weight than those full.
    s = s.withColumn("at", F.max(F.when(~F.col("full"), F.struct("open", "left"))).over(every))
    rate = F.col("at.left") / F.col("at.open")
    return s.select(
        "source", "source_size", "weight",
        F.when(F.col("full"), F.col("cap")).otherwise(rate * F.col("weight")).alias("target"),
    )


def shard_count(words, rows, shard_words: int = SHARD, shard_rows: int = SHARD_ROWS):
    """Shards of a source: by its words, and by its rows where most are empty or very short."""
    return F.greatest(F.lit(1), F.ceil(words / F.lit(shard_words)), F.ceil(rows / F.lit(shard_rows))).cast("long")


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    share: float = SHARE, most: int = MOST, block: int = BLOCK, shard_words: int = SHARD, shard_rows: int = SHARD_ROWS, seed: str = SEED,
) -> DataFrame:
    """(row, id, source, size, source_size, weight, target, taken), one row per input row.

    A null text has size 0 and takes 0; a null source is a source of its own, ordered last. Repeated rows count
    each for itself. Seed and ids decide the order, so reruns agree; an empty table gives no rows. Only ids and
    counts are shuffled, never texts, and a source of any size is spread over shards of about ``shard_words`` words or
    ``shard_rows`` rows, whichever gives more of them.
    """
    common.prepare(docs.sparkSession)
    ids = docs[id_col].cast("long")
    rows = docs.select(
        ids.alias("id"),
        docs[source_col].cast("string").alias("source"),
        word_count(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ids, F.monotonically_increasing_id()).cast("string")).cast("binary")).alias("turn"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = session.durable(rows.withColumn("name", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))))
    sizes = rows.groupBy("name", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("members"))
    goals = targets(sizes.select("source", "source_size"), share, most)
    goals = goals.withColumn("name", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))).drop("source", "source_size")
    sources = session.durable(sizes.join(goals, "name").drop("source"))

    shards = shard_count(F.col("source_size"), F.col("members"), shard_words, shard_rows)
    dealt = common.attach(rows, sources, ["name"], "members")
    dealt = session.durable(
        dealt.withColumn("shard", F.conv(F.substring("turn", 25, 8), 16, 10).cast("long") % shards)
    )
    line = Window.partitionBy("name", "shard").orderBy("turn", "row").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("start", F.sum("size").over(line) - F.col("size"))

    # Blocks go to the sources by their targets, then to the shards of a source by their words.
    total = Window.partitionBy("mix")
    seats = sources.withColumn("mix", F.lit(0)).withColumn(
        "seats", F.round(F.sum("target").over(total) / block).cast("long")
    )
    quotas = apportion(seats, "mix", "target", "seats", "name").select("name", F.col("quota").alias("source_quota"))
    parts = dealt.groupBy("name", "shard").agg(F.sum("size").alias("shard_size")).join(quotas, "name")
    parts = apportion(parts, "name", "shard_size", "source_quota", "shard")
    blocks = F.ceil(F.col("shard_size") / F.lit(block)).cast("long")
    parts = parts.select(
        "name", "shard",
        F.least("quota", blocks * most).alias("quota"), blocks.alias("blocks"),
    )
    rounds = F.coalesce(F.floor(F.try_divide(F.col("quota"), F.col("blocks"))), F.lit(0)).cast("long")
    parts = parts.withColumn("rounds", rounds).withColumn("extra_words", (F.col("quota") - F.col("rounds") * F.col("blocks")) * block)
    first = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("extra_words")) - F.col("start"))
    return laid.join(parts, ["name", "shard"]).select(
        "row", "id", "source", "size", "source_size", "weight", "target",
        (F.col("rounds") * F.col("size") + first).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The input's rows, all columns, each as often as the mix takes it: taken / size, halves up.

    Rows without words and rows of which less than half is taken go. Repeated rows of an id share its takes evenly.
    """
    takes = mixture(docs, id_col, text_col, source_col, **options)
    takes = takes.groupBy("id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.floor(F.try_divide(2 * F.col("taken") + F.col("size"), 2 * F.col("size"))).cast("int")
    takes = session.durable(takes.select(F.col("id").alias("__id"), times.alias("__times")).filter("__times > 0"))
    small = session.broadcast_if_small(takes)
    out = docs.join(small, docs[id_col].cast("long").eqNullSafe(F.col("__id")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).drop("__id", "__times", "__copy")
