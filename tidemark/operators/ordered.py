"""Per-key ordered analytics that stay balanced when one key owns a large share of the rows.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task. Every function here first
measures the keys with a map-side-combined count. If no key is larger than ``tidemark.hot.rows`` the
plain window is used: one shuffle, one sort. Otherwise the rows of the large keys alone are range
partitioned on (key, order), which cuts a key into consecutive blocks of about equal size; windows then
run inside (key, block) and a small per-block carry joins the blocks up again. Results are the same.

``order`` lists ascending column names whose last member makes the order total (a row id).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import broadcast_if_small, durable, hot_rows

BLOCK = "_block"


@dataclass
class Blocks:
    rows: DataFrame  # all rows, with the block number
    hot: DataFrame | None  # rows of split keys only (materialised); None when nothing was split


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True)
    )
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Blocks:
    limit = hot_rows(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.agg(
        F.max("_n").alias("largest"), F.sum(F.when(F.col("_n") > limit, F.col("_n"))).alias("hot")
    ).first()
    if (totals["largest"] or 0) <= limit:
        return Blocks(df.withColumn(BLOCK, F.lit(0)), None)
    pieces = -(-totals["hot"] // limit) + 1
    if keys:
        hot_keys = broadcast_if_small(sizes.filter(F.col("_n") > limit).select(*keys))
        large = _null_safe(df, hot_keys, keys, "left_semi")
        rest = _null_safe(df, hot_keys, keys, "left_anti").withColumn(BLOCK, F.lit(0))
    else:
        large, rest = df, None
    # The block number depends on sampled range bounds, so it is written down before it is used twice.
    hot = durable(
        large.repartitionByRange(int(pieces), *keys, *order).withColumn(BLOCK, F.spark_partition_id())
    )
    return Blocks(hot if rest is None else rest.unionByName(hot), hot)


def _with_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _null_safe(rows, broadcast_if_small(carry), [*keys, BLOCK], "left")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Inclusive running sum of ``value`` per key."""
    df = df.withColumn("_v", value)
    blocks = blocked(df, keys, order)
    within = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.rows.withColumn(out, F.sum("_v").over(within))
    if blocks.hot is not None:
        earlier = (
            Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = (
            blocks.hot.groupBy(*keys, BLOCK)
            .agg(F.sum("_v").alias("_s"))
            .withColumn("_carry", F.sum("_s").over(earlier))
            .filter(F.col("_carry").isNotNull())
            .drop("_s")
        )
        total = F.coalesce(F.col(out), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
        rows = _with_carry(rows, carry, keys).withColumn(
            out, F.when(F.col(out).isNull() & F.col("_carry").isNull(), None).otherwise(total)
        ).drop("_carry")
    return rows.drop(BLOCK, "_v")


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """0-based position of each row within its key."""
    return running_columns(df, keys, order, index=[out])


def running_distinct(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """How many distinct values a key has shown so far, the current row included."""
    return running_columns(df, keys, order, distinct={out: value})


def running_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    index: Sequence[str] = (),
    distinct: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Row positions and running distinct counts of the same keys and order, from one measurement and one shuffle."""
    distinct = dict(distinct or {})
    df = df.withColumns({f"_d_{out}": value for out, value in distinct.items()})
    blocks = blocked(df, keys, order)
    rows, hot = blocks.rows, blocks.hot
    if distinct and (keys or hot is not None):
        # Placing rows by key first lets every (key, value) window below reuse that placement.
        rows = rows.repartition(*keys, BLOCK)
    for out in distinct:
        first = Window.partitionBy(*keys, BLOCK, f"_d_{out}").orderBy(*order)
        rows = rows.withColumn(f"_new_{out}", (F.row_number().over(first) == 1).cast("long"))
        if hot is not None:
            rows = _without_repeats(rows, hot, keys, out)
    within = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            **{out: (F.row_number().over(within) - 1).cast("long") for out in index},
            **{out: F.sum(f"_new_{out}").over(so_far) for out in distinct},
        }
    )
    if hot is not None:
        rows = _with_carry(rows, _block_offsets(hot, keys, list(index), list(distinct)), keys)
        for out in [*index, *distinct]:
            rows = rows.withColumn(out, F.col(out) + F.coalesce(F.col(f"_carry_{out}"), F.lit(0)))
        rows = rows.drop(*[f"_carry_{out}" for out in [*index, *distinct]])
    return rows.drop(BLOCK, *[f"_d_{o}" for o in distinct], *[f"_new_{o}" for o in distinct])


def _value_debuts(hot: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Each (key, value, block) once, with its position among the blocks that show the value."""
    seen = hot.groupBy(*keys, f"_d_{out}", BLOCK).agg(F.lit(1).alias("_x"))
    spec = Window.partitionBy(*keys, f"_d_{out}").orderBy(BLOCK)
    return seen.withColumn("_rn", F.row_number().over(spec))


def _without_repeats(rows: DataFrame, hot: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """A value that an earlier block of the key has shown is not new in this one."""
    repeats = _value_debuts(hot, keys, out).filter("_rn > 1").select(
        *keys, BLOCK, f"_d_{out}", F.lit(True).alias("_repeat")
    )
    joined = _null_safe(rows, broadcast_if_small(repeats), [*keys, BLOCK, f"_d_{out}"], "left")
    fresh = F.when(F.col("_repeat"), F.lit(0)).otherwise(F.col(f"_new_{out}"))
    return joined.withColumn(f"_new_{out}", fresh).drop("_repeat")


def _block_offsets(hot: DataFrame, keys: Sequence[str], index: Sequence[str], distinct: Sequence[str]) -> DataFrame:
    """Per (key, block): what the earlier blocks of the key add up to, per output column."""
    sizes = hot.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_rows"))
    for out in distinct:
        fresh = _value_debuts(hot, keys, out).groupBy(*keys, BLOCK).agg(
            F.count_if(F.col("_rn") == 1).alias(f"_fresh_{out}")
        )
        sizes = _null_safe(sizes, fresh, [*keys, BLOCK], "left")
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"_carry_{out}": F.sum("_rows").over(earlier) for out in index}
    sums.update({f"_carry_{out}": F.sum(f"_fresh_{out}").over(earlier) for out in distinct})
    return sizes.withColumns(sums).select(*keys, BLOCK, *sums)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    columns: Callable[[Window], dict[str, Column]],
) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``columns`` receives the ordered window spec and returns the columns to add. When keys are split,
    each block also receives copies of the neighbouring rows it looks at; the copies are dropped again.
    """
    limit = hot_rows(df.sparkSession)
    largest = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    )
    if largest <= limit:
        spec = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns(columns(spec))
    size = max(limit, before + after + 1)
    rows = row_index(df, keys, order, "_g")
    block = F.floor(F.col("_g") / size).cast("long")
    offset = F.col("_g") % size
    targets = F.array_compact(
        F.array(
            block,
            F.when(offset >= size - before, block + 1),
            F.when((offset < after) & (block > 0), block - 1),
        )
    )
    rows = rows.withColumn("_own", block).withColumn(BLOCK, F.explode(targets))
    spec = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    return (
        rows.withColumns(columns(spec))
        .filter(F.col(BLOCK) == F.col("_own"))
        .drop(BLOCK, "_own", "_g")
    )


def fill_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], source: str, out: str, forward: bool = True
) -> DataFrame:
    """Carry the nearest earlier (or, with ``forward=False``, later) non-null value onto each row."""
    blocks = blocked(df, keys, order)
    # Backward fill reads the rows in reverse: a frame that ends at the last row would be recomputed per row.
    direction = F.asc if forward else F.desc
    base = Window.partitionBy(*keys, BLOCK).orderBy(*[direction(c) for c in order])
    across = Window.partitionBy(*keys).orderBy(direction(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.last(source, ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.rows.withColumn(out, pick)
    if blocks.hot is not None:
        known = F.col(source).isNotNull()
        nearest = F.max_by if forward else F.min_by
        edges = blocks.hot.groupBy(*keys, BLOCK).agg(
            nearest(F.col(source), F.when(known, F.struct(*order))).alias("_e")
        )
        carry = F.last("_e", ignorenulls=True).over(across)
        edges = edges.withColumn("_carry", carry).filter(F.col("_carry").isNotNull()).drop("_e")
        rows = _with_carry(rows, edges, keys).withColumn(
            out, F.coalesce(F.col(out), F.col("_carry"))
        ).drop("_carry")
    return rows.drop(BLOCK)


def top_k(df: DataFrame, keys: Sequence[str], k: int, *ordering: Column, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key. Spark trims to k per key in every map task before the shuffle."""
    spec = Window.partitionBy(*keys).orderBy(*ordering)
    return df.withColumn(rank, F.row_number().over(spec)).filter(F.col(rank) <= k)


def latest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row of each key that is last by ``order``, nulls before all values."""
    return top_k(df, keys, 1, *[F.desc_nulls_last(c) for c in order], rank="_rank").drop("_rank")
