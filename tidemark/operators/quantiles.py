"""Exact interpolated quantiles without gathering a group's values in one place.

Values are first counted (map-side combined), the counts are accumulated in value order by
:func:`tidemark.operators.ordered.running_sum` (which splits large keys), and each quantile is read off
as the value whose cumulative count first passes the wanted position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.session import durable


def _value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Written down once: several passes follow, and the input may be costly to compute."""
    return durable(
        df.select(*keys, F.col(value).alias("_x"))
        .filter("_x is not null")
        .groupBy(*keys, "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """One row per key with a column per name in ``wanted`` (linear interpolation); nulls are ignored."""
    counts = _value_counts(df, keys, value)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    placed = ordered.running_sum(counts, keys, ["_x"], F.col("_c"), "_upto")
    if keys:
        placed = ordered._null_safe(placed, totals, keys, "inner")
    else:
        placed = placed.withColumn("_n", F.lit(totals.first()["_n"]))

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_upto") > position, F.col("_x")))

    picks = []
    for name, p in wanted.items():
        position = F.lit(p) * (F.col("_n") - 1)
        picks.append(at(F.floor(position)).alias(f"_lo_{name}"))
        picks.append(at(F.ceil(position)).alias(f"_hi_{name}"))
    out = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    columns = []
    for name, p in wanted.items():
        position = F.lit(p) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return out.select(*keys, *columns)


def _placed(counts: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """Counted values with ``_upto``, how many of their key are not larger, and ``_n``, how many it has."""
    counts = durable(counts.select(*keys, F.col(value).alias("_x"), F.col(count).alias("_c")).filter("_x is not null"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    placed = ordered.running_sum(counts, keys, ["_x"], F.col("_c"), "_upto")
    if keys:
        return ordered._null_safe(placed, totals, keys, "inner")
    return placed.withColumn("_n", F.lit(totals.first()["_n"]))


def weighted_lower_median(counts: DataFrame, keys: Sequence[str], value: str, count: str, out: str) -> DataFrame:
    """``lower_median`` of values that are counted already, each value of a key once."""
    middle = F.floor((F.col("_n") - 1) / 2)
    placed = _placed(counts, keys, value, count)
    return placed.groupBy(*keys).agg(F.min(F.when(F.col("_upto") > middle, F.col("_x"))).alias(out))


def weighted_knots(counts: DataFrame, keys: Sequence[str], value: str, count: str, knots: int, out: str) -> DataFrame:
    """Array of ``knots`` evenly spaced quantiles (linear interpolation) of counted values, smallest and largest included.

    A value lists the positions it covers, so a key passes on at most two numbers for every knot.
    """
    placed = _placed(counts, keys, value, count)
    step = (F.col("_n") - 1) / F.lit(knots - 1.0)
    wanted = F.transform(
        F.sequence(F.lit(0), F.lit(knots - 1)), lambda j: F.struct(j.alias("j"), F.least(j * step, (F.col("_n") - 1).cast("double")).alias("at"))
    )
    covers = lambda position: (position < F.col("_upto")) & (position >= F.col("_upto") - F.col("_c"))
    near = F.filter(wanted, lambda w: covers(F.floor(w["at"])) | covers(F.ceil(w["at"])))
    rows = placed.select(*keys, "_x", "_upto", "_c", F.explode(near).alias("w")).select(*keys, "_x", "_upto", "_c", "w.*")
    low = F.max(F.when(covers(F.floor("at")), F.col("_x")))
    high = F.max(F.when(covers(F.ceil("at")), F.col("_x")))
    share = F.first(F.col("at") - F.floor("at"))
    each = rows.groupBy(*keys, "j").agg((low + (high - low) * share).alias("x"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda k: k["x"]).alias(out))


def lower_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Median that takes the lower middle value of an even count, without interpolation."""
    counts = _value_counts(df, keys, value)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    placed = ordered.running_sum(counts, keys, ["_x"], F.col("_c"), "_upto")
    if keys:
        placed = ordered._null_safe(placed, totals, keys, "inner")
    else:
        placed = placed.withColumn("_n", F.lit(totals.first()["_n"]))
    middle = F.floor((F.col("_n") - 1) / 2)
    return placed.groupBy(*keys).agg(F.min(F.when(F.col("_upto") > middle, F.col("_x"))).alias(out))
