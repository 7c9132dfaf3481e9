"""Ordered per-user analytics: training windows, snapshots, escalation, rolling statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def change_signal(df: DataFrame, user: str, order: Sequence[str], column: str, out: str) -> DataFrame:
    """1 where the value differs from the previous event of the user, 0 on the first event."""

    def columns(w):
        before = F.lag(column).over(w)
        first = F.lag(F.lit(1)).over(w).isNull()
        return {out: F.when(first | before.eqNullSafe(F.col(column)), 0).otherwise(1)}

    return ordered.framed(df, [user], order, 1, 0, columns)


def rolling_stats(
    df: DataFrame, user: str, order: Sequence[str], value: str, size: int, min_periods: int
) -> DataFrame:
    """Rolling sum, mean and sample deviation over ``size`` rows; null below ``min_periods`` values."""

    def columns(w):
        frame = w.rowsBetween(-(size - 1), 0)
        enough = F.count(value).over(frame) >= min_periods
        return {
            "rolling_sum": F.when(enough, F.sum(value).over(frame)),
            "rolling_mean": F.when(enough, F.avg(value).over(frame)),
            "rolling_std": F.when(enough, F.stddev_samp(value).over(frame)),
        }

    return ordered.framed(df, [user], order, size - 1, 0, columns)


def training_window(
    df: DataFrame,
    user: str,
    ts: str,
    row_id: str,
    is_new: Column,
    min_history: int,
    min_increment: int,
    max_history: int | str | None,
) -> DataFrame:
    """Rows each user trains on now.

    A user qualifies with at least ``min_history`` rows, ``min_increment`` of them new. The window is the
    last ``max_history`` rows, or the rows within that duration of the latest; new rows are never cut.
    """
    rows = df.withColumn("_new", is_new)
    stats = rows.groupBy(user).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("_new").alias("_n_new"),
        F.max(ts).alias("_latest"),
        F.min(F.when(F.col("_new"), F.col(ts))).alias("_first_new"),
    )
    ready = stats.filter((F.col("_n") >= min_history) & (F.col("_n_new") >= min_increment))
    if isinstance(max_history, str):
        start = F.least(F.col("_latest") - F.expr(f"interval {max_history}"), F.col("_first_new"))
        kept = rows.join(ready, user).filter(F.col(ts) >= start)
    elif max_history is None:
        kept = rows.join(ready, user)
    else:
        indexed = ordered.row_index(rows, [user], [ts, row_id], "_i")
        size = F.greatest(F.lit(max_history), F.col("_n_new"))
        kept = indexed.join(ready, user).filter(F.col("_i") >= F.col("_n") - size).drop("_i")
    return kept.drop("_new", "_n", "_n_new", "_latest", "_first_new")


def accept_newer(incoming: DataFrame, history: DataFrame, user: str, ts: str) -> DataFrame:
    """Incoming rows strictly later than everything the user's history holds."""
    seen = history.groupBy(user).agg(F.max(ts).alias("_max"))
    joined = incoming.join(seen, user, "left")
    return joined.filter(F.col("_max").isNull() | (F.col(ts) > F.col("_max"))).drop("_max")


def batch_verdicts(incoming: DataFrame, history: DataFrame, user: str, ts: str) -> DataFrame:
    """Per user: accepted rows and whether the append succeeds (an all-old batch may not precede history)."""
    seen = history.groupBy(user).agg(F.max(ts).alias("_max"), F.min(ts).alias("_min"))
    joined = incoming.join(seen, user, "left")
    newer = F.col("_max").isNull() | (F.col(ts) > F.col("_max"))
    counts = joined.groupBy(user).agg(
        F.count_if(newer).alias("accepted"),
        F.count_if(~newer).alias("rejected"),
        F.count_if(F.col(ts) < F.col("_min")).alias("before_history"),
    )
    return counts.withColumn("success", (F.col("accepted") > 0) | (F.col("before_history") == 0))


def window_overlap(window: DataFrame, incoming: DataFrame, user: str, columns: Sequence[str]) -> DataFrame:
    """Per user: incoming rows, and how many of them the window holds (by row hash)."""
    hashed = F.xxhash64(*columns).alias("_h")
    held = window.select(user, hashed).distinct().withColumn("_held", F.lit(1))
    rows = incoming.select(user, hashed).join(held, [user, "_h"], "left")
    out = rows.groupBy(user).agg(F.count(F.lit(1)).alias("incoming_rows"), F.count("_held").alias("found_rows"))
    return out.withColumn("complete", F.col("incoming_rows") == F.col("found_rows"))


def consecutive_windows(
    df: DataFrame, keys: Sequence[str], snapshot: str, features: Sequence[str], size: int, padding: float = -1.0
) -> DataFrame:
    """Windows of ``size`` consecutive snapshot ids starting at each row, features flattened.

    Rows without a full consecutive window get ``sequence`` = 'dummy' and padding.
    """

    def columns(w):
        frame = w.rowsBetween(0, size - 1)
        return {
            "_ids": F.collect_list(snapshot).over(frame),
            "_data": F.flatten(F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(frame)),
        }

    rows = ordered.framed(df, keys, [snapshot], 0, size - 1, columns)
    first, last = F.element_at("_ids", 1), F.element_at("_ids", -1)
    real = (F.size("_ids") == size) & (last - first == size - 1)
    pad = F.array_repeat(F.lit(padding), size * len(features))
    return rows.select(
        *keys,
        snapshot,
        F.when(real, F.concat_ws("-", first.cast("string"), last.cast("string"))).otherwise("dummy").alias("sequence"),
        F.when(real, F.col("_data")).otherwise(pad).alias("data"),
    )


def escalations(
    df: DataFrame, user: str, ts: str, row_id: str, score: str, within_seconds: int = 7200
) -> DataFrame:
    """Label pairs of consecutive events where the later one, soon after, scores strictly higher."""

    def columns(w):
        return {
            "_next_ts": F.lead(ts).over(w), "_next": F.lead(score).over(w),
            "_prev_ts": F.lag(ts).over(w), "_prev": F.lag(score).over(w),
        }

    rows = ordered.framed(df, [user], [ts, row_id], 1, 1, columns)
    after = seconds_between(F.col("_next_ts"), F.col(ts)).between(0, within_seconds) & (F.col("_next") > F.col(score))
    before_s = seconds_between(F.col(ts), F.col("_prev_ts"))
    before = before_s.between(0, within_seconds) & (F.col(score) > F.col("_prev"))
    labelled = rows.withColumn(
        "significance",
        F.when(before, "Score escalation").when(after, "Escalation trigger").otherwise(""),
    )
    return (
        labelled.withColumn("score_gain", F.when(before, F.col(score) - F.col("_prev")))
        .withColumn("minutes", F.when(before, before_s / 60))
        .drop("_next_ts", "_next", "_prev_ts", "_prev")
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key: one row per key leaves each map task."""
    return ordered.latest(df, keys, *order)


def top_features(z_scores: Mapping[str, Column], values: Mapping[str, Column], n: int = 3) -> Column:
    """Array of (name, value, z) of the ``n`` largest |z|, largest first."""
    items = F.array(
        *[
            F.struct(
                F.coalesce(F.abs(z), F.lit(0.0)).alias("abs_z"),
                F.lit(name).alias("name"),
                values[name].cast("string").alias("value"),
            )
            for name, z in z_scores.items()
        ]
    )
    return F.slice(F.sort_array(items, asc=False), 1, n)


def top_features_text(top: Column) -> Column:
    return F.array_join(
        F.transform(
            top,
            lambda f: F.concat(
                f["name"], F.lit("="), F.coalesce(f["value"], F.lit("None")),
                F.lit(" (z="), F.format_string("%.2f", f["abs_z"]), F.lit(")"),
            ),
        ),
        ", ",
    )
