"""Joins, version tables and JSON aggregation over related tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.schema import regex_select
from tidemark.session import broadcast_if_small


def latest_version(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """DISTINCT ON (keys) ... ORDER BY order DESC: one row per key leaves each map task."""
    return ordered.latest(df, keys, *order)


def next_version(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def in_set(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(broadcast_if_small(ids.select(on).distinct()), on, "left_semi")


def not_in_set(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on).distinct(), on, "left_anti")


def union_by_name(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def children_json(
    parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: Sequence[str],
    fields: Sequence[str], keep: Column | None = None, out: str = "items",
) -> DataFrame:
    """Each parent with its children as one ordered array of structs, empty when it has none.

    The array is the result asked for; children are reduced to the listed fields before they move.
    """
    rows = children.filter(keep) if keep is not None else children
    packed = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    listed = rows.groupBy(F.col(child_key).alias(parent_key)).agg(packed.alias(out))
    joined = parents.join(listed, parent_key, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.array().cast(joined.schema[out].dataType)))


def unnest_counts(df: DataFrame, array: Column, out: str = "item") -> DataFrame:
    return df.select(F.explode(array).alias(out)).groupBy(out).agg(F.count(F.lit(1)).alias("n"))


def step_latency(df: DataFrame, order: Sequence[Column], newest: int, steps: Column, name: str, latency: str) -> DataFrame:
    """Average latency per step name over the newest rows."""
    rows = df.orderBy(*order).limit(newest).select(F.explode(steps).alias("s"))
    return rows.filter(F.col(f"s.{name}").isNotNull()).groupBy(F.col(f"s.{name}").alias(name)).agg(
        F.avg(f"s.{latency}").alias("avg_latency"), F.count(F.lit(1)).alias("invocations")
    )


def compare(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str],
    abs_tol: float = 0.001, rel_tol: float = 0.005,
) -> DataFrame:
    """Row-by-row comparison: matching, differing, missing and extra rows, plus differences per column.

    Numbers match when |a - b| <= abs_tol + rel_tol * |b|; nulls match nulls.
    """
    numeric = {c for c, t in left.select(*columns).dtypes if t not in ("string", "boolean") and "timestamp" not in t}
    a = left.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full_outer")
    same: dict[str, Column] = {}
    for c in columns:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        equal = x.eqNullSafe(y)
        if c in numeric:
            equal = equal | F.coalesce(F.abs(x - y) <= abs_tol + rel_tol * F.abs(y), F.lit(False))
        same[c] = equal
    present = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    all_same = F.lit(True)
    for e in same.values():
        all_same = all_same & e
    return both.agg(
        F.count_if(F.col("_l").isNotNull()).alias("total_rows"),
        F.count_if(present & all_same).alias("matching_rows"),
        F.count_if(present & ~all_same).alias("diff_rows"),
        F.count_if(F.col("_r").isNull()).alias("missing_rows"),
        F.count_if(F.col("_l").isNull()).alias("extra_rows"),
        *[F.count_if(present & ~e).alias(f"diff_{c}") for c, e in same.items()],
    )


def column_difference(left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    a, b = set(left.columns), set(right.columns)
    return {"extra": sorted(b - a), "missing": sorted(a - b), "matching": sorted(a & b)}


def validation_report(
    left: DataFrame, right: DataFrame, keys: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ("^ID$", "^_ts_"),
    abs_tol: float = 0.001, rel_tol: float = 0.005,
) -> DataFrame:
    """One row: ``compare`` over the columns both sides have, and the names of extra, missing and matching columns.

    ``include`` and ``exclude`` are patterns of column names; keys are compared by the join alone.
    """
    chosen = lambda df: regex_select(df.drop(*keys), include, exclude)
    names = column_difference(chosen(left), chosen(right))
    counts = compare(left, right, keys, names["matching"], abs_tol, rel_tol)
    lists = [F.lit(names[kind]).cast("array<string>").alias(f"{kind}_columns") for kind in ("extra", "missing", "matching")]
    return counts.select("*", *lists)


def best_entities(df: DataFrame, doc: str, kind: str, text: str, confidence: str) -> DataFrame:
    """One row per (document, type, text): the most confident."""
    return latest_version(df, [doc, kind, text], confidence)


def rules_for(df: DataFrame, key: str, rules: DataFrame, default: str = "Unknown") -> DataFrame:
    """Join a rules table (key, priority, action, ...); unlisted keys use the default rule set."""
    names = broadcast_if_small(rules.select(F.col(key).alias("_known")).distinct())
    tagged = df.join(names, df[key] == names["_known"], "left").withColumn(
        "_rule", F.coalesce("_known", F.lit(default))
    )
    return tagged.join(broadcast_if_small(rules.withColumnRenamed(key, "_rule")), "_rule", "left").drop("_rule", "_known")


def retrain_due(activity: DataFrame, log: DataFrame, key: str, threshold: int) -> DataFrame:
    """Rows since the last logged training per key, and whether they reach the threshold."""
    trained = log.groupBy(key).agg(F.max("trained_rows").alias("trained_rows"))
    counts = activity.groupBy(key).agg(F.count(F.lit(1)).alias("total_rows"))
    out = counts.join(trained, key, "left").na.fill(0, ["trained_rows"])
    delta = F.col("total_rows") - F.col("trained_rows")
    return out.withColumn("delta", delta).withColumn("due", delta >= threshold)


def session_counts(sessions: DataFrame, messages: DataFrame, session: str, role: str = "role") -> DataFrame:
    """Every session with its number of user messages, 0 when it has none."""
    asked = messages.groupBy(session).agg(F.count_if(F.col(role) == "user").alias("user_messages"))
    return sessions.join(asked, session, "left").na.fill(0, ["user_messages"])


def drift(df: DataFrame, batch: str, labels: Mapping[str, str]) -> DataFrame:
    """Per batch: mean of |p - 0.5| + 0.5 per label, and their mean over all labels."""
    means = {f"{n}_drift": F.avg(F.abs(F.col(c) - 0.5) + 0.5) for n, c in labels.items()}
    out = df.groupBy(batch).agg(*[c.alias(n) for n, c in means.items()])
    total = sum((F.col(n) for n in means), F.lit(0.0)) / len(means)
    return out.withColumn("total_drift", total)


def retained(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return df.filter(F.col(ts) >= as_of - F.expr(f"interval {days} days"))


def top_per_key(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    return ordered.top_k(df, keys, k, *order)
