"""Behaviour profiles and data-quality rules per user."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.quantiles import quantiles
from tidemark.session import durable


def value_counts(df: DataFrame, user: str, dimensions: Sequence[str]) -> DataFrame:
    """(user, dim, value, n): all dimensions counted in one unpivoted pass."""
    rows = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return (
        df.select(user, F.explode(rows).alias("_d"))
        .filter("_d.value is not null")
        .groupBy(user, F.col("_d.dim").alias("dim"), F.col("_d.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_values(df: DataFrame, user: str, dimensions: Sequence[str], k: int) -> DataFrame:
    return ordered.top_k(value_counts(df, user, dimensions), [user, "dim"], k, F.desc("n"), F.asc("value"))


def _shares(counts: DataFrame, user: str, dim: str, dtype: str = "string") -> DataFrame:
    """Counts of one dimension with the user's total."""
    rows = counts.filter(F.col("dim") == dim).select(user, F.col("value").cast(dtype).alias(dim), "n")
    return rows.join(rows.groupBy(user).agg(F.sum("n").alias("total")), user)


def activity_hours(df: DataFrame, user: str, ts: str) -> DataFrame:
    """Peak hours (top 5), active range (hours with 5 % or more), off hours (under 1 %), typical weekdays (10 %).

    Works on at most 24 + 7 counted rows per user.
    """
    dated = df.select(user, F.hour(ts).alias("hour"), F.weekday(ts).alias("day"))
    counts = durable(value_counts(dated, user, ["hour", "day"]))
    hours, days = _shares(counts, user, "hour", "int"), _shares(counts, user, "day", "int")

    def at_least(share: float) -> Column:
        return F.col("n") >= F.greatest(F.lit(1.0), F.col("total") * share)

    peak = ordered.top_k(hours, [user], 5, F.desc("n"), F.asc("hour")).groupBy(user).agg(
        F.sort_array(F.collect_list("hour")).alias("peak_hours")
    )
    spans = hours.groupBy(user).agg(
        F.min(F.when(at_least(0.05), F.col("hour"))).alias("active_from"),
        (F.max(F.when(at_least(0.05), F.col("hour"))) + 1).alias("active_to"),
        F.array_sort(
            F.array_except(
                F.sequence(F.lit(0), F.lit(23)), F.collect_set(F.when(at_least(0.01), F.col("hour")))
            )
        ).alias("off_hours"),
    )
    weekdays = days.groupBy(user).agg(
        F.sort_array(F.collect_list(F.when(at_least(0.10), F.col("day")))).alias("typical_days")
    )
    return spans.join(peak, user).join(weekdays, user)


def behaviour_baseline(
    df: DataFrame, user: str, ts: str, app: str, location: str, common_apps: Sequence[str]
) -> DataFrame:
    """Normal behaviour of each user as one row, from one counting pass and one daily pass over the rows."""
    shaped = df.select(
        user, F.col(app).alias("app"), F.col(location).alias("place"), F.hour(ts).alias("hour"),
        F.weekday(ts).alias("day"), F.to_date(ts).alias("date"),
    )
    counts = durable(value_counts(shaped, user, ["app", "place", "hour", "day"]))
    frequent = F.col("n") > F.col("total") * 0.05
    apps = _shares(counts, user, "app")
    typical = ordered.top_k(apps, [user], 10, F.desc("n"), F.asc("app")).groupBy(user).agg(
        F.array_compact(F.array_sort(F.collect_list(F.when(frequent, F.struct("rank", "app"))))["app"]).alias("typical_apps")
    )
    known = F.array(*[F.lit(a) for a in common_apps])
    never = apps.groupBy(user).agg(
        F.array_except(known, F.collect_set(F.when(F.col("app").isin(*common_apps), F.col("app")))).alias("never_accessed")
    )
    places = _shares(counts, user, "place", df.schema[location].dataType.simpleString())
    top_places = ordered.top_k(places, [user], 3, F.desc("n"), F.asc("place")).groupBy(user).agg(
        F.array_sort(F.collect_list(F.struct("rank", "place")))["place"].alias("typical_locations")
    )
    variety = F.count("place")
    pattern = places.groupBy(user).agg(
        F.when(variety == 1, "stationary").when(variety <= 3, "occasional").otherwise("frequent").alias("travel_pattern")
    )
    hours = _shares(counts, user, "hour", "int").groupBy(user).agg(
        F.coalesce(F.min(F.when(frequent, F.col("hour"))), F.lit(9)).alias("work_start"),
        F.coalesce(F.max(F.when(frequent, F.col("hour"))), F.lit(17)).alias("work_end"),
    )
    days = _shares(counts, user, "day", "int").groupBy(user).agg(
        F.sort_array(F.collect_list(F.when(frequent, F.col("day")))).alias("work_days")
    )
    daily = durable(
        shaped.groupBy(user, "date").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("app").alias("apps"))
    )
    ranges = quantiles(daily, [user], "events", {"p10": 0.1, "p90": 0.9}).select(
        user, F.col("p10").cast("int").alias("activity_min"), F.col("p90").cast("int").alias("activity_max")
    )
    per_day = quantiles(daily, [user], "apps", {"m": 0.5}).select(user, F.col("m").cast("int").alias("apps_per_day"))
    out = typical
    for part in (never, top_places, pattern, hours, days, ranges, per_day):
        out = out.join(part, user)
    return out


def score_baseline(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """mean, population deviation, p50/p95/p99, min, max, n."""
    moments = df.groupBy(*keys).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"),
        F.max(score).alias("max"), F.count(score).alias("n"),
    )
    points = quantiles(df, keys, score, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    if keys:
        return moments.join(points, list(keys))
    from tidemark.operators.dashboards import one_row

    return one_row(moments, points)


def distribution(df: DataFrame, score: str, base: DataFrame) -> DataFrame:
    """Counts above p95, p99 and 3 deviations; bias-corrected skewness and kurtosis."""
    row = base.first()
    n = F.count(score).cast("double")
    s = F.col(score)
    z = F.when(F.lit(row["std"]) == 0, 0.0).otherwise((s - F.lit(row["mean"])) / F.lit(row["std"]))
    g1, g2 = F.skewness(score), F.kurtosis(score)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    hits = {"p95": s > F.lit(row["p95"]), "p99": s > F.lit(row["p99"]), "3std": F.abs(z) > 3.0}
    return df.agg(
        F.count(score).alias("total_samples"),
        *[F.count_if(c).alias(f"above_{k}_count") for k, c in hits.items()],
        *[(F.count_if(c) * 100.0 / n).alias(f"above_{k}_pct") for k, c in hits.items()],
        F.coalesce(skew, F.lit(0.0)).alias("skewness"),
        F.coalesce(kurt, F.lit(0.0)).alias("kurtosis"),
    )


def threshold_study(df: DataFrame, score: str, base: DataFrame, points: Mapping[str, float]) -> DataFrame:
    """Per candidate threshold (mean + k sigma, percentiles): its value, hits and hit percentage."""
    row = base.first()
    limits = {f"mean_{k}sigma": row["mean"] + k * row["std"] for k in (1, 2, 3)}
    cuts = quantiles(df, [], score, points).first().asDict()
    limits.update(cuts)
    total = F.count(F.lit(1))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"), F.lit(float(v)).alias("threshold"),
                F.count_if(F.col(score) > F.lit(float(v))).alias("hits"),
                (F.count_if(F.col(score) > F.lit(float(v))) * 100.0 / total).alias("pct"),
            )
            for name, v in limits.items()
        ]
    )
    return df.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def quality_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) for row-level rules, all counted in one pass; a rule is true on a violation."""
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.count_if(c).alias("violations")) for n, c in rules.items()])
    return df.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


def many_values(df: DataFrame, key: str, value: str, rule: str) -> DataFrame:
    """How many keys map to several values (a name with many ids, a device with several systems)."""
    distinct = df.select(key, value).filter(F.col(value).isNotNull()).distinct()
    counts = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.lit(rule).alias("rule"), F.count_if(F.col("n") > 1).alias("violations"))


def duplicates(df: DataFrame, key: str, rule: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.lit(rule).alias("rule"), F.count_if(F.col("n") > 1).alias("violations"))


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle of the Pearson matrix as (a, b, corr), in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]
    )
    return df.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")
