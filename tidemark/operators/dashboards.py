"""Analytical questions over stored detections.

``anomalies`` carries anomaly_id, user_id, ts, anomaly_score, severity, root_cause, sub_category,
risk_score, status, is_anomaly. ``as_of`` replaces the wall clock, so results are reproducible.
All aggregates are partial-combinable: a user or cause that owns a third of the rows costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.quantiles import quantiles

LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def severity_counts(suffix: str = "_count") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s.lower() + suffix) for s in LEVELS]


def since(df: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts) >= as_of - F.expr(f"interval {days} days")) if days else df


def mean(name: str, digits: int) -> Column:
    return F.round(F.coalesce(F.avg(name), F.lit(0.0)), digits)


def one_row(*parts: DataFrame) -> DataFrame:
    """Single-row aggregates side by side, by union and one final max: no cross join."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def kpi_row(anomalies: DataFrame, users: DataFrame, events: DataFrame) -> DataFrame:
    detected = anomalies.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.count_distinct("user_id").alias("active_users"),
        *severity_counts("_anomalies"),
        mean("anomaly_score", 4).alias("avg_anomaly_score"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_anomalies") for s in ("new", "resolved", "pending")],
    )
    joined = one_row(
        detected,
        users.agg(F.count(F.lit(1)).alias("total_users")),
        events.agg(F.count(F.lit(1)).alias("total_events")),
    )
    return joined.withColumn("total_events", F.col("total_events") + F.col("total_anomalies"))


def risk_distribution(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def top_users(users: DataFrame, anomalies: DataFrame, user_key: str, k: int = 10) -> DataFrame:
    """Users with most anomalies, each with its ``k`` highest-scored ones (array of structs)."""
    totals = anomalies.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        F.max("ts").alias("last_anomaly_at"),
        mean("anomaly_score", 4).alias("avg_anomaly_score"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
    )
    ranked_users = (
        users.join(totals, users[user_key] == totals["user_id"])
        .orderBy(F.desc("anomaly_count"), "user_id")
        .limit(k)
    )
    mine = anomalies.join(F.broadcast(ranked_users.select("user_id")), "user_id", "left_semi")
    best = ordered.top_k(mine, ["user_id"], k, F.desc("anomaly_score"), F.asc("anomaly_id"))
    listed = best.groupBy("user_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "anomaly_id", "anomaly_score", F.lower("severity").alias("severity")))
        ).alias("top_anomalies")
    )
    return ranked_users.join(listed, "user_id", "left")


def user_metrics(anomalies: DataFrame, users: DataFrame) -> DataFrame:
    """Exposure, critical and resolution rates, mean score and mean hours between anomalies."""
    gaps = time_between(anomalies).agg(F.round(F.coalesce(F.avg("hours_between"), F.lit(0.0)), 2).alias("mtba_hours"))
    totals = anomalies.agg(
        F.count_distinct("user_id").alias("affected"),
        F.count_distinct(F.when(F.col("severity") == "CRITICAL", F.col("user_id"))).alias("critical_users"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count(F.lit(1)).alias("total"),
        mean("anomaly_score", 4).alias("avg_risk_score"),
    )
    row = one_row(totals, users.agg(F.count(F.lit(1)).alias("users")), gaps)

    def pct(a: str, b: str) -> Column:
        return F.coalesce(F.round(F.try_divide(F.col(a) * 100.0, F.col(b)), 1), F.lit(0.0))

    return row.select(
        pct("affected", "users").alias("exposure_rate"),
        pct("critical_users", "users").alias("critical_ratio"),
        "avg_risk_score",
        pct("resolved", "total").alias("resolution_rate"),
        "mtba_hours",
    )


def time_between(anomalies: DataFrame) -> DataFrame:
    rows = ordered.framed(
        anomalies.select("user_id", "ts", "anomaly_id"), ["user_id"], ["ts", "anomaly_id"], 1, 0,
        lambda w: {"_prev": F.lag("ts").over(w)},
    )
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_prev").cast("timestamp"))) / 1e6
    return rows.withColumn("hours_between", seconds / 3600.0).drop("_prev")


def heatmap_daily(anomalies: DataFrame, as_of: Column, days: int = 119) -> DataFrame:
    return since(anomalies, as_of, days).groupBy(F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.max("anomaly_score"), 2).alias("max_score"),
        F.count_if(F.col("status") == "resolved").alias("confirmed_count"),
        F.count_if(F.col("verdict") == "false_positive").alias("false_positive_count"),
        F.count_if(F.col("status") == "new").alias("new_count"),
    )


def root_cause_ranking(anomalies: DataFrame, k: int = 5) -> DataFrame:
    return (
        anomalies.filter("root_cause is not null")
        .groupBy("root_cause")
        .agg(
            F.count(F.lit(1)).alias("anomaly_count"),
            F.count_distinct("user_id").alias("affected_users"),
            F.round(F.avg("anomaly_score"), 4).alias("avg_anomaly_score"),
            mean("risk_score", 4).alias("avg_risk_score"),
            *severity_counts(),
            F.max("ts").alias("last_seen_at"),
        )
        .orderBy(F.desc("anomaly_count"), "root_cause")
        .limit(k)
    )


def maturity(anomalies: DataFrame) -> DataFrame:
    status, sev = F.lower("status"), F.upper("severity")
    counts = anomalies.agg(
        F.count_if(status == "resolved").alias("resilient"),
        F.count_if((status == "pending") | ((status == "new") & sev.isin("LOW", "MEDIUM"))).alias("managed"),
        F.count_if((status == "new") & sev.isin("HIGH", "CRITICAL")).alias("exposed"),
        F.count(F.lit(1)).alias("total"),
    )
    score = F.coalesce(
        F.round(
            F.try_divide(
                F.col("resilient") * 100.0 + F.col("managed") * 65 + F.col("exposed") * 20, F.col("total")
            ), 1,
        ),
        F.lit(0.0),
    )
    level = (
        F.when(F.col("score") >= 80, "Resilient")
        .when(F.col("score") >= 55, "Managed")
        .when(F.col("score") >= 30, "Developing")
        .otherwise("Exposed")
    )
    shares = {
        f"{n}_pct": F.coalesce(F.round(F.try_divide(F.col(n) * 100.0, F.col("total")), 1), F.lit(0.0))
        for n in ("resilient", "managed", "exposed")
    }
    return counts.withColumn("score", score).withColumn("level", level).withColumns(shares)


def week_trend(anomalies: DataFrame, as_of: Column) -> DataFrame:
    """Per severity: last 7 days against the 7 before; 100 when only the last week has rows."""
    recent = F.col("ts") >= as_of - F.expr("interval 7 days")
    counts = since(anomalies, as_of, 14).groupBy(F.lower("severity").alias("severity")).agg(
        F.count_if(recent).alias("current"), F.count_if(~recent).alias("previous")
    )
    change = F.round(F.try_divide((F.col("current") - F.col("previous")) * 100.0, F.col("previous")), 1)
    delta = F.when(F.col("previous") == 0, F.when(F.col("current") > 0, 100.0).otherwise(0.0)).otherwise(change)
    return counts.withColumn("delta_pct", delta)


def completion_trend(investigations: DataFrame) -> DataFrame:
    hours = (
        F.unix_micros(F.col("completed_at").cast("timestamp"))
        - F.unix_micros(F.col("triggered_at").cast("timestamp"))
    ) / 3.6e9
    done = F.count_if(F.col("status") == "complete")
    return investigations.groupBy(F.to_date("triggered_at").alias("day")).agg(
        F.count(F.lit(1)).alias("triggered"),
        done.alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.round(F.try_divide(done * 100.0, F.count(F.lit(1))), 1).alias("completion_rate"),
        F.round(F.avg("confidence_score"), 3).alias("avg_confidence"),
        F.round(F.avg(hours), 4).alias("avg_duration_hours"),
    )


def rhythm(anomalies: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return since(anomalies, as_of, days).groupBy(
        F.weekday("ts").alias("dow"), F.hour("ts").alias("hour")
    ).agg(F.count(F.lit(1)).alias("total_count"), F.round(F.avg("anomaly_score"), 2).alias("avg_score"))


def platform_counts(users: DataFrame, anomalies: DataFrame, investigations: DataFrame, findings: DataFrame) -> DataFrame:
    return one_row(
        users.agg(F.count(F.lit(1)).alias("monitored_users")),
        anomalies.agg(
            F.count(F.lit(1)).alias("total_detections"),
            F.count_if(F.col("is_anomaly")).alias("true_positives"),
            F.count("is_anomaly").alias("labeled_records"),
            F.count_distinct("root_cause").alias("root_cause_count"),
            F.count_distinct(F.when(F.col("is_anomaly"), F.col("user_id"))).alias("users_with_anomalies"),
        ),
        investigations.agg(
            F.count(F.lit(1)).alias("total_investigations"),
            F.count_if(F.col("status") == "complete").alias("completed_investigations"),
        ),
        findings.agg(F.count(F.lit(1)).alias("total_findings")),
    )


def user_trend(anomalies: DataFrame, as_of: Column, days: int = 0) -> DataFrame:
    return since(anomalies, as_of, days).groupBy("user_id", F.to_date("ts").alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("anomaly_score"), 2).alias("avg_score")
    )


def facets(anomalies: DataFrame, names: Sequence[str], filters: Mapping[str, Column]) -> DataFrame:
    """Value counts of each facet under the filters of the *other* facets, in one pass."""
    rows = []
    for name in names:
        keep = F.col(name).isNotNull()
        for other, condition in filters.items():
            if other != name:
                keep = keep & condition
        rows.append(F.when(keep, F.struct(F.lit(name).alias("facet"), F.col(name).alias("value"))))
    exploded = anomalies.select(F.explode(F.array_compact(F.array(*rows))).alias("f"))
    return exploded.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def timeline(anomalies: DataFrame, as_of: Column, days: int, granularity: str = "day", k: int = 60) -> DataFrame:
    return (
        since(anomalies, as_of, days)
        .groupBy(F.to_date(F.date_trunc(granularity, "ts")).alias("period"))
        .agg(
            F.count(F.lit(1)).alias("anomaly_count"),
            F.round(F.avg("risk_score"), 2).alias("avg_risk_score"),
            F.round(F.max("risk_score"), 2).alias("max_risk_score"),
            *severity_counts(),
            F.count_distinct("user_id").alias("unique_users_affected"),
        )
        .orderBy(F.desc("period"))
        .limit(k)
    )


def timeline_direction(periods: DataFrame) -> DataFrame:
    """increasing / decreasing / stable: newer half of the periods against the older half (at most 60 rows)."""
    ranked = ordered.top_k(periods, [], 60, F.desc("period"))
    ranked = ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    half = F.floor(F.col("n") / 2)
    sums = ranked.agg(
        F.max("n").alias("n"),
        F.sum(F.when(F.col("rank") <= half, F.col("anomaly_count"))).alias("newer"),
        F.sum(F.when(F.col("rank") > half, F.col("anomaly_count"))).alias("older"),
    )
    newer = F.try_divide(F.col("newer"), F.floor(F.col("n") / 2))
    older = F.try_divide(F.col("older"), F.col("n") - F.floor(F.col("n") / 2))
    return sums.select(
        F.when(F.col("n") < 4, "stable")
        .when(newer > older * 1.2, "increasing")
        .when(newer < older * 0.8, "decreasing")
        .otherwise("stable")
        .alias("trend")
    )


def dimension_column(name: str) -> Column:
    """Column of a ranking dimension, over plain columns or the JSON texts event and raw."""
    dims = {
        "city": F.get_json_object("event", "$.location.city"),
        "country": F.get_json_object("event", "$.location.countryOrRegion"),
        "location": F.concat(
            F.coalesce(F.get_json_object("event", "$.location.city"), F.lit("")),
            F.lit(", "),
            F.coalesce(F.get_json_object("event", "$.location.countryOrRegion"), F.lit("")),
        ),
        "ip": F.get_json_object("event", "$.callerIpAddress"),
        "ip_address": F.get_json_object("event", "$.callerIpAddress"),
        "user": F.col("user_id").cast("string"),
        "username": F.col("user_id").cast("string"),
        "severity": F.col("severity"),
        "root_cause": F.col("root_cause"),
        "sub_category": F.col("sub_category"),
        "status": F.col("status"),
        "app": F.coalesce(
            F.nullif(F.get_json_object("event", "$.properties.appDisplayName"), F.lit("")),
            F.get_json_object("raw", "$.app"),
        ),
        "device": F.coalesce(
            F.nullif(F.get_json_object("raw", "$.device"), F.lit("")),
            F.get_json_object("event", "$.properties.deviceDetail.displayName"),
        ),
        "browser": F.coalesce(F.nullif(F.get_json_object("raw", "$.browser"), F.lit("")), F.lit("")),
        "os": F.coalesce(
            F.nullif(F.get_json_object("raw", "$.os"), F.lit("")),
            F.get_json_object("event", "$.properties.deviceDetail.operatingSystem"),
        ),
    }
    key = name.lower().strip()
    if key not in dims:
        raise ValueError(f"unknown dimension {name}; supported: {sorted(dims)}")
    return dims[key]


def dimension_ranking(anomalies: DataFrame, dimension: str, k: int = 10) -> DataFrame:
    """Groups ranked by highest risk, then count; ``affected_users`` only for the groups shown."""
    rows = anomalies.withColumn("dimension_value", dimension_column(dimension)).filter(
        F.trim("dimension_value") != ""
    )
    ranked = (
        rows.groupBy("dimension_value")
        .agg(
            F.count(F.lit(1)).alias("anomaly_count"),
            F.round(F.max("risk_score"), 2).alias("max_risk_score"),
            F.round(F.avg("risk_score"), 2).alias("avg_risk_score"),
            *severity_counts(),
        )
        .orderBy(F.col("max_risk_score").desc_nulls_last(), F.desc("anomaly_count"), "dimension_value")
        .limit(k)
    )
    people = (
        rows.join(F.broadcast(ranked.select("dimension_value")), "dimension_value", "left_semi")
        .filter("user_id is not null")
        .select("dimension_value", "user_id")
        .distinct()
        .groupBy("dimension_value")
        .agg(F.sort_array(F.collect_list("user_id")).alias("affected_users"))
    )
    return ranked.join(people, "dimension_value", "left")


def risk_summary(anomalies: DataFrame, as_of: Column, days: int = 0) -> DataFrame:
    """Totals, per user and per day in one grouping-sets pass; ``scope`` tells them apart."""
    rows = since(anomalies, as_of, days).withColumn("day", F.to_date("ts"))
    sets = rows.groupingSets([[], ["user_id"], ["day"]], "user_id", "day").agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("anomaly_count"),
        *severity_counts(),
        F.round(F.avg("risk_score"), 2).alias("avg_risk_score"),
        F.round(F.max("risk_score"), 2).alias("max_risk_score"),
    )
    scope = F.when(F.col("_gid") == 3, "total").when(F.col("_gid") == 1, "user").otherwise("day")
    return sets.withColumn("scope", scope).drop("_gid")


def cause_summary(anomalies: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    rows = since(anomalies, as_of, days)
    kinds = rows.select(
        F.explode(
            F.array(
                F.struct(F.lit("root_cause").alias("kind"), F.col("root_cause").alias("name")),
                F.struct(F.lit("sub_category").alias("kind"), F.col("sub_category").alias("name")),
            )
        ).alias("d"),
        "risk_score",
    ).filter("d.name is not null")
    return kinds.groupBy("d.kind", "d.name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("risk_score"), 2).alias("avg_risk_score")
    )


def score_stats(anomalies: DataFrame) -> DataFrame:
    moments = anomalies.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("anomaly_score"), 4).alias("mean_score"),
        F.round(F.stddev("anomaly_score"), 4).alias("std_score"),
        F.round(F.min("anomaly_score"), 4).alias("min_score"),
        F.round(F.max("anomaly_score"), 4).alias("max_score"),
    )
    median = quantiles(anomalies, [], "anomaly_score", {"median_score": 0.5})
    return one_row(moments, median.select(F.round("median_score", 4).alias("median_score")))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count(c).alias(f"with_{c}") for c in columns]
    )


def rollup(df: DataFrame, keys: Sequence[str], width: str, value: str, ts: str = "ts") -> DataFrame:
    """Tumbling-window aggregate, the batch form of a continuous aggregate."""
    return (
        df.groupBy(F.window(ts, width).alias("_w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(value), 4).alias("avg_value"),
            F.round(F.max(value), 4).alias("max_value"),
        )
        .select(F.col("_w.start").alias("bucket"), *keys, "n", "avg_value", "max_value")
    )


def recent_alert(anomalies: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Critical/high counts, users touched and the modal root cause of the last days."""
    rows = since(anomalies, as_of, days)
    totals = rows.agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count_distinct("user_id").alias("users"),
    )
    modal = (
        rows.groupBy("root_cause").agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.max_by("root_cause", F.struct("_n", "root_cause")).alias("top_root_cause"))
    )
    return one_row(totals, modal)


def keyword_search(df: DataFrame, columns: Sequence[str], words: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Rows whose columns contain any word; the top rows by ``order`` when nothing matches."""
    hit = F.lit(False)
    for c in columns:
        for w in words:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(w.lower()), F.lit(False))
    found = df.filter(hit).orderBy(*order).limit(k).withColumn("search_type", F.lit("keyword"))
    if df.filter(hit).limit(1).count():
        return found
    return df.orderBy(*order).limit(k).withColumn("search_type", F.lit("top_risk"))


def anomaly_predicate(
    severity: str | None = None, user: str | None = None, root_cause: str | None = None,
    days: int | None = None, as_of: Column | None = None, min_risk: float | None = None,
) -> Column:
    """Conjunction of the filters that were given."""
    out = F.lit(True)
    if severity:
        out = out & (F.upper("severity") == severity.upper())
    if user:
        out = out & F.col("user_id").cast("string").ilike(f"%{user}%")
    if root_cause:
        out = out & F.col("root_cause").ilike(f"%{root_cause}%")
    if days and as_of is not None:
        out = out & (F.col("ts") >= as_of - F.expr(f"interval {days} days"))
    if min_risk is not None:
        out = out & (F.col("risk_score") >= min_risk)
    return out


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered list, with ``total_items`` on every row."""
    shown = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return shown.withColumn("total_items", F.lit(df.count()))
