"""Severity, risk and confidence rules over detections, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base risk of an anomaly sub-category.
SUB_CATEGORY_RISK = {
    "Impossible Travel": 0.90,
    "Location with Unusual Device": 0.80,
    "Unknown Device": 0.75,
    "Multi-Factor Anomaly": 0.70,
    "Unusual Location": 0.65,
    "Unusual Application": 0.55,
    "Unusual Operating System": 0.50,
    "Unusual Browser": 0.45,
    "Broad Deviation": 0.40,
}
# Risk multiplier of a severity.
SEVERITY_RISK = {"CRITICAL": 1.0, "HIGH": 0.80, "MEDIUM": 0.55, "LOW": 0.30}
# Country name fragments counted as high risk.
HIGH_RISK_COUNTRIES = [
    "Russia", "China", "North Korea", "Iran", "Belarus", "RU", "CN", "KP", "IR", "BY",
]
# Sub-category to root cause.
ROOT_CAUSE_OF = {
    "Impossible Travel": "Geographic Anomaly",
    "Multi-Factor Anomaly": "Multi-Factor Incident",
    "Location with Unusual Device": "Geographic Anomaly",
    "Unknown Device": "Unmanaged Device",
    "Unusual Application": "Unauthorized Application Access",
    "Unusual Location": "Geographic Anomaly",
    "Unusual Browser": "Browser Anomaly",
    "Unusual Operating System": "OS Anomaly",
    "Broad Deviation": "Behavioral Anomaly",
}


def lookup(column: Column, values: Mapping[str, object], default: object = None) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[column], F.lit(default))


def severity(score: Column) -> Column:
    return (
        F.when(score > 5, "CRITICAL")
        .when(score >= 3, "HIGH")
        .when(score >= 2.5, "MEDIUM")
        .when(score > 2, "LOW")
        .otherwise("NONE")
    )


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 80, "critical")
        .when(score >= 60, "high")
        .when(score >= 40, "medium")
        .when(score >= 20, "low")
        .otherwise("minimal")
    )


def compress_score(score: Column) -> Column:
    """Identity below 8, then logarithmic growth that never passes 15.99."""
    s = F.greatest(score, F.lit(0.0))
    squeezed = F.least(8 + 8 * F.log10(1 + s) / 15, F.lit(15.99))
    return F.round(F.when(s < 8, s).otherwise(squeezed), 4)


def root_cause(top_features: Column) -> Column:
    """Struct(root_cause, sub_category) by the first matching rule over the feature text."""
    f = F.lower(F.coalesce(top_features, F.lit("")))
    app = f.contains("appdisplayname")
    device = f.contains("devicedetail")
    place = f.contains("locationcity") | f.contains("locationcountry")
    stranger = f.contains("unknown-laptop") | (
        f.contains("devicedetaildisplayname") & f.contains("unknown")
    )

    def verdict(cause: str, sub: str) -> Column:
        return F.struct(F.lit(cause).alias("root_cause"), F.lit(sub).alias("sub_category"))

    return (
        F.when(f.contains("travel_speed_kmph"), verdict("Geographic Anomaly", "Impossible Travel"))
        .when(app & (device | place), verdict("Account Takeover", "Multi-Factor Anomaly"))
        .when(device & place, verdict("Geographic Anomaly", "Location with Unusual Device"))
        .when(stranger, verdict("Unmanaged Device", "Unknown Device"))
        .when(app, verdict("Unauthorized Application Access", "Unusual Application"))
        .when(place, verdict("Geographic Anomaly", "Unusual Location"))
        .when(f.contains("devicedetailbrowser"), verdict("Browser Anomaly", "Unusual Browser"))
        .when(f.contains("devicedetailoperatingsystem"), verdict("OS Anomaly", "Unusual Operating System"))
        .otherwise(verdict("Account Takeover", "Broad Deviation"))
    )


def threshold_label(score: Column, split: float = 2.5) -> Column:
    return F.when(score >= split, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE")


def label_confidence(score: Column, band: tuple[float, float] | None = None) -> Column:
    """0.90 for plain threshold labels, 0.65 for rows labelled in the middle-band pass."""
    if band is None:
        return F.lit(0.90)
    return F.when((score >= band[0]) & (score < band[1]), 0.65).otherwise(0.90)


def root_cause_of(sub_category: Column, default: str | None = None) -> Column:
    return lookup(sub_category, ROOT_CAUSE_OF, default)


def risk_features(
    event: Column, enrichment: Column, raw: Column, score: Column, mean_abs_z: Column,
    sub_category: Column, severity_name: Column, classification_confidence: Column,
    validation_confidence: Column,
) -> dict[str, Column]:
    """The numeric risk features of a stored detection; the first three arguments are JSON text."""

    def text(source: Column, path: str) -> Column:
        return F.coalesce(F.get_json_object(source, path), F.lit(""))

    def number(source: Column, path: str, default: float = 0.0) -> Column:
        value = F.get_json_object(source, path).try_cast("double")
        return F.when(F.coalesce(value, F.lit(0.0)) == 0, default).otherwise(value)

    def length(source: Column, path: str) -> Column:
        items = F.json_array_length(F.get_json_object(source, path))
        return F.coalesce(items, F.lit(0)).cast("double")

    def flag(condition: Column) -> Column:
        return F.when(condition, 1.0).otherwise(0.0)

    trust = F.lower(text(event, "$.properties.deviceDetail.trustType"))
    system = F.lower(text(event, "$.properties.deviceDetail.operatingSystem"))
    country = text(event, "$.location.countryOrRegion")
    risky = F.lit(False)
    for fragment in HIGH_RISK_COUNTRIES:
        risky = risky | country.contains(fragment)
    base_score = F.coalesce(score, F.lit(0.0))
    z = F.coalesce(mean_abs_z, F.lit(0.0))
    return {
        "anomaly_score": base_score,
        "mean_abs_z": F.when(z == 0, base_score).otherwise(z),
        "feature_count": number(raw, "$.feature_count"),
        "event_count": number(raw, "$.event_count", 1.0),
        "sub_category_risk": lookup(sub_category, SUB_CATEGORY_RISK, 0.40),
        "severity_score": lookup(severity_name, SEVERITY_RISK, 0.30),
        "classification_confidence": F.coalesce(classification_confidence, F.lit(0.0)),
        "is_managed": flag(text(event, "$.properties.deviceDetail.isManaged") == "true"),
        "is_compliant": flag(text(event, "$.properties.deviceDetail.isCompliant") == "true"),
        "trust_score": F.when(trust.contains("hybrid") | trust.contains("azure ad joined"), 1.0)
        .when(trust.contains("registered"), 0.5)
        .otherwise(0.0),
        "os_risk": F.when(system.contains("android") | system.contains("ios"), 0.7)
        .when(system.contains("windows") | system.contains("macos"), 0.3)
        .otherwise(0.5),
        "is_high_risk_country": flag(risky),
        "is_foreign": flag(~country.isin("United States", "US", "")),
        "baseline_strength": F.least(
            number(enrichment, "$.user_baseline.total_events") / 1000.0, F.lit(1.0)
        ),
        "baseline_available": flag(text(enrichment, "$.user_baseline.baseline_source") != ""),
        "related_anomalies_count": number(enrichment, "$.graph_context.related_anomalies_count"),
        "graph_relationship_count": length(enrichment, "$.graph_context.detection_relationships"),
        "similar_count": length(enrichment, "$.similar_detections"),
        "cold_start": flag(text(enrichment, "$.cold_start") == "true"),
        "validation_confidence": F.coalesce(validation_confidence, F.lit(0.0)),
    }


def heuristic_risk(f: Mapping[str, Column]) -> Column:
    """0-100 risk score from the feature columns of :func:`risk_features`."""
    base = f["sub_category_risk"] * f["severity_score"]
    base = base * (0.5 + 0.5 * F.least(f["anomaly_score"] / 20.0, F.lit(1.0)))
    boost = (
        F.lit(1.0)
        + F.when(f["is_managed"] == 0, 0.20).otherwise(0.0)
        + F.when(f["is_compliant"] == 0, 0.15).otherwise(0.0)
        + F.when(f["is_high_risk_country"] == 1, 0.25).otherwise(0.0)
        + F.when(f["baseline_available"] == 0, 0.10).otherwise(0.0)
        + F.when(f["related_anomalies_count"] > 2, 0.15).otherwise(0.0)
        + F.when(f["cold_start"] == 1, 0.05).otherwise(0.0)
    )
    return F.greatest(F.least(base * boost * 100.0, F.lit(100.0)), F.lit(0.0))


def _present(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def risk_drivers(f: Mapping[str, Column]) -> Column:
    return _present(
        F.when(f["is_high_risk_country"] > 0.5, "High-risk country"),
        F.when(f["is_managed"] < 0.5, "Unmanaged device"),
        F.when(f["is_compliant"] < 0.5, "Non-compliant device"),
        F.when(f["anomaly_score"] > 5, F.format_string("High anomaly score (%.1f)", f["anomaly_score"])),
        F.when(
            f["related_anomalies_count"] > 2,
            F.format_string("Repeated anomalies (%d prior)", f["related_anomalies_count"].cast("int")),
        ),
        F.when(f["sub_category_risk"] >= 0.75, "High-risk anomaly category"),
    )


def risk_mitigators(f: Mapping[str, Column]) -> Column:
    share = F.format_string("High validation confidence (%.0f%%)", f["validation_confidence"] * 100)
    return _present(
        F.when(f["is_managed"] > 0.5, "Managed device"),
        F.when(f["is_compliant"] > 0.5, "Compliant device"),
        F.when(f["baseline_available"] > 0.5, "Established user baseline"),
        F.when(f["validation_confidence"] > 0.8, share),
    )


def confidence_blend(risk_score: Column, deviation: Column, model_confidence: Column) -> Column:
    """Struct(confidence, risk, deviation, model): 0.40/0.35/0.25; a missing model share goes to risk."""

    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    absent = model_confidence.isNull()
    risk = F.round(F.when(absent, 0.65).otherwise(0.40) * unit(risk_score / 100.0), 4)
    dev = F.round(0.35 * unit(deviation / 8.0), 4)
    model = F.round(F.when(absent, 0.0).otherwise(0.25 * unit(model_confidence)), 4)
    total = F.round(F.least(F.lit(1.0), risk + dev + model), 4)
    return F.struct(
        total.alias("confidence"), risk.alias("risk"), dev.alias("deviation"), model.alias("model")
    )


# Weight of each voter and the decision threshold.
VOTE_WEIGHTS = {"llm": 0.50, "similarity": 0.30, "graph": 0.20}
VOTE_THRESHOLD = 0.65


def ensemble_vote(votes: Mapping[str, tuple[Column, Column]]) -> Column:
    """Combine (vote, confidence) pairs; zero confidence abstains. ``is_anomaly`` null means uncertain."""
    weighted, active, voters = F.lit(0.0), F.lit(0.0), F.lit(0)
    for name, weight in VOTE_WEIGHTS.items():
        vote, confidence = votes.get(name, (F.lit(False), F.lit(0.0)))
        confidence = F.coalesce(confidence, F.lit(0.0))
        weighted = weighted + F.when(vote, confidence * weight).otherwise(0.0)
        active = active + F.when(confidence > 0, weight).otherwise(0.0)
        voters = voters + F.when(confidence > 0, 1).otherwise(0)
    score = F.when(active > 0, F.try_divide(weighted, active)).otherwise(0.0)
    confidence = F.least(F.abs(score - VOTE_THRESHOLD) * 2, F.lit(1.0))
    hit = score >= VOTE_THRESHOLD
    unsure = hit & (confidence < 0.35) & (voters <= 1)
    return F.struct(
        F.when(~unsure, hit).alias("is_anomaly"),
        confidence.alias("confidence"),
        score.alias("score"),
        unsure.alias("human_review_recommended"),
        voters.alias("active_methods"),
    )


def graph_vote(related: Column) -> tuple[Column, Column]:
    return related > 0, F.when(related > 0, F.least(related / (related + 5.0), F.lit(0.75))).otherwise(0.0)


def similarity_vote(
    true_count: Column, false_count: Column, score: Column, mean_true_score: Column
) -> tuple[Column, Column]:
    """Majority among labelled similar cases; a true verdict is scaled down by the score ratio."""
    total = true_count + false_count
    vote = F.when(total == 0, False).otherwise(false_count <= true_count)
    share = F.when(total == 0, 0.0).otherwise(
        F.try_divide(F.greatest(true_count, false_count), total)
    )
    scaled = F.round(share * F.least(F.try_divide(score, mean_true_score), F.lit(1.0)), 2)
    use_scaled = vote & (score > 0) & (mean_true_score > 0)
    return vote, F.when(F.coalesce(use_scaled, F.lit(False)), scaled).otherwise(share)


def baseline_strength(events: Column) -> Column:
    return F.when(events > 1000, "strong").when(events > 500, "moderate").otherwise("weak")
