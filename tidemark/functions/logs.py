"""Raw security-log parsing by per-event regular expressions (supplied by the caller)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_windows_event(raw: Column) -> Column:
    text = F.lower(raw)
    for old, new in ((r"\t", ""), (r"\r", ""), (r"\n", "|")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def extract_all(text: Column, patterns: Mapping[str, str]) -> dict[str, Column]:
    return {name: F.regexp_extract(text, p, 1) for name, p in patterns.items()}


def parse_windows_events(df: DataFrame, raw: str, regexes: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """``regexes`` maps event code to {column: pattern}. Rows without a listed code are dropped."""
    columns = sorted({c for spec in regexes.values() for c in spec})
    text = df.withColumn("_text", clean_windows_event(F.col(raw)))
    codes = F.array_compact(
        F.array(*[F.when(F.col("_text").contains(f"eventcode={code}"), F.lit(str(code))) for code in regexes])
    )
    rows = text.withColumn("_code", F.explode(codes))
    parsed = {}
    for column in columns:
        value = F.lit("")
        for code, spec in regexes.items():
            if column in spec:
                value = F.when(
                    F.col("_code") == str(code), F.regexp_extract("_text", spec[column], 1)
                ).otherwise(value)
        parsed[column] = value
    return rows.select(*df.columns, *[c.alias(n) for n, c in parsed.items()])


def parse_notables(df: DataFrame, raw: str, patterns: Mapping[str, str]) -> DataFrame:
    """Splunk-style notables; ``src_ip``/``dest_ip`` fall back to their second pattern when empty."""
    fields = extract_all(F.replace(F.col(raw), F.lit("\\"), F.lit("")), patterns)
    for ip in ("src_ip", "dest_ip"):
        second = fields.pop(f"{ip}2", None)
        if second is not None and ip in fields:
            fields[ip] = F.when(fields[ip] != "", fields[ip]).otherwise(second)
    return df.select(*df.columns, *[c.alias(n) for n, c in fields.items()])


# Fields of an entity taken from a sign-in event, and the entity type each becomes.
EVENT_ENTITIES = [
    ("APPLICATION", "$.properties.appDisplayName", "app"),
    ("DEVICE", "$.properties.deviceDetail.displayName", "device"),
    ("BROWSER", "$.properties.deviceDetail.browser", "device"),
    ("OS", "$.properties.deviceDetail.operatingSystem", "device"),
    ("IP_ADDRESS", "$.properties.ipAddress", "ip"),
    ("CLIENT_APP", "$.properties.clientAppUsed", "network"),
]


def event_entities(event: Column, severity: Column) -> Column:
    """Array of typed entities (type, text, confidence, category) found in a sign-in event."""

    def entity(kind: str | Column, text: Column, confidence: Column, category: str) -> Column:
        present = text.isNotNull() & (text != "")
        return F.when(
            present,
            F.struct(
                F.lit(kind).alias("type"),
                text.alias("text"),
                confidence.alias("confidence"),
                F.lit(category).alias("category"),
            ),
        )

    city = F.nullif(F.get_json_object(event, "$.location.city"), F.lit(""))
    country = F.nullif(F.get_json_object(event, "$.location.countryOrRegion"), F.lit(""))
    both = city.isNotNull() & country.isNotNull()
    confidence = F.when(both, 1.0).when(city.isNotNull(), 0.9).otherwise(0.8)
    found = [entity(k, F.get_json_object(event, p), F.lit(1.0), c) for k, p, c in EVENT_ENTITIES]
    found.insert(4, entity("LOCATION", F.nullif(F.concat_ws(", ", city, country), F.lit("")), confidence, "location"))
    found.append(entity("ANOMALY_SEVERITY", severity, F.lit(1.0), "anomaly"))
    return F.array_compact(F.array(*found))


def feature_category(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(n.contains("app"), "app")
        .when(n.contains("device") | n.contains("browser") | n.contains("operating"), "device")
        .when(n.contains("loc") | n.contains("travel"), "location")
        .when(n.contains("logcount"), "activity")
        .otherwise("other")
    )


def parse_top_features(text: Column) -> Column:
    """``name=value (z=1.2), ...`` to an array of (name, value, z_score, category)."""
    pattern = r"(\w+)=([^(]+)\s*\(z=([\d.]+)\)"
    matched = F.filter(F.split(text, ", "), lambda x: x.rlike(pattern))
    return F.transform(
        matched,
        lambda x: F.struct(
            F.regexp_extract(x, pattern, 1).alias("name"),
            F.trim(F.regexp_extract(x, pattern, 2)).alias("value"),
            F.regexp_extract(x, pattern, 3).try_cast("double").alias("z_score"),
            feature_category(F.regexp_extract(x, pattern, 1)).alias("category"),
        ),
    )


def detection_sentence(user: Column, ts: Column, severity: Column, score: Column, entities: Column) -> Column:
    """One English sentence per detection, the text that is embedded for similarity search."""

    def of(kind: str) -> Column:
        hits = F.filter(entities, lambda e: e["type"] == kind)
        return F.try_element_at(F.transform(hits, lambda e: e["text"]), F.lit(-1))

    device, browser, system = of("DEVICE"), of("BROWSER"), of("OS")
    source = (
        F.when(
            device.isNotNull() & browser.isNotNull() & system.isNotNull(),
            F.concat(F.lit("from "), browser, F.lit(" browser on "), device, F.lit(" device running "), system),
        )
        .when(
            device.isNotNull() & browser.isNotNull(),
            F.concat(F.lit("from "), browser, F.lit(" browser on "), device, F.lit(" device")),
        )
        .when(browser.isNotNull() & system.isNotNull(), F.concat(F.lit("from "), browser, F.lit(" browser on "), system))
        .when(browser.isNotNull(), F.concat(F.lit("from "), browser, F.lit(" browser")))
        .when(device.isNotNull(), F.concat(F.lit("from "), device, F.lit(" device")))
    )
    level = F.coalesce(of("ANOMALY_SEVERITY"), F.lower(severity))
    tail = (
        F.when(severity == "CRITICAL", F.format_string("(critical anomaly, score %.1f)", score))
        .when(severity == "HIGH", F.format_string("(highly unusual, score %.1f)", score))
        .when(severity.isin("MEDIUM", "LOW"), F.format_string("(unusual, score %.1f)", score))
    )
    return F.concat_ws(
        " ",
        F.concat(F.lit("User "), user.cast("string")),
        F.concat(F.lit("accessed "), of("APPLICATION"), F.lit(" application")),
        source,
        F.concat(F.lit("in "), of("LOCATION")),
        F.concat(F.lit("(IP: "), of("IP_ADDRESS"), F.lit(")")),
        F.concat(F.lit("using "), of("CLIENT_APP")),
        F.coalesce(F.date_format(ts, "'on' EEEE 'at' HH:'00'"), F.lit("on unknown time")),
        F.concat(F.lit("triggered "), level, F.lit(" severity anomaly")),
        tail,
    )


def cache_key(user: Column, ts: Column, features: Column, model: str = "default") -> Column:
    content = F.concat_ws("_", user.cast("string"), ts.cast("string"), features)
    return F.concat(F.lit(f"embedding:{model}:"), F.md5(content))
