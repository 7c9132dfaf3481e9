"""Kafka JSON topics as streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kafka_options(
    bootstrap: str, topics: str | Sequence[str], group: str | None = None, starting: str = "latest",
    per_trigger: int | None = None, extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    names = topics if isinstance(topics, str) else ",".join(topics)
    options = {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": names,
        "startingOffsets": starting,
        "failOnDataLoss": "false",
    }
    if group:
        options["kafka.group.id"] = group
    if per_trigger:
        options["maxOffsetsPerTrigger"] = str(per_trigger)
    return {**options, **(extra or {})}


def parse_json_values(raw: DataFrame, schema: str, corrupt: str = "_corrupt_record") -> DataFrame:
    """Columns of the JSON in ``value``; records that do not parse keep their text in ``corrupt``."""
    text = F.col("value").cast("string")
    parsed = raw.withColumn(
        "_j", F.from_json(text, f"{schema}, {corrupt} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    )
    kept = [c for c in ("topic", "partition", "offset", "timestamp") if c in raw.columns]
    return parsed.select(*[F.col(c).alias(f"kafka_{c}") for c in kept], "_j.*")


def read_topics(spark: SparkSession, schema: str | T.StructType, options: Mapping[str, str], stop_after: bool = False) -> DataFrame:
    """Stream of parsed records; ``stop_after`` reads what is there now as a batch instead."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    reader = spark.read if stop_after else spark.readStream
    if stop_after:
        options = {k: v for k, v in options.items() if k != "maxOffsetsPerTrigger"}
        if options.get("startingOffsets") == "latest":
            options["startingOffsets"] = "earliest"
    return parse_json_values(reader.format("kafka").options(**options).load(), ddl)


def kafka_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, value) rows for the Kafka sink, one JSON record per row."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)
