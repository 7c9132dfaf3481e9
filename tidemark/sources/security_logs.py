"""Readers of security-log formats: cloud audit trails, sign-in logs, network logs, memory snapshots."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Zeek column types and the Spark type each is read as.
ZEEK_TYPES = {
    "bool": "boolean",
    "count": "bigint",
    "int": "bigint",
    "double": "double",
    "time": "double",
    "interval": "double",
    "string": "string",
    "pattern": "string",
    "port": "bigint",
    "addr": "string",
    "subnet": "string",
    "enum": "string",
    "function": "string",
    "event": "string",
    "hook": "string",
    "file": "string",
    "opaque": "string",
    "any": "string",
}


def flat_columns(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of the leaves of a nested schema."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += flat_columns(f.dataType, path + ".")
        else:
            out.append(path)
    return out


def flatten(df: DataFrame, sep: str = ".", strip: bool = False) -> DataFrame:
    """All nested fields as top-level columns, dots kept, replaced or stripped from the names."""
    columns = []
    for path in flat_columns(df.schema):
        quoted = ".".join(f"`{p}`" for p in path.split("."))
        columns.append(F.col(quoted).alias(path.replace(".", "") if strip else path.replace(".", sep)))
    return df.select(*columns)


def read_cloud_trail(spark: SparkSession, path: str | Sequence[str], record_schema: T.StructType | str, account: str = "userIdentity.accountId") -> DataFrame:
    """One row per record of ``{"Records": [...]}`` files, flattened; numeric accounts get ``Account-`` in front."""
    ddl = record_schema if isinstance(record_schema, str) else record_schema.simpleString()
    kind = ddl if ddl.startswith("struct<") else f"STRUCT<{ddl}>"
    raw = spark.read.schema(f"Records ARRAY<{kind}>").option("multiLine", "true").json(path)
    rows = flatten(raw.select(F.explode("Records").alias("r")).select("r.*"), strip=True)
    name = account.replace(".", "")
    if name in rows.columns:
        value = F.col(name).cast("string")
        rows = rows.withColumn(name, F.when(value.rlike(r"^\d+$"), F.concat(F.lit("Account-"), value)).otherwise(value))
    return rows


def read_sign_ins(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Sign-in events in JSON lines, ``properties`` and other structs flattened to columns without dots."""
    flat = flatten(spark.read.schema(schema).json(path), strip=True)
    return flat.toDF(*[re.sub(r"[_.{}:]", "", c) for c in flat.columns])


def read_auth_log(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Authentication events (user, access and auth device structs) in JSON lines, flattened with dots."""
    return flatten(spark.read.schema(schema).json(path))


def read_zeek(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Tab-separated logs whose ``#fields`` and ``#types`` lines name and type the columns of their file.

    Files may differ in their columns: each row is read by its own file's header, a column that a file lacks
    is null there, and a column typed differently in different files is an error, as is a file whose header is
    missing or repeated with other content. The driver sees the distinct headers only.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    header = lambda tag: F.collect_set(F.when(F.col("value").startswith(tag), F.col("value")))
    files = lines.groupBy("_file").agg(header("#fields").alias("f"), header("#types").alias("t"))
    bad = files.filter("size(f) <> 1 or size(t) <> 1").select("_file").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]} must have one #fields and one #types line")
    files = files.select("_file", F.concat_ws("\n", F.col("f")[0], F.col("t")[0]).alias("_header"))
    layouts = [r["_header"] for r in files.select("_header").distinct().collect()]
    if not layouts:
        raise ValueError("no file has a #fields and a #types line")
    kinds: dict[str, str] = {}
    places = []
    for layout in sorted(layouts):
        names, types = (line.split("\t")[1:] for line in layout.split("\n"))
        if len(names) != len(types):
            raise ValueError(f"{len(names)} fields and {len(types)} types in one header")
        for name, kind in zip(names, types):
            if kinds.setdefault(name, kind) != kind:
                raise ValueError(f"column {name} is both {kinds[name]} and {kind}")
        places.append((layout, {name: i for i, name in enumerate(names)}))
    parts = F.split("value", "\t")
    body = lines.filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    # One layout, the usual case, needs no join.
    body = body.withColumn("_header", F.lit(layouts[0])) if len(layouts) == 1 else body.join(files, "_file", "left")

    def column(name: str, kind: str) -> Column:
        text = F.lit(None).cast("string")
        for layout, place in places:
            if name in place:
                text = F.when(F.col("_header") == layout, F.get(parts, F.lit(place[name]))).otherwise(text)
        value = F.when(~text.isin("-", "(empty)"), text)
        if kind == "bool":
            return F.when(value == "T", True).when(value == "F", False).alias(name)
        return value.try_cast(ZEEK_TYPES.get(kind, "string")).alias(name)

    return body.select(*[column(name, kind) for name, kind in kinds.items()])


def read_snapshots(
    spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "UTF-8",
    layout: str = r"([^/]+)/snapshot-(\d+)-([^/]+)/([a-z]+)_[^/]*\.json$",
) -> DataFrame:
    """Memory-snapshot files ``{"titles": [...], "data": [[...], ...]}``, one row per data row.

    ``source``, ``snapshot_id``, ``timestamp`` and ``plugin`` come from the path. Missing columns are null
    and files that do not parse are left out. Bytes that are not valid UTF-8 are read as latin-1.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    utf8 = F.try_validate_utf8(raw["content"].cast("string"))
    text = F.coalesce(utf8, F.decode("content", "ISO-8859-1")) if encoding == "UTF-8" else F.decode("content", encoding)
    parsed = raw.select("path", F.from_json(text, "titles ARRAY<STRING>, data ARRAY<ARRAY<STRING>>").alias("j"))
    rows = parsed.filter("j.titles is not null and j.data is not null").select(
        "path", F.col("j.titles").alias("t"), F.posexplode("j.data").alias("row_id", "d")
    )

    def value(name: str) -> Column:
        at = F.array_position("t", name).cast("int")
        return F.when(at > 0, F.try_element_at("d", F.nullif(at, F.lit(0)))).alias(name)

    stamp = F.regexp_replace(F.regexp_extract("path", layout, 3), "_", ":")
    return rows.select(
        F.regexp_extract("path", layout, 1).alias("source"),
        F.regexp_extract("path", layout, 2).try_cast("bigint").alias("snapshot_id"),
        stamp.alias("timestamp"),
        F.regexp_extract("path", layout, 4).alias("plugin"),
        "row_id",
        *[value(c) for c in columns],
    )
