"""Declared feature schemas: one ``select`` that casts, renames, derives and drops columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ordered

# Dtype names a schema may use, and their Spark types.
DTYPES = {
    "str": "string",
    "string": "string",
    "object": "string",
    "int": "bigint",
    "int64": "bigint",
    "int32": "int",
    "float": "double",
    "float64": "double",
    "float32": "float",
    "bool": "boolean",
    "datetime": "timestamp",
    "datetime64[ns]": "timestamp",
}


def spark_type(dtype: str) -> str:
    return DTYPES.get(dtype, dtype)


def has_path(schema: T.StructType, path: str) -> bool:
    """Whether a dotted path exists in a (nested) schema."""
    current: T.DataType = schema
    for part in path.split("."):
        if not isinstance(current, T.StructType) or part not in current.fieldNames():
            return False
        current = current[part].dataType
    return True


def source_column(df: DataFrame, path: str, dtype: str | None = None) -> Column:
    """The named column, or an all-null one when the input does not carry it."""
    if has_path(df.schema, path):
        return F.col(path)
    return F.lit(None).cast(spark_type(dtype or "string"))


def safe_cast(column: Column, dtype: str) -> Column:
    return column.try_cast(spark_type(dtype))


@dataclass
class Plain:
    name: str
    dtype: str

    def build(self, df: DataFrame) -> Column:
        return safe_cast(source_column(df, self.name, self.dtype), self.dtype)


@dataclass
class Rename:
    name: str
    dtype: str
    source: str

    def build(self, df: DataFrame) -> Column:
        return safe_cast(source_column(df, self.source, self.dtype), self.dtype)


@dataclass
class Derived:
    """A user expression, given the input frame; may wrap a pandas UDF."""

    name: str
    dtype: str
    expression: Callable[[DataFrame], Column]

    def build(self, df: DataFrame) -> Column:
        return self.expression(df).cast(spark_type(self.dtype))


@dataclass
class Bool:
    """Map listed values to true/false; ``unmapped`` is what every other value becomes."""

    name: str
    source: str
    true_values: Sequence[str] = ()
    false_values: Sequence[str] = ()
    unmapped: bool | None = True

    def build(self, df: DataFrame) -> Column:
        column = source_column(df, self.source).cast("string")
        chosen = F.when(column.isin(*self.true_values), True) if self.true_values else F.when(F.lit(False), True)
        if self.false_values:
            chosen = chosen.when(column.isin(*self.false_values), False)
        return chosen.otherwise(F.lit(self.unmapped).cast("boolean"))


@dataclass
class DateTime:
    name: str
    source: str

    def build(self, df: DataFrame) -> Column:
        return source_column(df, self.source).try_cast("timestamp").cast("timestamp_ntz")


@dataclass
class StringJoin:
    """Join the elements of a list, or the characters of a text."""

    name: str
    source: str
    sep: str = ","

    def build(self, df: DataFrame) -> Column:
        column = source_column(df, self.source)
        if has_path(df.schema, self.source) and isinstance(
            df.select(self.source).schema[0].dataType, T.ArrayType
        ):
            return F.array_join(column, self.sep)
        return F.array_join(F.filter(F.split(column.cast("string"), ""), lambda c: c != ""), self.sep)


@dataclass
class StringCat:
    """Concatenate several columns; nulls appear as the text ``nan``."""

    name: str
    sources: Sequence[str]
    sep: str = ", "

    def build(self, df: DataFrame) -> Column:
        parts = [F.coalesce(source_column(df, c).cast("string"), F.lit("nan")) for c in self.sources]
        return F.concat_ws(self.sep, *parts)


@dataclass
class ListJoin:
    """Comma-join a list column; empty text when the input lacks it."""

    name: str
    source: str

    def build(self, df: DataFrame) -> Column:
        if not has_path(df.schema, self.source):
            return F.lit("")
        return F.array_join(F.col(self.source), ",")


@dataclass
class Increment:
    """0-based count of rows so far of a group within a period."""

    name: str
    groupby: str
    timestamp: str
    period: str = "day"


@dataclass
class DistinctIncrement:
    """Running number of distinct values of a column within (group, period); null is one value."""

    name: str
    source: str
    groupby: str
    timestamp: str
    period: str = "day"
    null_time_to_epoch: bool = False


@dataclass
class FeatureSchema:
    columns: Sequence[object]
    json_columns: Mapping[str, str] = field(default_factory=dict)
    preserve: Sequence[str] = ()
    row_filter: Callable[[DataFrame], Column] | None = None
    row_id: str | None = None

    def required_inputs(self) -> dict[str, str]:
        """Input columns and dtypes; conflicting declarations are an error."""
        needed: dict[str, str] = {}
        for column in self.columns:
            if isinstance(column, (Plain, Rename)):
                source = column.source if isinstance(column, Rename) else column.name
                dtype = spark_type(column.dtype)
                if needed.get(source, dtype) != dtype:
                    raise ValueError(f"input {source} declared as {needed[source]} and as {dtype}")
                needed[source] = dtype
        return needed

    def apply(self, df: DataFrame) -> DataFrame:
        self.required_inputs()
        if self.json_columns:
            df = flatten_json(df, self.json_columns, self.preserve)
        increments = [c for c in self.columns if isinstance(c, (Increment, DistinctIncrement))]
        simple = [c for c in self.columns if c not in increments]
        kept = preserved_columns(df.columns, self.preserve, {c.name for c in self.columns})
        if increments and self.row_id is None:
            raise ValueError("increment columns need row_id, the tie-break of the row order")
        if increments:
            df = add_increments(df, increments, self.row_id)
        projected = [c.build(df).alias(c.name) for c in simple]
        projected += [F.col(c.name) for c in increments]
        out = df.select(*projected, *[F.col(f"`{c}`") for c in kept])
        return out.filter(self.row_filter(out)) if self.row_filter else out


def add_increment(df: DataFrame, spec: Increment | DistinctIncrement, row_id: str) -> DataFrame:
    return add_increments(df, [spec], row_id)


def add_increments(df: DataFrame, specs: Sequence[Increment | DistinctIncrement], row_id: str) -> DataFrame:
    """Increment columns; those with the same group and period are computed together."""
    groups: dict[tuple, list] = {}
    for spec in specs:
        to_epoch = isinstance(spec, DistinctIncrement) and spec.null_time_to_epoch
        groups.setdefault((spec.groupby, spec.timestamp, spec.period, to_epoch), []).append(spec)
    for (groupby, timestamp, period, to_epoch), members in groups.items():
        stamp = F.col(timestamp)
        if to_epoch:
            stamp = F.coalesce(stamp, F.lit("1970-01-01").cast("timestamp_ntz"))
        df = ordered.running_columns(
            df.withColumn("_period", F.date_trunc(period, stamp)),
            [groupby, "_period"],
            [timestamp, row_id],
            index=[m.name for m in members if isinstance(m, Increment)],
            distinct={
                m.name: F.coalesce(F.col(m.source).cast("string"), F.lit("nan"))
                for m in members
                if isinstance(m, DistinctIncrement)
            },
        ).drop("_period")
    return df


def preserved_columns(names: Iterable[str], patterns: Sequence[str], taken: set[str]) -> list[str]:
    return [n for n in names if n not in taken and any(re.match(p, n) for p in patterns)]


def flatten_json(df: DataFrame, json_columns: Mapping[str, str], preserve: Sequence[str] = ()) -> DataFrame:
    """Parse JSON text columns with a declared schema into ``column.field`` columns."""
    out = df
    for name, ddl in json_columns.items():
        parsed = out.withColumn("_json", F.from_json(F.col(name), ddl))
        fields = parsed.schema["_json"].dataType.fieldNames()
        out = parsed.select(
            "*", *[F.col(f"_json.`{f}`").alias(f"{name}.{f}") for f in fields]
        ).drop("_json")
    dropped = [n for n in json_columns if not any(re.match(p, n) for p in preserve)]
    return out.drop(*dropped)


def regex_select(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ("^ID$", "^_ts_")) -> DataFrame:
    names = [c for c in df.columns if not include or any(re.match(p, c) for p in include)]
    names = [c for c in names if not any(re.match(p, c) for p in exclude)]
    return df.select(*[F.col(f"`{c}`") for c in names])


def select_features(
    available: Sequence[str], requested: Sequence[str], excluded: Sequence[str] = ()
) -> list[str]:
    chosen = [c for c in requested if c in set(available) and c not in set(excluded)]
    if not chosen:
        raise ValueError("no requested feature is available")
    return chosen


def from_config(config: Sequence[Mapping[str, object]], row_id: str | None = None, preserve: Sequence[str] = ()) -> FeatureSchema:
    """Schema from a list of ``{name, dtype, op_type, ...}`` entries, as read from YAML or JSON.

    ``increment`` and ``distinct`` count within ``groupby`` (default username) and ``period`` by ``timestamp``; they
    come after the other columns and need ``row_id``, the tie-break of equal times.
    """
    counted = lambda c: (c.get("groupby", "username"), c.get("timestamp", "timestamp"), c.get("period", "day"))
    builders = {
        "select": lambda c: Plain(c["name"], c["dtype"]),
        "rename": lambda c: Rename(c["name"], c["dtype"], c["from"]),
        "bool": lambda c: Bool(c["name"], c["from"], c.get("true", ()), c.get("false", ())),
        "datetime": lambda c: DateTime(c["name"], c.get("from", c["name"])),
        "join": lambda c: StringJoin(c["name"], c["from"], c.get("sep", ",")),
        "concat": lambda c: StringCat(c["name"], c["from"], c.get("sep", ", ")),
        "increment": lambda c: Increment(c["name"], *counted(c)),
        "distinct": lambda c: DistinctIncrement(c["name"], c["from"], *counted(c)),
    }
    unknown = [c.get("op_type") for c in config if c.get("op_type", "select") not in builders]
    if unknown:
        raise ValueError(f"unknown op_type {unknown}")
    names = [c["name"] for c in config]
    if len(set(names)) < len(names):
        raise ValueError(f"columns declared twice: {sorted({n for n in names if names.count(n) > 1})}")
    return FeatureSchema([builders[c.get("op_type", "select")](c) for c in config], preserve=preserve, row_id=row_id)


# Columns that a feature file may select, by kind, in output order.
FILE_TEXTS = (
    "appDisplayName", "resourceDisplayName", "clientAppUsed", "deviceDetailbrowser", "deviceDetaildisplayName",
    "deviceDetailoperatingSystem", "statusfailureReason", "location_city_state_country", "location_state_country",
    "location_country", "category",
)
FILE_NUMBERS = {
    "location_geoCoordinates_latitude": "float", "location_geoCoordinates_longitude": "float", "travel_speed_kmph": "float",
    "distance_km": "float", "ts_delta_hour": "float", "autonomousSystemNumber": "int",
}
FILE_FLAGS = ("is_corp_vpn", "is_weekend")
#: Counting features and the input whose distinct values they count (none: rows).
FILE_COUNTS = {"logcount": None, "locincrement": "location", "appincrement": "appDisplayName"}
#: Inputs that a feature computed later needs beside itself.
FILE_NEEDS = {"travel_speed_kmph": ("location_geoCoordinates_latitude", "location_geoCoordinates_longitude")}


def read_config(spark: SparkSession, path: str) -> dict:
    """A feature file, YAML or JSON, from any path that Spark reads."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text)


def feature_entries(config: Mapping[str, object], feature_set: str = "default") -> list[dict]:
    """``from_config`` entries of one feature set: time, user, texts, numbers, flags, location, counters.

    The file's ``model_features`` maps a set to its column names (an unknown set means ``default``);
    ``categorical_features`` may switch a text off by ``enabled: false``; ``behavioral_features`` may give a counter's
    ``input_name``, ``groupby_column``, ``timestamp_column`` and ``period`` under a key ending in ``params``. Inputs of
    a selected counter and coordinates of a selected travel speed are added unasked. Names the file selects and
    nobody knows are an error.
    """
    sets = config.get("model_features") or {}
    wanted = set(sets.get(feature_set, sets.get("default", ())))
    known = {*FILE_TEXTS, *FILE_NUMBERS, *FILE_FLAGS, *FILE_COUNTS, "timestamp", "username", "location"}
    if wanted - known:
        raise ValueError(f"unknown features {sorted(wanted - known)}")
    off = {name for name, entry in (config.get("categorical_features") or {}).items() if (entry or {}).get("enabled", True) is False}
    counters = []
    for name, source in FILE_COUNTS.items():
        if name not in wanted:
            continue
        entry = (config.get("behavioral_features") or {}).get(name) or {}
        given = next((v for k, v in entry.items() if k.endswith("params") and v), {})
        one = {
            "name": name, "op_type": "distinct" if source else "increment", "groupby": given.get("groupby_column", "username"),
            "timestamp": given.get("timestamp_column", "timestamp"), "period": given.get("period", "day"),
        }
        if source:
            one["from"] = given.get("input_name", source)
        elif "input_name" in given:
            one["timestamp"] = given["input_name"]
        counters.append(one)
    needed = {c["from"] for c in counters if "from" in c}
    needed.update(n for feature, inputs in FILE_NEEDS.items() if feature in wanted for n in inputs)
    chosen = (wanted | needed) - off
    select = lambda name, dtype: {"name": name, "dtype": dtype}
    return [
        {"name": "timestamp", "op_type": "datetime"},
        select("username", "str"),
        *[select(n, "str") for n in FILE_TEXTS if n in chosen],
        *[select(n, t) for n, t in FILE_NUMBERS.items() if n in chosen],
        *[select(n, "bool") for n in FILE_FLAGS if n in chosen],
        select("location", "str"),
        *counters,
    ]


def from_file(
    spark: SparkSession, path: str, feature_set: str = "default", row_id: str | None = None, preserve: Sequence[str] = ("_batch_id",)
) -> FeatureSchema:
    """Schema of one feature set of a feature file (``feature_entries``); ``preserve`` are patterns of columns kept."""
    return from_config(feature_entries(read_config(spark, path), feature_set), row_id, preserve)


def clean_names(df: DataFrame) -> DataFrame:
    """Strip ``_ . { } :`` from column names."""
    return df.toDF(*[re.sub(r"[_.{}:]", "", c) for c in df.columns])


def ensure_columns(df: DataFrame, wanted: Sequence[str], fill: object = 0) -> DataFrame:
    """Wanted columns only, missing ones filled, names starting with ``_`` first."""
    ordered_names = [c for c in wanted if c.startswith("_")] + [c for c in wanted if not c.startswith("_")]
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in ordered_names])


def truncate_bytes(column: Column, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes of a text, never cutting a character in two."""
    raw = F.encode(column, "UTF-8")
    size = F.octet_length(column)
    # A continuation byte (0x80-0xBF) right after the cut means the cut is inside a character.
    def is_tail(position: int) -> Column:
        byte = F.conv(F.hex(F.substring(raw, position, 1)), 16, 10).cast("int")
        return (byte >= 128) & (byte < 192)

    keep = F.lit(limit)
    for back in range(3):
        keep = F.when((keep == limit - back) & is_tail(limit - back + 1), limit - back - 1).otherwise(keep)
    short = F.decode(raw.substr(F.lit(1), keep), "UTF-8")
    return F.when(size <= limit, column).otherwise(short)


def missing_values(
    df: DataFrame, policy: str, keys: Sequence[str] = (), order: Sequence[str] = ()
) -> DataFrame:
    """``drop`` rows with nulls, or ``fill``: 0 / 'unknown' / false, timestamps from a neighbour."""
    if policy == "drop":
        return df.na.drop()
    if policy != "fill":
        raise ValueError(f"unknown policy {policy}")
    stamps = []
    for f in df.schema.fields:
        if f.name in order or f.name in keys:
            continue
        if isinstance(f.dataType, T.BooleanType):
            df = df.withColumn(f.name, F.coalesce(f.name, F.lit(False)))
        elif isinstance(f.dataType, T.NumericType):
            df = df.withColumn(f.name, F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)))
        elif isinstance(f.dataType, T.StringType):
            df = df.withColumn(f.name, F.coalesce(f.name, F.lit("unknown")))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            stamps.append(f.name)
    for name in stamps:
        df = ordered.fill_last(df, keys, order, name, "_ahead")
        df = ordered.fill_last(df, keys, order, name, "_behind", forward=False)
        df = df.withColumn(name, F.coalesce("_ahead", "_behind")).drop("_ahead", "_behind")
    return df
