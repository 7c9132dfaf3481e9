"""Named frame-to-frame steps, function sources and guarded SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STAGES: dict[str, Callable[..., DataFrame]] = {}


def stage(fn: Callable[..., DataFrame] | None = None, *, name: str | None = None, needs: Sequence[str] = ()):
    """Register a DataFrame function by name; ``needs`` lists the columns its input must have."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def checked(df: DataFrame, **options) -> DataFrame:
            missing = [c for c in needs if c not in df.columns]
            if missing:
                raise ValueError(f"stage {name or f.__name__} needs columns {missing}")
            return f(df, **options)

        STAGES[name or f.__name__] = checked
        return checked

    return wrap(fn) if fn else wrap


def run_stages(df: DataFrame, steps: Sequence[str | Callable[[DataFrame], DataFrame] | tuple[str, Mapping]]) -> DataFrame:
    """Apply steps in order: registered names, (name, options) pairs or plain functions. One lazy plan."""
    for step in steps:
        if isinstance(step, str):
            df = df.transform(STAGES[step])
        elif isinstance(step, tuple):
            df = STAGES[step[0]](df, **step[1])
        else:
            df = df.transform(step)
    return df


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a pandas function over Arrow batches in Spark's Python workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def source(name: str, schema: str, partitions: int = 1):
    """Make a generator ``fn(options, partition)`` a readable format; partitions run side by side."""

    def wrap(fn: Callable[[dict, int], Iterator[tuple]]) -> type[DataSource]:
        class Reader(DataSourceReader):
            def __init__(self, options):
                self.options = options

            def partitions(self):
                return [InputPartition(i) for i in range(int(self.options.get("partitions", partitions)))]

            def read(self, partition):
                yield from fn(self.options, partition.value)

        class FunctionSource(DataSource):
            @classmethod
            def name(cls):
                return name

            def schema(self):
                return schema

            def reader(self, schema):
                return Reader(dict(self.options))

        return FunctionSource

    return wrap


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame with a row counter that fills in as an action runs: ``observation.get["rows"]``."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch


FORBIDDEN = re.compile(
    r"\b(insert|update|delete|drop|alter|create|truncate|merge|grant|revoke|cache|set|add|refresh|load|use)\b", re.I
)


def guarded_sql(spark: SparkSession, text: str, limit: int = 100) -> DataFrame:
    """A single SELECT over registered views, at most 100 rows."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", text).strip().rstrip(";").strip()
    if not re.match(r"(?is)^(select|with)\b", bare) or ";" in bare or FORBIDDEN.search(bare):
        raise ValueError("only a single SELECT statement is allowed")
    return spark.sql(text.strip().rstrip(";")).limit(min(int(limit), 100))
