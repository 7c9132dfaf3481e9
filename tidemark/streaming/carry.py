"""What a stream carries from one micro-batch to the next, as tables written per epoch.

A carry is a keyed table: the row of a key after epoch k is the latest one written by any epoch up to k. Every epoch
writes only the keys it changed, below its own number, so a replayed epoch overwrites its own output and reads what the
epochs before it left. Every few epochs all keys are written once more, which bounds what a read has to merge.

The rows of a micro-batch are numbered, summed and made distinct by the same operators as a table, which split large
keys; a key's carry is one row. So a user who owns half of all rows is spread over tasks in a stream as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ordered
from tidemark.session import broadcast_if_small, durable


class Carry:
    """Latest row per key, by epoch. ``schema`` starts with the key columns, whose values may be null."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], schema: str, every: int = 20):
        self.spark, self.folder, self.keys, self.every = spark, folder, list(keys), every
        self.schema = T.StructType.fromDDL(schema)

    def path(self, kind: str, epoch: int) -> str:
        return f"{self.folder}/{kind}={epoch}"

    def before(self, epoch: int) -> DataFrame:
        """The carry as the epochs before ``epoch`` left it."""
        base = epoch // self.every * self.every - 1
        paths = [(base, self.path("all", base))] if base >= 0 else []
        paths += [(k, self.path("changed", k)) for k in range(base + 1, epoch)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(path).withColumn("_epoch", F.lit(k)) for k, path in paths]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        values = [f.name for f in self.schema if f.name not in self.keys]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "_epoch").alias("_v"))
        return latest.select(*self.keys, "_v.*")

    def write(self, epoch: int, changed: DataFrame) -> None:
        """Store the rows of the keys that ``epoch`` changed, one per key."""
        changed.select(*[f.name for f in self.schema]).write.mode("overwrite").parquet(self.path("changed", epoch))
        if (epoch + 1) % self.every == 0:
            self.before_all(epoch).write.mode("overwrite").parquet(self.path("all", epoch))

    def before_all(self, epoch: int) -> DataFrame:
        """The carry after ``epoch``."""
        own = self.spark.read.schema(self.schema).parquet(self.path("changed", epoch))
        rest = ordered._null_safe(self.before(epoch), broadcast_if_small(own.select(*self.keys)), self.keys, "left_anti")
        return rest.unionByName(own)


def joined(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the carry, first cut down to the keys that occur in ``rows``."""
    wanted = rows.select(*keys).distinct()
    return ordered._null_safe(rows, ordered._null_safe(carry, wanted, keys, "left_semi"), keys, "left")


def running_features(batch: DataFrame, users: DataFrame, values: DataFrame, user: str, ts: str, row_id: str, value: str) -> DataFrame:
    """A micro-batch's rows with what the user has shown up to each of them: ``n_total`` rows, ``n_today`` rows and
    ``values_today`` distinct ``value``s of the day, and ``late``.

    ``users`` (user, last_ts, day, n_total, n_today, values_today) and ``values`` (user, value, day) are the carries. A row
    older than the user's latest row of earlier micro-batches is late: it is kept, but counts for nothing.
    """
    day = F.date_trunc("day", ts)
    rows = batch.withColumn("day", day)
    state = users.select(user, *[F.col(c).alias(f"_{c}") for c in ("last_ts", "day", "n_total", "n_today", "values_today")])
    rows = joined(rows, state, [user])
    rows = rows.withColumn("late", F.coalesce(F.col(ts) < F.col("_last_ts"), F.lit(False)))
    known = values.select(user, value, F.col("day").alias("_seen"))
    rows = durable(joined(rows, known, [user, value]))
    on_time = rows.filter("not late")
    total = ordered.row_index(on_time, [user], [ts, row_id], "_i")
    today = ordered.row_index(total, [user, "day"], [ts, row_id], "_j")
    first = ordered.row_index(today, [user, "day", value], [ts, row_id], "_k")
    new = (F.col("_k") == 0) & ~F.coalesce(F.col("_seen") == F.col("day"), F.lit(False))
    flagged = ordered.running_sum(first, [user, "day"], [ts, row_id], F.when(new, 1).otherwise(0), "_new")
    same = F.coalesce(F.col("_day") == F.col("day"), F.lit(False))
    carried = lambda c: F.when(same, F.col(c)).otherwise(0)
    counted = flagged.select(
        *batch.columns, "day", "late",
        (F.coalesce("_n_total", F.lit(0)) + F.col("_i") + 1).cast("long").alias("n_total"),
        (carried("_n_today") + F.col("_j") + 1).cast("long").alias("n_today"),
        (carried("_values_today") + F.col("_new")).cast("long").alias("values_today"),
    )
    late = rows.filter("late").select(*batch.columns, "day", "late", *[F.lit(None).cast("long").alias(c) for c in ("n_total", "n_today", "values_today")])
    return counted.unionByName(late)


def carries(spark: SparkSession, folder: str, user: str, value: str, kinds: tuple[str, str], every: int = 20) -> tuple[Carry, Carry]:
    """The two carries of ``running_features``; ``kinds`` are the SQL types of user and value."""
    users = f"`{user}` {kinds[0]}, last_ts timestamp, last_id bigint, day timestamp, n_total bigint, n_today bigint, values_today bigint"
    return (
        Carry(spark, f"{folder}/users", [user], users, every),
        Carry(spark, f"{folder}/values", [user, value], f"`{user}` {kinds[0]}, `{value}` {kinds[1]}, day timestamp", every),
    )
