"""The scored stream: features over all micro-batches, a stored fingerprint, and two sinks.

Every micro-batch adds its rows to what their users have shown so far, scores the last row of each user against the
stored model, and writes anomalies and clean rows to a sink each. All that a micro-batch writes, carries and sinks, is
named by its epoch: after a failure anywhere in it the stream replays the epoch and overwrites the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import ordered, scoring
from tidemark.session import durable
from tidemark.streaming import carry, jobs

Sink = Callable[[DataFrame, int], None]


@dataclass
class ScoredStream:
    """What is scored: the columns, the stored model, its scaler and the threshold on ``mean_abs_z``."""

    model: scoring.Model
    folder: str
    user: str
    ts: str
    row_id: str
    value: str
    threshold: float
    kinds: tuple[str, str] = ("bigint", "string")
    min_rows: int = 1
    scaler: str = "z"
    every: int = 20
    sinks: Mapping[str, Sink] = field(default_factory=dict)

    def routed(self, batch: DataFrame, epoch: int) -> DataFrame:
        """The last row of each user in the batch, scored, with its ``route``; late rows have the route ``late``."""
        users, values = carry.carries(batch.sparkSession, self.folder, self.user, self.value, self.kinds, self.every)
        rows = carry.running_features(batch, users.before(epoch), values.before(epoch), self.user, self.ts, self.row_id, self.value)
        rows = durable(rows)
        on_time = rows.filter("not late")
        last = durable(ordered.latest(on_time, [self.user], self.ts, self.row_id))
        users.write(epoch, last.withColumns({"last_ts": F.col(self.ts), "last_id": F.col(self.row_id)}))
        values.write(epoch, on_time.groupBy(self.user, self.value).agg(F.max("day").alias("day")))
        scored = scoring.score(last, self.user, self.model, min_rows=self.min_rows, scaler=self.scaler)
        routed = jobs.scored_routes(scored, "mean_abs_z", self.threshold)
        return routed.unionByName(rows.filter("late").withColumn("route", F.lit("late")), allowMissingColumns=True)

    def write(self, batch: DataFrame, epoch: int) -> None:
        rows = durable(self.routed(batch, epoch))
        for name, sink in self.sinks.items():
            sink(rows.filter(F.col("route") == name).drop("route"), epoch)

    def start(self, stream: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def epoch_sink(folder: str, name: str) -> Sink:
    """A folder per route and epoch, overwritten by a replay."""
    return lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{folder}/route={name}/epoch={epoch}")


def training_features(rows: DataFrame, user: str, ts: str, row_id: str, value: str, kinds: Sequence[str] = ("bigint", "string")) -> DataFrame:
    """The stream's features over a table: the rows as one micro-batch with nothing carried into it."""
    users, values = carry.carries(rows.sparkSession, "", user, value, tuple(kinds))
    return carry.running_features(rows, users.before(0), values.before(0), user, ts, row_id, value)
