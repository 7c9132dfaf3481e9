"""Frequency-domain anomaly detection on per-user signals.

Spark builds and bounds the signals; numpy transforms one signal at a time inside a pandas UDF.
Count signals have one value per time bin, so their length is bounded by the covered time. Event signals
have one value per event; every user's events are analysed in consecutive segments of one fixed length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.session import by_key, configure, durable


def periodogram(signals: np.ndarray) -> np.ndarray:
    """Energy per frequency of each standardised signal (last axis)."""
    centred = signals - signals.mean(-1, keepdims=True)
    spread = signals.std(-1, keepdims=True)
    return np.abs(np.fft.fft(centred / np.where(spread == 0, 1.0, spread))) ** 2 / signals.shape[-1]


def anomaly_mask(
    signals: np.ndarray, percentile: float = 90, zthresh: float = 8, lowpass: float | None = None
) -> np.ndarray:
    """Points of each equally long signal (rows) that a low-energy-filtered reconstruction misses by
    ``zthresh`` deviations or more."""
    n = signals.shape[-1]
    energy = periodogram(signals)[..., : n // 2 + 1]
    if lowpass:
        positions = np.arange(energy.shape[-1])
        drop = np.broadcast_to(positions >= int(np.percentile(positions, lowpass)), energy.shape)
    else:
        drop = energy < np.percentile(energy, percentile, axis=-1, keepdims=True)
    spectrum = np.where(drop, 0, np.fft.rfft(signals, n=n))
    error = np.abs(np.fft.irfft(spectrum, n=n) - signals)
    spread = error.std(-1, keepdims=True)
    distance = np.abs(error - error.mean(-1, keepdims=True))
    z = np.where(spread == 0, 0.0, distance / np.where(spread == 0, 1.0, spread))
    return z >= zthresh


def anomalous_points(
    signal: np.ndarray, percentile: float = 90, zthresh: float = 8, lowpass: float | None = None
) -> np.ndarray:
    """Indices of the anomalous points of one signal."""
    values = np.asarray(signal, dtype=float)
    if len(values) == 0:
        return np.array([], dtype=int)
    return np.flatnonzero(anomaly_mask(values[None, :], percentile, zthresh, lowpass)[0])


def count_signal(df: DataFrame, user: str, ts: str, width: str = "1 hour") -> DataFrame:
    """Events per non-empty time bin of each user."""
    return df.groupBy(user, F.window(ts, width)["start"].alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def count_anomalies(
    df: DataFrame, user: str, ts: str, width: str = "1 hour", percentile: float = 90, zthresh: float = 8,
    min_history: int = 10,
) -> DataFrame:
    """(user, bin, n) of the anomalous bins."""
    configure(df.sparkSession)
    bins = count_signal(df, user, ts, width)

    @F.pandas_udf("array<int>")
    def detect(series: pd.Series) -> pd.Series:
        return series.map(
            lambda v: anomalous_points(v, percentile, zthresh) if len(v) >= min_history else np.array([], dtype=int)
        )

    signals = bins.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("s"))
    hits = by_key(signals, user).withColumn("hits", detect(F.col("s.n").cast("array<double>")))
    return hits.select(user, F.explode(F.transform("hits", lambda i: F.element_at("s", i + 1))).alias("h")).select(
        user, "h.bin", "h.n"
    )


def event_anomalies(
    df: DataFrame, user: str, ts: str, row_id: str, signal: str, percentile: float = 90, zthresh: float = 8,
    min_history: int = 10, segment: int = 100_000,
) -> DataFrame:
    """Rows of the events whose signal value is anomalous within the user's sequence.

    The sequence is analysed in consecutive segments of ``segment`` events (``min_history`` at least), for every user
    alike; a last segment of fewer than ``min_history`` events belongs to the one before it. A user of fewer than
    ``min_history`` events in all has no anomalies.
    """
    configure(df.sparkSession)
    segment = max(segment, min_history)
    rows = ordered.row_index(df.select(user, ts, row_id, signal), [user], [ts, row_id], "_i")
    # At most one row for every ``segment`` events.
    rest = df.groupBy(F.col(user).alias("_user")).agg(F.count(F.lit(1)).alias("_n"))
    rest = rest.filter((F.col("_n") > segment) & (F.col("_n") % segment).between(1, min_history - 1))
    rest = rest.select("_user", (F.floor(F.col("_n") / segment) - 1).alias("_last"))
    rows = rows.join(rest, rows[user].eqNullSafe(rest["_user"]), "left").drop("_user")
    rows = rows.withColumn("_segment", F.least(F.floor(F.col("_i") / segment), F.col("_last"))).drop("_last")

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < min_history:
            return pdf.iloc[:0][[user, ts, row_id, signal]]
        pdf = pdf.sort_values("_i", kind="stable")
        hits = anomalous_points(pdf[signal].to_numpy(), percentile, zthresh)
        return pdf.iloc[hits][[user, ts, row_id, signal]]

    return by_key(rows, user, "_segment").groupBy(user, "_segment").applyInPandas(detect, df.select(user, ts, row_id, signal).schema)


#: Bins of one block of a user's history: windows and counts meet by block.
BLOCK_BINS = 64


def timeseries_flags(
    df: DataFrame, user: str, ts: str, batch: str, resolution_s: int = 3600, min_window_s: int = 43200,
    hot_start: bool = False, cold_end: bool = True, percentile: float = 90, zthresh: float = 8,
) -> DataFrame:
    """Rows with ``ts_anomaly``: is the event's time bin anomalous in the window around its batch?

    The window reaches half of ``min_window`` to both sides of the batch. Batches before the first full left
    window pass unflagged unless ``hot_start``; batches without a full right window unless not ``cold_end``. Windows are
    dealt out by (user, batch) and take the counts of the blocks they overlap, so no task holds a user's history. A null
    user is a user like any other.
    """
    configure(df.sparkSession)
    half = int(np.ceil(min_window_s / resolution_s))
    second = F.round(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).cast("bigint")
    origin = df.groupBy(user).agg(
        F.unix_seconds(F.date_trunc("day", F.min(ts)).cast("timestamp")).alias("_t0")
    )
    rows = ordered._null_safe(df, origin, [user], "inner")
    rows = rows.withColumn("_bin", F.floor((second - F.col("_t0")) / resolution_s).cast("int")).drop("_t0")
    counts = durable(rows.groupBy(user, "_bin").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    extent = counts.groupBy(user).agg(F.min("_bin").alias("_first"), F.max("_bin").alias("_last"))
    spans = rows.groupBy(user, batch).agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi"))
    spans = durable(ordered._null_safe(spans, extent, [user], "inner"))
    if not hot_start:
        warm = spans.filter(F.col("_first") <= F.col("_lo") - half).groupBy(user).agg(F.min(batch).alias("_from"))
        spans = ordered._null_safe(spans, warm, [user], "inner").filter(F.col(batch) >= F.col("_from"))
    if cold_end:
        spans = spans.filter(F.col("_last") >= F.col("_hi") + half)
    spans = spans.select(user, batch, "_lo", "_hi", (F.col("_lo") - half).alias("_start"), (F.col("_hi") + half).alias("_end"))
    block = lambda c: F.floor(F.col(c) / BLOCK_BINS)
    wanted = spans.withColumn("_block", F.explode(F.sequence(block("_start"), block("_end"))))
    met = ordered._null_safe(wanted, counts.withColumn("_block", block("_bin")), [user, "_block"], "inner")
    met = met.filter(F.col("_bin").between(F.col("_start"), F.col("_end")))
    # One empty bin in front, and the last bin counted together with the one before it.
    place = F.least(F.col("_bin") - F.col("_start") + 1, F.col("_end") - F.col("_start"))
    signals = met.groupBy(user, batch, "_lo", "_hi").agg(F.collect_list(F.struct(place.alias("at"), "_n")).alias("_s"))

    @F.pandas_udf("array<int>")
    def detect(places: pd.Series, ns: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        out: list[list[int]] = [[] for _ in range(len(lows))]
        by_length: dict[int, list[int]] = {}
        for row, (low, high) in enumerate(zip(lows, highs)):
            by_length.setdefault(high - low + 2 * half + 1, []).append(row)
        # Windows of one length are transformed together.
        for length, same in by_length.items():
            signals = np.zeros((len(same), length))
            for k, row in enumerate(same):
                np.add.at(signals[k], np.asarray(places.iloc[row]), np.asarray(ns.iloc[row]))
            for row, mask in zip(same, anomaly_mask(signals, percentile, zthresh)):
                found = lows.iloc[row] - half - 1 + np.flatnonzero(mask)
                out[row] = [int(b) for b in found if lows.iloc[row] <= b <= highs.iloc[row]]
        return pd.Series(out)

    hits = detect(F.col("_s.at"), F.col("_s._n"), F.col("_lo"), F.col("_hi"))
    flagged = by_key(signals, user, batch).select(user, batch, F.explode(hits).alias("_bin")).withColumn("_hit", F.lit(True))
    out = ordered._null_safe(rows, durable(flagged), [user, batch, "_bin"], "left")
    return out.withColumn("ts_anomaly", F.coalesce("_hit", F.lit(False))).drop("_hit", "_bin")


def bin_flags(
    df: DataFrame, user: str, ts: str, resolution_s: int = 3600, min_window_s: int = 43200, hot_start: bool = False,
    percentile: float = 90, zthresh: float = 8,
) -> DataFrame:
    """Rows with ``ts_anomaly``: is the event's time bin anomalous among the bins half a window to both sides?

    The batch form of ``streaming.state.windowed_flags``: without ``hot_start``, bins that have no full window on
    their left within the user's history pass unflagged.
    """
    configure(df.sparkSession)
    half = -(-min_window_s // resolution_s)
    rows = df.withColumn("_bin", F.expr(f"unix_micros(cast(`{ts}` as timestamp)) div {resolution_s * 1_000_000}"))
    counts = rows.groupBy(user, "_bin").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    shift = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    # Every bin sends its count to the windows it lies in; a window is as long as its parameters say.
    sent = counts.select(user, "_n", "_bin", shift.alias("_s")).select(user, "_n", (F.col("_bin") + F.col("_s")).alias("_bin"), (-F.col("_s")).alias("_s"))
    windows = sent.groupBy(user, "_bin").agg(F.map_from_entries(F.collect_list(F.struct("_s", "_n"))).alias("_w"))
    windows = ordered._null_safe(windows, counts.select(user, "_bin"), [user, "_bin"], "left_semi")
    first = counts.groupBy(user).agg(F.min("_bin").alias("_first"))
    signal = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda i: F.coalesce(F.try_element_at("_w", i), F.lit(0.0)))

    @F.pandas_udf("boolean")
    def middle(series: pd.Series) -> pd.Series:
        return pd.Series(anomaly_mask(np.stack(series.to_list()), percentile, zthresh)[:, half]) if len(series) else pd.Series([], dtype=bool)

    warm = F.lit(True) if hot_start else F.col("_first") <= F.col("_bin") - half
    windows = ordered._null_safe(windows, first, [user], "inner")
    flags = windows.select(user, "_bin", (warm & middle(signal)).alias("ts_anomaly"))
    return ordered._null_safe(rows, flags, [user, "_bin"], "inner").drop("_bin")
