"""Packet-flow roll-up per minute, joined back onto the packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = {"ack": 16, "psh": 8, "rst": 4, "syn": 2, "fin": 1}


def minute_up(micros: Column) -> Column:
    """Next full minute; an exact minute moves on too."""
    return micros - micros % 60000000 + 60000000


def flow_id(src: Column, src_port: Column, dst: Column, dst_port: Column) -> Column:
    return F.concat(src, F.lit(":"), src_port.cast("string"), F.lit("="), dst, F.lit(":"), dst_port.cast("string"))


def decode_flags(flags: Column) -> dict[str, Column]:
    return {name: (flags.bitwiseAND(bit) > 0).cast("int") for name, bit in FLAGS.items()}


def flow_rollup(packets: DataFrame) -> DataFrame:
    """Per (rollup_time, flow_id): flag sums, bytes, packets and their ratios.

    ``packets`` has timestamp (microseconds), src_ip, dest_ip, src_port, dest_port, flags, data_len.
    Sums are long, so large flows do not overflow.
    """
    rows = keyed_packets(packets)
    totals = rows.groupBy("rollup_time", "flow_id").agg(
        *[F.sum(name).alias(name) for name in FLAGS],
        F.sum(F.col("data_len").cast("long")).alias("data_len"),
        F.count(F.lit(1)).alias("ppm"),
    )
    every = F.col("ack") + F.col("psh") + F.col("rst") + F.col("syn") + F.col("fin")
    totals = totals.withColumn("bpp", F.col("data_len") / F.col("ppm")).withColumn("all", every)
    totals = totals.withColumn("ackpush/all", F.try_divide(F.col("ack") + F.col("psh"), F.col("all")))
    for name in ("rst", "syn", "fin"):
        totals = totals.withColumn(f"{name}/all", F.try_divide(F.col(name), F.col("all")))
    return totals


def keyed_packets(packets: DataFrame) -> DataFrame:
    minute = F.timestamp_micros(minute_up(F.col("timestamp")))
    return packets.withColumns(
        {
            **decode_flags(F.col("flags")),
            "rollup_time": F.date_format(minute, "yyyy-MM-dd HH:mm"),
            "flow_id": flow_id(F.col("src_ip"), F.col("src_port"), F.col("dest_ip"), F.col("dest_port")),
        }
    )


def packets_with_flow(packets: DataFrame) -> DataFrame:
    """Every packet with its flow's roll-up (left join; AQE splits a hot flow on the packet side)."""
    rows = keyed_packets(packets).drop(*FLAGS, "data_len", "flags")
    return rows.join(flow_rollup(packets), ["rollup_time", "flow_id"], "left")
