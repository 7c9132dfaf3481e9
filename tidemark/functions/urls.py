"""URL parts by longest public-suffix match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import top_k
from tidemark.session import broadcast_if_small


def hostname(url: Column) -> Column:
    rough = F.regexp_extract(url, r"([\w]+[\.].*[^/]|[\-\w]+[\.].*[^/])", 1)
    return F.regexp_extract(rough, r"([\w\.\-]+)", 1)


def host_parts(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``hosts(hostname)`` distinct, ``suffixes(suffix)``: subdomain, domain, suffix per host.

    The longest suffix wins; a host that is itself a suffix, or has an unknown one, gets empty parts.
    """
    labels = F.split("hostname", r"\.")
    candidates = hosts.select(
        "hostname",
        labels.alias("_l"),
        F.posexplode(
            F.when(
                F.size(labels) > 1,
                F.transform(
                    F.sequence(F.lit(2), F.size(labels)),
                    lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
                ),
            ).otherwise(F.array().cast("array<string>"))
        ).alias("_pos", "suffix"),
    )
    matched = candidates.join(broadcast_if_small(suffixes.select("suffix").distinct()), "suffix")
    best = matched.withColumn("_b", F.struct("suffix", "_l", "_pos"))
    best = top_k(best.select("hostname", "_b"), ["hostname"], 1, F.asc("_b._pos"), rank="_rank")
    return best.select(
        "hostname",
        F.array_join(F.slice("_b._l", F.lit(1), F.col("_b._pos")), ".").alias("subdomain"),
        F.element_at("_b._l", F.col("_b._pos") + 1).alias("domain"),
        F.col("_b.suffix").alias("suffix"),
    )


def parse(df: DataFrame, url: str, suffixes: DataFrame) -> DataFrame:
    """Add hostname, subdomain, domain and suffix. Each distinct host is matched once."""
    named = df.withColumn("hostname", hostname(F.col(url)))
    parts = host_parts(named.select("hostname").distinct(), suffixes)
    out = named.join(parts, "hostname", "left")
    return out.na.fill("", ["subdomain", "domain", "suffix"])
