"""Weighted full-text search and rank fusion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered

# Weight of each label of a search vector.
LABEL_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}

#: A token of a lower-cased text.
WORD = r"[0-9a-zà-ÿ]+"


def tokens(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-zà-ÿ]+")
    return F.filter(words, lambda w: w != "")


def index(df: DataFrame, doc: str, fields: Mapping[str, str]) -> DataFrame:
    """Token table (doc, token, weight): each occurrence adds the weight of its field's label A-D."""
    def weighted_tokens(name: str, label: str) -> Column:
        weight = F.lit(LABEL_WEIGHTS[label])
        return F.transform(tokens(F.col(name)), lambda t: F.struct(t.alias("token"), weight.alias("w")))

    weighted = F.concat(*[weighted_tokens(name, label) for name, label in fields.items()])
    return (
        df.select(doc, F.explode(weighted).alias("_t"))
        .groupBy(doc, F.col("_t.token").alias("token"))
        .agg(F.sum("_t.w").alias("weight"))
    )


def match(token_table: DataFrame, doc: str, words: Sequence[str], k: int) -> DataFrame:
    """Documents that hold every word, by summed log-damped weight, best ``k`` first.

    The rank is this package's own weighted term frequency, not a copy of another engine's.
    """
    terms = sorted({w.lower() for w in words})
    hits = token_table.filter(F.col("token").isin(terms)).groupBy(doc).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.log1p("weight")).alias("rank_score")
    )
    return hits.filter(F.col("_n") == len(terms)).drop("_n").orderBy(F.desc("rank_score"), doc).limit(k)


def rrf(lists: Mapping[str, DataFrame], id_col: str, rank: str = "rank", keys: Sequence[str] = (), k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``rank`` counts from 1): sum of 1/(k + rank)."""
    parts = [
        df.select(*keys, id_col, F.col(rank).alias("_r"), F.lit(name).alias("_s"), F.lit(i).alias("_o"))
        for i, (name, df) in enumerate(lists.items())
    ]
    merged = reduce(lambda a, b: a.unionByName(b), parts)
    return merged.groupBy(*keys, id_col).agg(
        F.sum(1.0 / (k + F.col("_r"))).alias("rrf_score"),
        F.array_sort(F.collect_list(F.struct("_o", "_s")))["_s"].alias("sources"),
    )


def fused_top(fused: DataFrame, keys: Sequence[str], id_col: str, k: int) -> DataFrame:
    return ordered.top_k(fused, keys, k, F.round("rrf_score", 12).desc(), F.asc(id_col))
