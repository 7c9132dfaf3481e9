"""A training corpus from ``documents``: identify, deduplicate, mix, encode.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a table. Every stage is written as
Parquet and read again as the next one's input, so a lost executor never costs more than the stage that runs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common, exact, language, mixing, neardup, pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Language identification and sampling can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
VOCABULARY = "piece_bpe_32k.model"


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; ``lang`` becomes the identified one.

    The filter is learnt from the labelled rows of the stage's input, the text alone decides. Rejected are texts
    without a letter (null and empty ones too) and texts of which no language holds a tenth of the n-grams.
    """
    common.prepare(spark)
    model = language.fit(docs.filter(F.col("lang").isNotNull()))
    found = language.identified_rows(docs, model, COLUMNS)
    found = found.filter((F.col("lang_pred") != language.UNDECIDED) & (F.col("coverage") >= 0.1))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest doc_id."""
    return exact.exact_dedup(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id."""
    return neardup.near_dedup(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them as a whole; those it doesn't take, or takes less than half of, go."""
    common.prepare(spark)
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampled segmentation of each document for training, with the scores of the others drawn beside it."""
    common.prepare(spark)
    drawn = pieces.sampled(docs, public_tokenizers.path(VOCABULARY))
    each = lambda name: F.transform("samples", lambda s: s[name]).alias(name)
    return drawn.select(
        F.col("id").alias("doc_id"), F.col("samples")[0]["ids"].alias("ids"),
        each("n_tokens"), each("ids_crc32"), each("log_prob"), each("inclusion"), "round_trip",
    )


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = session.durable(stage(spark, docs, sf_dir))
    return docs
