"""Stored tree ensembles: a node table, models that give one, and scoring.

A node is a row (tree, node, feature, threshold, left, right, missing, leaf): an inner node sends a row left where the
feature is at most the threshold, and names the child of rows without a value; a leaf has no feature and carries its
output. The score of a row is the base score plus the leaves it reaches. The table's size is the model's, whatever the
number of rows: it goes to the tasks, where all rows of a batch step down one level of all trees at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators.quantiles import quantiles
from tidemark.session import configure, durable

NODE_SCHEMA = "tree int, node int, feature string, threshold double, left int, right int, missing int, leaf double"
#: Nodes of a model that may be sent to the tasks: tens of megabytes.
MOST_NODES = 1_000_000


class Ensemble:
    """The node table as arrays: children of node i are ``go[:, i]``, leaves point to themselves."""

    def __init__(self, nodes: list, features: Sequence[str], base: float):
        place = {(r["tree"], r["node"]): i for i, r in enumerate(nodes)}
        at = {f: i for i, f in enumerate(features)}
        count = len(nodes)
        self.base = base
        self.feature, self.threshold, self.leaf = np.zeros(count, np.int64), np.zeros(count), np.zeros(count)
        self.left, self.right, self.missing = (np.arange(count) for _ in range(3))
        self.roots = np.array(sorted(place[t, min(n for s, n in place if s == t)] for t in {t for t, _ in place}), np.int64)
        for i, r in enumerate(nodes):
            if r["feature"] is None:
                self.leaf[i] = r["leaf"]
                continue
            self.feature[i], self.threshold[i] = at[r["feature"]], r["threshold"]
            for side in ("left", "right", "missing"):
                child = r[side] if r[side] is not None else r["right"]
                getattr(self, side)[i] = place[r["tree"], child]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of the rows of ``x``; nan is a missing value."""
        now = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while True:
            value = x[rows, self.feature[now]]
            step = np.where(np.isnan(value), self.missing[now], np.where(value <= self.threshold[now], self.left[now], self.right[now]))
            if (step == now).all():
                return self.base + self.leaf[now].sum(axis=1)
            now = step


def ensemble_scores(df: DataFrame, nodes: DataFrame, features: Sequence[str], out: str = "score", base: float = 0.0) -> DataFrame:
    """Add the ensemble's score of each row. Null and nan features follow the nodes' missing branch."""
    spark = configure(df.sparkSession)
    stored = nodes.orderBy("tree", "node").limit(MOST_NODES + 1).collect()  # the model, of checked size
    if len(stored) > MOST_NODES:
        raise ValueError(f"a model of more than {MOST_NODES} nodes: score its trees in parts and add the scores up")
    sent = spark.sparkContext.broadcast(Ensemble(stored, features, base))
    names = [f"_x{i}" for i in range(len(features))]
    rows = df.withColumns({n: F.col(f).cast("double") for n, f in zip(names, features)})

    def walk(batches):
        model = sent.value
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names])
            kept = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.scores(x))], [*kept, out])

    return rows.mapInArrow(walk, StructType([*df.schema.fields, StructField(out, DoubleType())]))


def probability(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def flagged(df: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    """Add ``<score>_flag``: whether the probability passes the threshold."""
    return df.withColumn(f"{score}_flag", probability(F.col(score)) > threshold)


def sequence_scores(df: DataFrame, doc: str, score: str) -> DataFrame:
    """(doc, score, rows): the largest score of a document's rows, combined before the shuffle, and their number."""
    return df.groupBy(doc).agg(F.max(score).alias(score), F.count(F.lit(1)).alias("rows"))


def fit_oblivious(
    df: DataFrame, features: Sequence[str], target: str, depth: int = 3, trees: int = 6, rate: float = 0.5
) -> DataFrame:
    """Node table of an ensemble of oblivious trees fitted by aggregates: all nodes of a level ask the same question.

    Tree t asks about ``depth`` features in turn, at quantiles spread over their values; boosting is by rounds: a tree's
    leaf is ``rate`` times the mean of what the trees before it left of the target in its cell, shrunk by one row. Each
    round is one pass with a map-side combined aggregate of at most 2 ** depth groups. Nodes are numbered from 1, the
    children of n are 2 n and 2 n + 1; missing values go right. Thresholds are rounded to 6 digits.
    """
    spark = df.sparkSession
    rows = durable(df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_left")))
    asked = [[features[(t + level) % len(features)] for level in range(depth)] for t in range(trees)]
    shares = [[(t + 1 + level * trees) / (trees * depth + 1) for level in range(depth)] for t in range(trees)]
    cuts = {}
    for f in features:
        wanted = {f"q_{t}_{level}": shares[t][level] for t in range(trees) for level in range(depth) if asked[t][level] == f}
        if wanted:
            cuts |= quantiles(rows, [], f, wanted).first().asDict()
    nodes = []
    for t in range(trees):
        limits = [round(cuts[f"q_{t}_{level}"], 6) for level in range(depth)]
        cell = F.lit(1)
        for f, cut in zip(asked[t], limits):
            cell = cell * 2 + F.when(F.coalesce(F.nanvl(F.col(f), F.lit(math.inf)), F.lit(math.inf)) <= cut, 0).otherwise(1)
        placed = rows.withColumn("_cell", cell)
        sums = placed.groupBy("_cell").agg(F.sum("_left").alias("s"), F.count("_left").alias("n")).collect()  # 2 ** depth rows
        leaves = {r["_cell"]: rate * (r["s"] or 0.0) / (r["n"] + 1) for r in sums}
        first = 1 << depth
        for n in range(1, first):
            level = n.bit_length() - 1
            nodes.append((t, n, asked[t][level], float(limits[level]), 2 * n, 2 * n + 1, 2 * n + 1, None))
        nodes += [(t, n, None, None, None, None, None, float(leaves.get(n, 0.0))) for n in range(first, 2 * first)]
        value = reduce(lambda c, kv: c.when(F.col("_cell") == kv[0], kv[1]), leaves.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
        if t + 1 < trees:
            rows = placed.withColumn("_left", F.col("_left") - value).drop("_cell")
    return durable(spark.createDataFrame(nodes, NODE_SCHEMA))


def from_spark_ml(model, features: Sequence[str]) -> DataFrame:
    """Node table of a fitted Spark ML tree or tree ensemble with continuous features; a tree's weight goes into its leaves.

    Spark sends values without a number right; forests of regressors average their trees.
    """
    trees = list(getattr(model, "trees", [model]))
    weights = list(getattr(model, "treeWeights", [1.0]))
    share = 1.0 / len(trees) if type(model).__name__.startswith("RandomForest") else 1.0
    rows = []

    def add(tree: int, node, number: int) -> None:
        if node.subtreeDepth() == 0:
            rows.append((tree, number, None, None, None, None, None, float(node.prediction()) * weights[tree] * share))
            return
        split = node.split()
        if not hasattr(split, "threshold"):
            raise ValueError("categorical splits have no threshold; index and encode such features first")
        rows.append((tree, number, features[split.featureIndex()], float(split.threshold()), 2 * number, 2 * number + 1, 2 * number + 1, None))
        add(tree, node.leftChild(), 2 * number)
        add(tree, node.rightChild(), 2 * number + 1)

    for t, tree in enumerate(trees):
        add(t, tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree._call_java("rootNode"), 1)
    spark = SparkSession.getActiveSession()
    return durable(spark.createDataFrame(rows, NODE_SCHEMA))
