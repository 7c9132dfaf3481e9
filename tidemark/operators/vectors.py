"""Vector search: exact top-k for a bounded query set, exact k-NN join, collection verbs.

Spark partitions and shuffles the vectors; numpy compares blocks of them inside tasks and only the best
``k`` per query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.session import broadcast_if_small, by_key, durable

MAX_QUERIES = 20000
BLOCK_ROWS = 40000
#: Queries compared at once, and groups of members whose best scores are looked at first.
STEP, GROUPS = 512, 500


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _scores(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Larger is better for both metrics; vectors are unit length for cosine."""
    if metric == "cosine":
        return queries @ corpus.T
    squares = (queries**2).sum(1)[:, None] + (corpus**2).sum(1)[None, :] - 2 * queries @ corpus.T
    return -np.sqrt(np.maximum(squares, 0.0))


def _plain_candidates(q: np.ndarray, m: np.ndarray, take: int, metric: str):
    """(row, column, score) of the ``take`` best members of every query in double precision, ties by smaller column."""
    rows, columns, found = [], [], []
    for at in range(0, len(q), 64):
        table = _scores(q[at : at + 64], m, metric)
        rounded = np.nan_to_num(np.round(table, 12), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        last = -np.partition(-rounded, take - 1, axis=1)[:, take - 1]
        for n, (line, limit) in enumerate(zip(rounded, last)):
            better = np.flatnonzero(line > limit)
            picked = np.concatenate([better, np.flatnonzero(line == limit)[: take - len(better)]])
            rows.append(np.full(len(picked), at + n))
            columns.append(picked)
            found.append(table[n, picked])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(found)


def _candidates(q: np.ndarray, m: np.ndarray, take: int, metric: str):
    """(row, column, score) that hold the ``take`` best members of every query and few others, ties by smaller column.

    Scores are first taken in single precision for cosine; what may be among the best, by the bound of its rounding,
    is scored again in double precision. The best of each group of members tells which groups to look into. Queries
    with very many members at the limit (crowds of equal vectors) take the plain way.
    """
    take, dim = min(take, len(m)), m.shape[1]
    groups = max(GROUPS, 4 * take)
    if len(m) < 4 * groups or not (np.isfinite(q).all() and np.isfinite(m).all()):
        return _plain_candidates(q, m, take, metric)
    fast = metric == "cosine"
    narrow, margin = (m.astype(np.float32), 2.5e-7 * (dim + 4)) if fast else (m, 1e-11)
    width = len(m) // groups
    parts = []
    for at in range(0, len(q), STEP):
        some = q[at : at + STEP]
        table = some.astype(np.float32) @ narrow.T if fast else _scores(some, narrow, metric)
        best = table[:, :groups].copy()
        for i in range(1, width):
            np.maximum(best, table[:, i * groups : (i + 1) * groups], out=best)
        limit = np.partition(best, groups - take, axis=1)[:, groups - take] - margin
        open_groups = best >= limit[:, None]
        crowded = open_groups.sum(1) > 8 * take
        open_groups[crowded] = False
        rows, group = np.nonzero(open_groups)
        columns = group[:, None] + groups * np.arange(width)[None, :]
        hit, inside = np.nonzero(table[rows[:, None], columns] >= limit[rows, None])
        rest_rows, rest = np.nonzero((table[:, groups * width :] >= limit[:, None]) & ~crowded[:, None])
        rows = np.concatenate([rows[hit], rest_rows])
        columns = np.concatenate([columns[hit, inside], rest + groups * width])
        crowded |= np.bincount(rows, minlength=len(some)) > 32 * take
        keep = ~crowded[rows]
        rows, columns = rows[keep], columns[keep]
        found = np.einsum("ij,ij->i", some[rows], m[columns]) if fast else table[rows, columns]
        parts.append((rows + at, columns, found))
        if crowded.any():
            slow = np.flatnonzero(crowded)
            rows, columns, found = _plain_candidates(some[slow], m, take, metric)
            parts.append((slow[rows] + at, columns, found))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of each row, ties by smaller id. Scores are compared at 12 digits so that blocking cannot reorder ties."""
    order = np.lexsort((ids, -np.round(scores, 12), rows))
    rows = rows[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    order = order[place < k]
    return rows[place < k], ids[order], scores[order]


def _nearest(
    names: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, metric: str,
    min_score: float | None, exclude_self: bool,
):
    """(row, id, score): the k best members of every query; vectors are unit length for cosine."""
    if len(names) == 0 or len(ids) == 0:
        return np.array([], dtype=np.int64), ids[:0], np.array([])
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    own = np.unique(ids, return_counts=True)[1].max() if exclude_self else 0  # members that may bear a query's name
    rows, columns, scores = _candidates(q, m, k + int(own), metric)
    keep = names[rows] != ids[columns] if exclude_self else np.ones(len(rows), bool)
    if min_score is not None:
        keep &= scores >= min_score
    return _best(rows[keep], ids[columns[keep]], scores[keep], k)


def search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    corpus_id: str,
    corpus_vector: str,
    query_id: str,
    query_vector: str,
    metric: str = "cosine",
    min_score: float | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """Top ``k`` of the corpus per query: (query_id, id, score, rank), ``score`` being similarity or distance.

    The query set is counted first. Up to ``MAX_QUERIES`` travel to the tasks and the corpus is scanned in
    place, without a shuffle; a larger set goes through :func:`knn_join`'s block layout.
    """
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        return _block_join(
            corpus.select(F.col(corpus_id).alias("id"), F.col(corpus_vector).alias("v")),
            queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("qv")),
            k, metric, min_score, exclude_self, None,
        )
    id_type = corpus.schema[corpus_id].dataType.simpleString()
    query_type = queries.schema[query_id].dataType.simpleString()
    q = queries.select(F.col(query_id).alias("i"), F.col(query_vector).alias("v")).toPandas()
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast((q["i"].to_numpy(), _matrix(q["v"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, qm = shared.value
        if len(names) == 0:
            return
        if metric == "cosine":
            qm = _unit(qm)
        kept = None
        for batch in batches:
            if len(batch) == 0:
                continue
            m = _matrix(batch["v"])
            m = _unit(m) if metric == "cosine" else m
            new = _nearest(names, qm, batch["i"].to_numpy(), m, k, metric, min_score, exclude_self)
            kept = new if kept is None else _best(*(np.concatenate(pair) for pair in zip(kept, new)), k)
        if kept is not None and len(kept[0]):
            rows, ids, scores = kept
            yield pd.DataFrame({"query_id": names[rows], "id": ids, "score": scores})

    found = corpus.select(F.col(corpus_id).alias("i"), F.col(corpus_vector).alias("v")).mapInPandas(
        scan, f"query_id {query_type}, id {id_type}, score double"
    )
    return _ranked(found, k, metric)


def _ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    best = ordered.top_k(found, ["query_id"], k, F.round("score", 12).desc(), F.asc("id"))
    return best if metric == "cosine" else best.withColumn("score", -F.col("score"))


def knn_join(
    df: DataFrame, id_col: str, vector: str, k: int, metric: str = "cosine",
    min_score: float | None = None, pivots: int | None = None,
) -> DataFrame:
    """Exact ``k`` nearest other rows of every row."""
    corpus = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    queries = df.select(F.col(id_col).alias("query_id"), F.col(vector).alias("qv"))
    return _block_join(corpus, queries, k, metric, min_score, True, pivots)


@dataclass
class _Cells:
    centres: np.ndarray
    low: np.ndarray  # nearest and farthest member of each cell
    high: np.ndarray
    near: list[np.ndarray]  # the smallest member distances of each cell


def _block_join(
    corpus: DataFrame, queries: DataFrame, k: int, metric: str, min_score: float | None,
    exclude_self: bool, pivots: int | None,
) -> DataFrame:
    """Cells around pivot vectors bound the distances (triangle inequality), so far cells are skipped.

    A bound on the k-th neighbour distance of each query comes from per-cell summaries, the query is sent
    only to cells that can hold something nearer, and large cells and their visitors are cut into blocks,
    so no task sees more than about BLOCK_ROWS of either side however uneven the cells are.
    """
    spark = corpus.sparkSession
    id_type, vector_type = (corpus.schema[c].dataType.simpleString() for c in ("id", "v"))
    query_type, asked_type = (queries.schema[c].dataType.simpleString() for c in ("query_id", "qv"))
    total = corpus.count()
    if total == 0:
        return spark.createDataFrame([], f"query_id {query_type}, id {id_type}, score double, rank int")
    n_pivots = pivots or max(1, min(1024, total // BLOCK_ROWS))
    picked = corpus.orderBy(F.xxhash64("id"), "id").limit(n_pivots).toPandas()
    centres = _matrix(picked["v"])
    centres = _unit(centres) if metric == "cosine" else centres
    shared = spark.sparkContext.broadcast(centres)
    wanted = k + 1 if exclude_self else k

    def distances(m: np.ndarray) -> np.ndarray:
        c = shared.value
        squares = (m**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * m @ c.T
        return np.sqrt(np.maximum(squares, 0.0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                m = _matrix(batch["v"])
                d = distances(_unit(m) if metric == "cosine" else m)
                cell = d.argmin(1)
                yield pd.DataFrame(
                    {"id": batch["id"], "v": batch["v"], "cell": cell, "d": d[np.arange(len(d)), cell]}
                )

    placed = corpus.mapInPandas(assign, f"id {id_type}, v {vector_type}, cell int, d double")
    if n_pivots > 1:
        placed = durable(placed)
    # One summary row per cell and at most k+1 distances per cell: bounded by the pivot count.
    near = ordered.top_k(placed.select("cell", "d"), ["cell"], wanted, F.asc("d"), rank="r")
    summary = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")
    ).join(near.groupBy("cell").agg(F.sort_array(F.collect_list("d")).alias("near")), "cell").toPandas()
    low, high = np.full(n_pivots, np.inf), np.full(n_pivots, -np.inf)
    closest: list[np.ndarray] = [np.array([])] * n_pivots
    sizes = {}
    for row in summary.itertuples():
        low[row.cell], high[row.cell] = row.low, row.high
        closest[row.cell] = np.asarray(row.near)
        sizes[int(row.cell)] = int(row.n)
    cells = spark.sparkContext.broadcast(_Cells(centres, low, high, closest))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        info = cells.value
        for batch in batches:
            if len(batch) == 0:
                continue
            m = _matrix(batch["qv"])
            d = distances(_unit(m) if metric == "cosine" else m)
            upper = np.concatenate(
                [d[:, [c]] + info.near[c][None, :] for c in range(len(info.near)) if len(info.near[c])], axis=1
            )
            take = min(wanted, upper.shape[1]) - 1
            limit = np.partition(upper, take, axis=1)[:, take] if upper.shape[1] >= wanted else np.full(len(d), np.inf)
            nearest = np.maximum(np.maximum(d - info.high[None, :], info.low[None, :] - d), 0.0)
            rows, targets = np.nonzero(nearest <= limit[:, None] + 1e-9)
            yield pd.DataFrame(
                {
                    "query_id": batch["query_id"].to_numpy()[rows],
                    "qv": batch["qv"].to_numpy()[rows],
                    "cell": targets.astype("int32"),
                }
            )

    visits = queries.mapInPandas(visit, f"query_id {query_type}, qv {asked_type}, cell int")
    if n_pivots > 1:
        visits = durable(visits)
    visit_counts = {int(r["cell"]): int(r["n"]) for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    layout = [
        (c, -(-sizes[c] // BLOCK_ROWS), -(-visit_counts.get(c, 0) // BLOCK_ROWS) or 1) for c in sizes
    ]
    blocks = F.broadcast(spark.createDataFrame(layout, "cell int, parts int, visit_parts int"))

    def pieces(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    left = (
        placed.join(blocks, "cell")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("visit_part", pieces("visit_parts"))
        .select("cell", "part", "visit_part", "id", "v")
    )
    right = (
        visits.join(blocks, "cell")
        .withColumn("visit_part", F.pmod(F.xxhash64("query_id"), F.col("visit_parts")).cast("int"))
        .withColumn("part", pieces("parts"))
        .select("cell", "part", "visit_part", "query_id", "qv")
    )

    def compare(members: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "id": [], "score": []})
        if len(members) == 0 or len(visitors) == 0:
            return empty
        m, q, names = _matrix(members["v"]), _matrix(visitors["qv"]), visitors["query_id"].to_numpy()
        if metric == "cosine":
            m, q = _unit(m), _unit(q)
        rows, ids, scores = _nearest(names, q, members["id"].to_numpy(), m, k, metric, min_score, exclude_self)
        return pd.DataFrame({"query_id": names[rows], "id": ids, "score": scores})

    keys = ["cell", "part", "visit_part"]
    found = by_key(left, *keys).groupBy(*keys).cogroup(by_key(right, *keys).groupBy(*keys)).applyInPandas(
        compare, f"query_id {query_type}, id {id_type}, score double"
    )
    return _ranked(found, k, metric)


def insert(table: DataFrame, rows: DataFrame, vector: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(table with the valid rows, one-row count of inserted and failed); wrong dimensions fail."""
    valid = F.size(vector) == dimension
    counts = rows.agg(F.count_if(valid).alias("inserted"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("failed"))
    return table.unionByName(rows.filter(valid), allowMissingColumns=True), counts


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace stored ones with the same key."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(
        rows, allowMissingColumns=True
    )


def delete(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), list(on), "left_anti")


def retrieve(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(broadcast_if_small(keys.select(*on).distinct()), list(on), "left_semi")


def dimension_of(df: DataFrame, vector: str) -> DataFrame:
    """Each vector length with its row count; a clean collection has one row."""
    return df.groupBy(F.size(vector).alias("dimension")).agg(F.count(F.lit(1)).alias("n"))


def neighbour_patterns(neighbours: DataFrame, payload: DataFrame, id_col: str, cause: str, ip: str, ts: str) -> DataFrame:
    """Per query: dominant cause, subnet recurrence (3 in one /24), earliest sighting, confidence.

    ``neighbours`` holds at most k rows per query, so its groups are small whatever the data. It is written once: the
    search behind it costs far more than the three groupings that read it.
    """
    neighbours = durable(neighbours)
    rows = neighbours.join(payload.withColumnRenamed(id_col, "id"), "id", "left")
    rows = rows.withColumn("_cause", F.coalesce(F.col(cause), F.lit("Unknown")))
    rows = rows.withColumn("_net", F.when(F.size(F.split(ip, r"\.")) == 4, F.substring_index(ip, ".", 3)))
    causes = rows.groupBy("query_id", "_cause").agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_first"))
    dominant = causes.groupBy("query_id").agg(
        F.max_by("_cause", F.struct("_n", -F.col("_first"))).alias("dominant_root_cause")
    )
    nets = rows.groupBy("query_id", "_net").agg(F.count("_net").alias("_m"))
    recurring = nets.groupBy("query_id").agg((F.max("_m") >= 3).alias("recurrence_detected"))
    base = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("recurrence_count"), F.min(ts).alias("first_seen")
    )
    out = base.join(dominant, "query_id").join(recurring, "query_id")
    score = 0.4 + F.col("recurrence_count") / 10 * 0.4 + F.when(F.col("recurrence_detected"), 0.2).otherwise(0.0)
    return out.withColumn("confidence", F.least(F.lit(1.0), score))


def large_enough(df: DataFrame, minimum: int = 10) -> bool:
    """Whether a collection has enough rows for its neighbours to mean something; the caller decides what follows."""
    return df.limit(minimum).count() >= minimum
