"""Hybrid retrieval: a stored inverted index with BM25, entities shared by documents, and fusion of four lists.

The index is three tables: counts (token, doc, tf, length), written where a document's tokens are counted, each file in order
of token, so that a query's terms touch few row groups; terms (token, docs); and one row of totals. All counts are never
shuffled: those of the tokens a batch of queries asks for are picked by a broadcast of these tokens, and only they move.
Queries are a table too: many are answered at once, and their scores are added up where a document's counts are, so that
the pairs of query and document, which grow with the square of the collection, are neither shuffled nor written.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ordered, search
from tidemark.session import broadcast_if_small, durable, scratch_dir

#: Saturation of term counts and weight of document length in BM25.
K1, B = 1.2, 0.75
#: Postings of one Arrow batch, and how many tokens, one short column, may be broadcast.
BATCH_POSTINGS, BROADCAST_TOKENS = 200_000, 1_000_000
#: Postings that are scored together, scores that are added up at once, and tasks for each core at most.
BLOCK_POSTINGS, BLOCK_HITS, CORE_TASKS = 500_000, 1_000_000, 8
#: Digits at which scores are compared.
DIGITS = 9


@dataclass
class Index:
    counts: DataFrame  # token, doc, tf, length
    terms: DataFrame  # token, docs
    documents: int
    mean_length: float

    @property
    def postings(self) -> DataFrame:
        """(token, doc, tf, length, docs): each count with the number of documents that hold its token."""
        return self.counts.join(self.terms, "token").select("token", "doc", "tf", "length", "docs")


def count_tokens(df: DataFrame) -> DataFrame:
    """(token, doc, tf, length) of each row of (doc, text), counted where the row is; tokens as ``search.tokens`` gives."""
    word = re.compile(search.WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            docs = batch.column(0).take(pa.array(at, pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.string()), docs, pa.array(tf, pa.int64()), pa.array(lengths, pa.int64())], ["token", "doc", "tf", "length"]
            )

        for batch in batches:
            tokens, at, tf, lengths = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = word.findall(text)
                counts = Counter(found)
                tokens += counts.keys()
                tf += counts.values()
                at += [row] * len(counts)
                lengths += [len(found)] * len(counts)
                if len(tokens) >= BATCH_POSTINGS:
                    yield flush()
                    tokens, at, tf, lengths = [], [], [], []
            if tokens:
                yield flush()

    doc_type = df.schema["doc"].dataType.simpleString()
    rows = df.select("doc", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.mapInArrow(run, f"token string, doc {doc_type}, tf bigint, length bigint")


def document_tokens(rows: DataFrame) -> DataFrame:
    """``count_tokens`` by document: rows of an id that comes more than once are added up, the others pass as they are."""
    repeated = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc")
    repeated = durable(repeated)
    if repeated.limit(1).count() == 0:
        return count_tokens(rows)
    repeated = broadcast_if_small(repeated)
    counted = durable(count_tokens(ordered._null_safe(rows, repeated, ["doc"], "left_semi")).groupBy("token", "doc").agg(F.sum("tf").alias("tf")))
    lengths = counted.groupBy("doc").agg(F.sum("tf").alias("length"))
    added = ordered._null_safe(counted, lengths, ["doc"], "inner").select("token", "doc", "tf", "length")
    return count_tokens(ordered._null_safe(rows, repeated, ["doc"], "left_anti")).unionByName(added)


def build_index(df: DataFrame, doc: str, text: str, folder: str | None = None) -> Index:
    """Index of the texts, written below ``folder`` (a scratch folder by default). Null and empty texts have no postings
    but count as documents; a repeated id is one document of all its texts.

    Counts are written by the tasks that make them; only the numbers of documents are shuffled, by token.
    """
    spark = df.sparkSession
    folder = folder or scratch_dir(spark, "index")
    rows = document_tokens(df.select(F.col(doc).alias("doc"), F.col(text).alias("text")))
    rows.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{folder}/counts")
    counted = spark.read.parquet(f"{folder}/counts")
    counted.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).write.mode("overwrite").parquet(f"{folder}/terms")
    documents = df.select(F.col(doc).alias("doc")).distinct().agg(F.count(F.lit(1)).alias("documents"))
    totals = documents.join(counted.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")), F.lit(True))  # one row and one row
    totals.write.mode("overwrite").parquet(f"{folder}/totals")
    return load_index(spark, folder)


def load_index(spark: SparkSession, folder: str) -> Index:
    totals = spark.read.parquet(f"{folder}/totals").first()
    mean = totals["tokens"] / totals["documents"] if totals["documents"] else 0.0
    counts = spark.read.parquet(f"{folder}/counts").filter("doc is not null")
    return Index(counts, spark.read.parquet(f"{folder}/terms"), totals["documents"], mean or 1.0)


def query_terms(index: Index, queries: DataFrame, query: str, k: int) -> DataFrame:
    """(query, token): the k rarest terms, shared with some other document, of each query that is itself a document."""
    wanted = queries.select(F.col(query).alias("doc")).distinct()
    shared = index.counts.select("token", "doc").join(broadcast_if_small(wanted), "doc").join(index.terms.filter("docs > 1"), "token")
    return ordered.top_k(shared, ["doc"], k, F.asc("docs"), F.asc("token")).select(F.col("doc").alias(query), "token")


def counts_of(index: Index, tokens: DataFrame) -> DataFrame:
    """The counts of the distinct ``tokens`` (token). These are broadcast, in parts of bounded size: all other counts stay
    where they are."""
    parts = -(-tokens.count() // BROADCAST_TOKENS)
    if parts < 2:
        return index.counts.join(F.broadcast(tokens), "token", "left_semi")
    part = F.pmod(F.xxhash64("token"), F.lit(parts))
    found = [index.counts.filter(part == i).join(F.broadcast(tokens.filter(part == i)), "token", "left_semi") for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def bm25(index: Index, terms: DataFrame, query: str, k: int) -> DataFrame:
    """(query, doc, rank, score): the k best documents of each query for its ``terms`` (query, token), itself left out."""
    n = F.lit(index.documents)
    idf = F.log(1 + (n - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
    known = terms.join(index.terms, "token").filter(F.col(query).isNotNull())
    asked = durable(known.select(query, "token", "docs", idf.alias("idf")))
    passes = -(-asked.count() // BROADCAST_TOKENS)
    part = F.pmod(F.xxhash64(query), F.lit(max(passes, 1)))
    found = [_scored(index, asked.filter(part == i) if passes > 1 else asked, query, k) for i in range(max(passes, 1))]
    best = ordered.top_k(reduce(DataFrame.unionByName, found), [query], k, F.round("score", DIGITS).desc(), F.asc("doc"))
    return best.select(query, "doc", "rank", "score")


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, in order of row and rank; ties by smaller id."""
    order = np.lexsort((ids, -np.round(scores, DIGITS), rows))
    rows = rows[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], ids[order[first]], scores[order[first]]


def _scored(index: Index, asked: DataFrame, query: str, k: int) -> DataFrame:
    """(query, doc, score): of the documents of each task, the k best of each query of ``asked`` (query, token, docs, idf).

    The counts of the asked tokens are dealt by document, those that a task has of a document as one row with the tokens'
    numbers, and the queries, at most ``BROADCAST_TOKENS`` rows, go to all tasks. A task scores a bounded number of counts
    at a time and keeps k documents of each query, so what it holds grows neither with the collection nor with a common
    token, and what it gives not with the documents that a query meets.
    """
    spark = asked.sparkSession
    table = asked.toArrow().sort_by([(query, "ascending"), ("token", "ascending")])
    names, tokens = (table[c].combine_chunks().dictionary_encode() for c in (query, "token"))
    docs = np.zeros(len(tokens.dictionary), np.int64)
    docs[tokens.indices.to_numpy()] = table["docs"].to_numpy()
    shared = spark.sparkContext.broadcast(
        (names.dictionary, names.indices.to_numpy(), tokens.dictionary, tokens.indices.to_numpy(), table["idf"].to_numpy())
    )
    tasks = max(1, min(-(-int(docs.sum()) // BLOCK_POSTINGS), CORE_TASKS * spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-int(docs.sum()) // (BLOCK_POSTINGS * tasks)))
    query_type, doc_type = (df.schema[c].dataType.simpleString() for df, c in ((asked, query), (index.counts, "doc")))
    mean_length, block_postings, block_hits, digits = index.mean_length, BLOCK_POSTINGS, BLOCK_HITS, DIGITS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value[2]

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            token = table["token"]
            code = pc.index_in(token, value_set=tokens.cast(token.type)).to_numpy()
            _, first, at = np.unique(table["doc"].to_numpy(), return_index=True, return_inverse=True)
            order = np.lexsort((code, at))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(at))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (code, table["tf"].to_numpy())]
            own = [table[c].combine_chunks().take(pa.array(first)) for c in ("doc", "length")]
            return pa.RecordBatch.from_arrays([*own, *lists], ["doc", "length", "codes", "tf"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= block_postings:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    counts = counts_of(index, asked.select("token").distinct()).select("token", "doc", "tf", "length")
    packed = counts.mapInArrow(pack, f"doc {doc_type}, length bigint, codes array<int>, tf array<bigint>").repartition(tasks, "doc")
    packed = packed.select(F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("block"), "doc", "length", "codes", "tf")
    if blocks > 1:
        packed = packed.sortWithinPartitions("block")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            yield from ((block[a], batch.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if a < b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, row, _, code, idf = shared.value
        tokens = int(code.max(initial=-1)) + 1
        name, last = names.to_numpy(zero_copy_only=False), np.append(np.diff(row) != 0, True)[: len(row)]
        least, best = np.full(len(name), -np.inf), None
        for _, parts in groupby(pieces(batches), key=lambda p: p[0]):
            table = pa.Table.from_batches([part for _, part in parts])
            ids, at = np.unique(table["doc"].to_numpy(), return_inverse=True)
            held = pc.list_value_length(table["codes"]).to_numpy()
            found, tf = (table[c].combine_chunks().flatten().to_numpy() for c in ("codes", "tf"))
            damp = np.repeat(K1 * (1 - B + B * table["length"].to_numpy() / mean_length), held)
            order = np.argsort(found, kind="stable")
            at, weight = np.repeat(at, held)[order], (tf * (K1 + 1) / (tf + damp))[order]
            sizes = np.bincount(found, minlength=tokens)
            firsts, sizes = (np.cumsum(sizes) - sizes)[code], sizes[code]
            own = np.minimum(np.searchsorted(ids, name), len(ids) - 1)
            own[ids[own] != name] = -1
            # Queries whose hits are looked at together; all terms of a query are in one piece.
            piece = (np.cumsum(sizes) // block_hits)[last][row]
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(piece)]
            kept = [] if best is None else [best]
            for a, b in zip(cuts, cuts[1:]):
                n = sizes[a:b]
                hit = np.arange(n.sum()) + np.repeat(firsts[a:b] - (np.cumsum(n) - n), n)
                pairs, where = np.unique(np.repeat(row[a:b], n) * len(ids) + at[hit], return_inverse=True)
                scores = np.bincount(where, np.repeat(idf[a:b], n) * weight[hit], len(pairs))
                rows, members = np.divmod(pairs, len(ids))
                open_ = (members != own[rows]) & (np.round(scores, digits) >= least[rows])
                kept.append(_best(rows[open_], ids[members[open_]], scores[open_], k))
            best = _best(*(np.concatenate(x) for x in zip(*kept)), k)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(name)) >= k)
            least[full] = np.round(best[2][np.searchsorted(best[0], full, "right") - 1], digits)
        if best is not None and len(best[0]):
            rows, ids, scores = best
            yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), pa.array(ids, table["doc"].type), pa.array(scores)], [query, "doc", "score"])

    return packed.mapInArrow(run, f"`{query}` {query_type}, doc {doc_type}, score double")


def co_mentioned(index: Index, queries: DataFrame, query: str, k: int, most: int = 20) -> DataFrame:
    """(query, doc, rank, shared): documents two hops away over entities, by how many entities they share.

    An entity is a term of 2 to ``most`` documents: commoner ones say nothing and would be hubs, so a hop from one never
    meets more than ``most`` documents.
    """
    entities = index.terms.filter((F.col("docs") > 1) & (F.col("docs") <= most)).select("token")
    wanted = broadcast_if_small(queries.select(F.col(query)).distinct())
    first = durable(index.counts.join(wanted, F.col("doc") == F.col(query)).select(query, "token").join(entities, "token"))
    edges = counts_of(index, first.select("token").distinct()).select("token", "doc")
    second = edges.join(first, "token").filter(F.col("doc") != F.col(query))
    shared = second.groupBy(query, "doc").agg(F.count(F.lit(1)).alias("shared"))
    return ordered.top_k(shared, [query], k, F.desc("shared"), F.asc("doc")).select(query, "doc", "rank", "shared")


def alike(docs: DataFrame, queries: DataFrame, doc: str, query: str, columns: list[str], newest: str, k: int) -> DataFrame:
    """(query, doc, rank): the newest documents with the same values of ``columns`` as the query document.

    Each group of values is cut to its first k + 1 documents before queries meet it.
    """
    first = ordered.top_k(docs.select(F.col(doc).alias("doc"), *columns, newest), columns, k + 1, F.desc(newest), F.asc("doc"))
    asked = queries.select(query).distinct().join(docs.select(F.col(doc).alias(query), *columns), query)
    met = ordered._null_safe(asked, first.drop("rank"), columns, "inner").filter(F.col("doc") != F.col(query))
    return ordered.top_k(met, [query], k, F.desc(newest), F.asc("doc")).select(query, "doc", "rank")


def hybrid(lists: Mapping[str, DataFrame], query: str, k: int) -> DataFrame:
    """(query, doc, rank, rrf_score, sources): reciprocal rank fusion of ranked lists (query, doc, rank)."""
    fused = search.rrf({n: df.select(query, "doc", "rank") for n, df in lists.items()}, "doc", keys=[query])
    return search.fused_top(fused, [query], "doc", k)
