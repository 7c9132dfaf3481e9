"""Importance resampling towards a target: documents whose n-grams are more usual in the target are drawn more often.

Every batch of texts is interned in an open-addressed table held in numpy arrays. The key of a slot is the xxhash64 of an
n-gram's bytes, and a slot is taken as the n-gram's own only if the bytes are equal too; beside the key it stores the
n-gram's bucket and count. The first pass adds the counts of slots up by bucket, for the source and for the target. The
second keeps the slot of each occurrence and gathers the bucket's gain through it, so a document's weight is a mean over
gathered numbers.

Drawing is Gumbel top-k without replacement: noise from a hash of the id is added to the weight, and the largest scores
are drawn. Scores are whole numbers whose noise spreads any text's copies, so a histogram of scores gives every score the
number of rows before it, and a row's rank is that plus its place among the rows of the same score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common

WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Occurrences interned at once: bounds the table whatever the length of a text.
OCCURRENCES = 1 << 17
#: Bytes of words after lower-casing: digits, a to z, and everything outside ASCII; all others become blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Interned:
    """The distinct n-grams of some spans (start, end) of ``data`` and the slot of every occurrence.

    ``slot`` has one entry per span; ``used`` lists the filled slots, and ``bucket`` and ``count`` are by slot.
    """

    def __init__(self, data: bytes, start: np.ndarray, end: np.ndarray, buckets: int):
        from xxhash import xxh64_intdigest

        size = end - start
        spans = list(zip(start.tolist(), end.tolist(), strict=True))
        key = np.fromiter((xxh64_intdigest(data[s:e]) for s, e in spans), np.uint64, len(spans))
        slots = 1 << max(4, (2 * len(spans) - 1).bit_length())
        padded = np.frombuffer(data + bytes(8), np.uint8)
        eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each position on
        owner = np.full(slots, -1, np.int64)  # the first occurrence of the slot's n-gram
        self.slot = np.zeros(len(spans), np.int64)
        at = (key & np.uint64(slots - 1)).astype(np.int64)
        waiting = np.arange(len(spans))
        while len(waiting):
            here = at[waiting]
            free = owner[here] < 0
            # Of the occurrences that want a free slot, the earliest takes it.
            owner[here[free][::-1]] = waiting[free][::-1]
            first = owner[here]
            same = (key[waiting] == key[first]) & (size[waiting] == size[first])
            self._verify(same, waiting, first, eight, start, size)
            self.slot[waiting[same]] = here[same]
            waiting = waiting[~same]
            at[waiting] = (at[waiting] + 1) & (slots - 1)
        self.used = np.flatnonzero(owner >= 0)
        self.bucket = np.zeros(slots, np.int64)
        self.count = np.bincount(self.slot, minlength=slots) if len(spans) else np.zeros(slots, np.int64)
        for slot, one in zip(self.used.tolist(), owner[self.used].tolist(), strict=True):
            s, e = spans[one]
            self.bucket[slot] = zlib.crc32(data[s:e]) % buckets

    @staticmethod
    def _verify(same, waiting, first, eight, start, size) -> None:
        """Take back ``same`` where the bytes differ, eight at a time."""
        left = np.flatnonzero(same & (waiting != first))
        for k in range(0, int(size[waiting[left]].max()) if len(left) else 0, 8):
            rest = size[waiting[left]] - k
            left, rest = left[rest > 0], rest[rest > 0]
            mask = np.where(rest >= 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * np.minimum(rest, 7).astype(np.uint64))) - np.uint64(1))
            a, b = eight[start[waiting[left]] + k] & mask, eight[start[first[left]] + k] & mask
            same[left[a != b]] = False
            left = left[a == b]


def interned(texts: list[str | None], words: int, buckets: int):
    """(words per text, features per text, iterator of (text of each occurrence, table)).

    A text's features are its runs of 1 to ``words`` consecutive words, joined by one space; runs never cross texts.
    """
    split = [t.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if t else [] for t in texts]
    of = np.repeat(np.arange(len(split)), [len(s) for s in split])
    flat = [w for s in split for w in s]
    length = np.fromiter(map(len, flat), np.int64, len(flat))
    start = np.concatenate([[0], np.cumsum(length + 1)])[:-1].astype(np.int64)
    data = b" ".join(flat)
    features = np.zeros(len(texts), np.int64)
    parts = []
    for n in range(1, words + 1):
        inside = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :]) if len(of) >= n else np.empty(0, np.int64)
        features += np.bincount(of[inside], minlength=len(texts))
        parts += [(n, inside[k : k + OCCURRENCES]) for k in range(0, len(inside), OCCURRENCES)]

    def tables():
        for n, at in parts:
            low = int(start[at[0]])
            high = int(start[at[-1] + n - 1] + length[at[-1] + n - 1])
            yield of[at], Interned(data[low:high], start[at] - low, start[at + n - 1] + length[at + n - 1] - low, buckets)

    return np.array([len(s) for s in split], np.int64), features, tables()


def bucket_counts(docs: DataFrame, text_col="text", words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of all n-grams of all texts by bucket, buckets without any left out."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, table in interned(batch.column("text").to_pylist(), words, buckets)[2]:
                total += np.bincount(table.bucket[table.used], table.count[table.used], buckets).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    texts = docs.select(docs[text_col].cast("string").alias("text"))
    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain), one row per bucket: floor of 1000 times the log ratio of the smoothed target and source shares."""
    spark = source.sparkSession
    source, target = session.durable(source), session.durable(target)
    all_s, all_t = (side.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for side in (source, target))
    rows = spark.range(buckets).withColumnRenamed("id", "bucket")
    rows = rows.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    rows = rows.fillna(0, ["s", "t"])
    ratio = ((F.col("t") + 1) * (all_s + buckets)).cast("double") / ((F.col("s") + 1) * (all_t + buckets)).cast("double")
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gains: DataFrame, id_col="doc_id", text_col="text", words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of a document's features, 0 without any.

    ``gains`` has one row per bucket: its size is the parameter ``buckets``, whatever the corpus, and it goes to tasks.
    """
    spark = docs.sparkSession
    table = np.zeros(buckets, np.int64)
    for row in gains.collect():  # bounded by ``buckets``
        table[row["bucket"]] = row["gain"]
    sent = spark.sparkContext.broadcast(table)

    def weigh(batches):
        gain = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_words, features, tables = interned(texts, words, buckets)
            total = np.zeros(len(texts), np.int64)
            for of, one in tables:
                gathered = gain[one.bucket[one.slot]]
                edge = np.flatnonzero(np.diff(of, prepend=-1))  # occurrences of a text lie together
                total[of[edge]] += np.add.reduceat(gathered, edge)
            mean = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words), pa.array(features), pa.array(mean)], ["id", "n_words", "n_features", "weight"]
            )

    return common.text_rows(docs, id_col, text_col).mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED):
    """floor of 1000 times a Gumbel variate made from the first 8 hex digits of sha256(seed:id)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` (a written table) with ``rank`` 1, 2, ... for the drawn rows, null for the others.

    Ties of scores go to the smaller id, a null id after all others. The histogram has one row per score: a few ten
    thousand whatever the corpus, as gains and noise are logarithms. Only rows whose score can be drawn are sorted.
    """
    counts = scored.filter(F.col("n_words") >= least_words).groupBy("score").agg(F.count("*").alias("rows"))
    counts = session.durable(counts)
    draw = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] * percent // 100
    before = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    carried = session.durable(counts.select("score", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier")))
    placed = scored.join(session.broadcast_if_small(carried), "score", "left")
    can = (F.col("n_words") >= least_words) & (F.coalesce("earlier", F.lit(draw)) < draw)
    inside = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")
    rank = F.col("earlier") + F.row_number().over(inside)
    drawn = placed.filter(can).withColumn("rank", F.when(rank <= draw, rank))
    rest = placed.filter(~can).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("id", "n_words", "n_features", "weight", "score", "rank")


def resampled(
    docs: DataFrame, target: DataFrame, id_col="doc_id", text_col="text", target_col="text", words: int = WORDS,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank), one row per input row; ``rank`` is null where not drawn.

    Drawn are floor(percent / 100 * N) of the N rows with ``least_words`` words or more. Null and empty texts have no
    features and weigh 0; such rows are never drawn unless ``least_words`` is 0. A text of any length is counted whole,
    its occurrences interned in parts. Repeated rows count as often as they stand there and share a score; equal
    scores go to the smaller id. A null id hashes as an empty one and comes last among equals. Empty tables give no rows;
    an empty target leaves its smoothed, even shares. Other columns are not read.
    """
    common.prepare(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, text_col, words, buckets), bucket_counts(target, target_col, words, buckets), buckets)
    weighed = weights(docs, gains, id_col, text_col, words, buckets)
    scored = session.durable(weighed.withColumn("score", F.col("weight") + noise(seed)))
    return ranked(scored, least_words, percent)
