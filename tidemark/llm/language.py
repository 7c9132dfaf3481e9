"""Language identification with language-bitmask n-gram filters.

Training finds, for each language, the character n-grams that are about as common in it as in any other language.
They go into one bit-sliced Bloom filter: a table of slots, each a mask with one bit per language; an n-gram sets
its languages' bits in a few slots. A lookup ANDs the slots and returns all languages holding the n-gram at once.
A text's n-grams are counted per language bit; a language whose filter is fuller answers more by chance, so counts are
corrected by its false-positive rate before the largest decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common

N = 4
#: Slots of the filter: the power of two from ROOM for each n-gram of the fullest language, within these bounds; every
#: n-gram is held, so beyond them a filter answers more by chance, which the correction takes off. A slot has one word for
#: 64 languages (32 MB at the most).
LEAST_SLOTS, MOST_SLOTS, ROOM = 1 << 16, 1 << 22, 12
#: Slots per n-gram.
HASHES = 3
#: The filter is fitted on at most this many labelled documents per language, those first by a hash of their id.
SAMPLE_DOCS = 4000
#: An n-gram is held for a language that uses it at least this often, relative to the language that uses it most.
LIKE_MOST = 0.2
#: Cells that a language's labelled documents are counted in, by the order of the sample.
CELLS = 1 << 14
UNDECIDED = "und"
LETTER = re.compile(r"[^\W\d_]")
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Bytes of text handled at a time, so that long texts need no more memory than short ones.
PIECE = 1 << 20


@dataclass
class LanguageFilter:
    """``slots``: slots x ceil(languages / 64) masks; ``false_rate``: chance answers of each language's filter;
    ``usual``: the language with most labelled documents, for texts of which no n-gram is held."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    hashes: int = HASHES
    n: int = N
    usual: str = UNDECIDED


def grams(text: str, n: int = N) -> np.ndarray:
    """Hash of every n-gram of code points: letters in lower case, any run of other characters as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = IS_LETTER[np.minimum(codes, 0xFFFF)]
    codes = np.where(letters, codes, 32)
    first = np.ones(len(codes), bool)
    first[1:] = letters[1:] | letters[:-1]
    codes = codes[first].astype(np.uint64)
    codes = np.concatenate([[np.uint64(32)], codes, [np.uint64(32)]])
    if len(codes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        out = out * MIX[0] + codes[k : len(codes) - n + 1 + k]
    out ^= out >> np.uint64(29)
    out *= MIX[1]
    return out ^ (out >> np.uint64(32))


def letter_table() -> np.ndarray:
    """Which code points count as letters; those beyond the first plane go by the last entry, a letter."""
    table = np.fromiter((bool(LETTER.match(chr(c))) if not 0xD800 <= c < 0xE000 else False for c in range(0x10000)), bool, 0x10000)
    table[0xFFFF] = True
    return table


IS_LETTER = letter_table()


def pieces(text: str, n: int = N):
    """Overlapping pieces of a text, so that every n-gram comes once (but for joints inside runs of non-letters)."""
    if len(text) <= PIECE:
        yield text
        return
    for at in range(0, len(text), PIECE):
        yield text[at : at + PIECE + n - 1]


def slots_of(h: np.ndarray, slots: int, hashes: int = HASHES) -> list[np.ndarray]:
    return [((h * MIX[k % 3] + np.uint64(k)) >> np.uint64(20)) & np.uint64(slots - 1) for k in range(hashes)]


def sampled(rows: DataFrame, size: int) -> DataFrame:
    """(lang, text): the first ``size`` ids of each language by a hash, one text for each id.

    Ids are counted by cells of the hash first, so only the cells that the sample reaches into are sorted: about
    ``size`` rows and one cell of each language, however common it is. An id with several texts gives that with the least hash.
    """
    ids = rows.select("lang", "id", F.xxhash64(F.lit("lang-sample"), "id").alias("turn"))
    ids = ids.withColumn("cell", F.shiftrightunsigned("turn", 64 - CELLS.bit_length() + 1)).distinct()
    ids = session.durable(ids)
    cells = ids.groupBy("lang", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    reached = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("before") < size)
    near = ids.join(session.broadcast_if_small(reached.select("lang", "cell", "before")), ["lang", "cell"])
    place = F.row_number().over(Window.partitionBy("lang", "cell").orderBy("turn", "id")) + F.col("before")
    picked = session.durable(near.withColumn("place", place).filter(F.col("place") <= size).select("lang", "id"))
    texts = rows.join(session.broadcast_if_small(picked), ["lang", "id"], "left_semi")
    texts = texts.groupBy("lang", "id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return texts.select("lang", F.col("first.text").alias("text"))


def fit(
    labelled: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", sample_docs: int = SAMPLE_DOCS, slots: int | None = None
) -> LanguageFilter:
    """Fit on rows with a language, an id and a text; others are ignored. The sample and the result don't depend on order.

    A language with a single labelled document is held as any other, by that document's n-grams. ``slots`` (a power of
    two) overrides the size that follows from the n-grams.
    """
    common.prepare(labelled.sparkSession)
    rows = labelled.select(
        labelled[id_col].cast("long").alias("id"), labelled[lang_col].cast("string").alias("lang"), labelled[text_col].cast("string").alias("text")
    ).filter("lang is not null and id is not null and text <> ''")
    sample = session.durable(session.spread(sampled(rows, sample_docs)))
    docs = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    labels = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").first()
    languages = sorted(docs)
    if not languages:
        return LanguageFilter([], np.zeros((slots or LEAST_SLOTS, 1), np.uint64), np.zeros(0))

    def count(batches):
        """Documents of each language that hold an n-gram, added up within a batch."""
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text")
            for lang in set(langs):
                seen = [np.unique(np.concatenate([grams(p) for p in pieces(texts[int(i)].as_py())])) for i in np.flatnonzero(langs == lang)]
                h, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "docs"]
                )

    counts = sample.mapInArrow(count, "lang string, gram long, docs long")
    sizes = F.create_map(*[F.lit(x) for pair in docs.items() for x in pair])
    counts = counts.groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    counts = counts.withColumn("share", F.col("docs") / sizes[F.col("lang")])
    counts = counts.withColumn("top", F.max("share").over(Window.partitionBy("gram")))
    held = session.durable(counts.filter(F.col("share") >= LIKE_MOST * F.col("top")).select("lang", "gram"))
    if slots is None:
        fullest = held.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << int(ROOM * fullest - 1).bit_length() if fullest else 0))

    def slot_bits(batches):
        """Slots of n-grams with their language's bit, ORed within a batch."""
        for batch in batches:
            number = {lang: k for k, lang in enumerate(languages)}
            k = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            h = batch.column("gram").to_numpy().view(np.uint64)
            at = np.concatenate(slots_of(h, slots)).astype(np.int64) * words + np.tile(k // 64, HASHES)
            bits = np.tile(np.uint64(1) << (k % 64).astype(np.uint64), HASHES)
            order = np.argsort(at, kind="stable")
            place, first = np.unique(at[order], return_index=True)
            masks = np.bitwise_or.reduceat(bits[order], first) if len(at) else bits
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(masks.view(np.int64))], ["place", "mask"])

    words = -(-len(languages) // 64)
    table = np.zeros(slots * words, np.uint64)
    filled = held.mapInArrow(slot_bits, "place long, mask long").groupBy("place").agg(F.expr("bit_or(mask)").alias("mask")).toPandas()
    table[filled["place"].to_numpy()] = filled["mask"].to_numpy(np.int64).view(np.uint64)  # at most a row for each word of the filter
    slots = table.reshape(slots, words)
    full = [float(((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(languages))]
    return LanguageFilter(languages, slots, np.array(full) ** HASHES, usual=labels["lang"])


def counted(text: str, model: LanguageFilter) -> tuple[int, np.ndarray]:
    """n-grams of the whole text and, per language, how many the filter holds."""
    total, hits = 0, np.zeros(len(model.languages))
    for piece in pieces(text, model.n):
        h = grams(piece, model.n)
        total += len(h)
        masks = None
        for slot in slots_of(h, len(model.slots), model.hashes):
            masks = model.slots[slot] if masks is None else masks & model.slots[slot]
        if masks is not None:
            hits += [int(np.count_nonzero(masks[:, k // 64] & (np.uint64(1) << np.uint64(k % 64)))) for k in range(len(hits))]
    return total, hits


def decide(text: str | None, model: LanguageFilter) -> tuple[str, float, float]:
    """(language, score, coverage): the score is the language's share of all corrected counts, the coverage its
    corrected count in n-grams of the text. Ties go to the language first by name; a text of which no n-gram is held
    has no evidence and gets the language of most labelled documents with score and coverage 0."""
    if not text or not model.languages or not LETTER.search(text):
        return UNDECIDED, 0.0, 0.0
    total, hits = counted(text, model)
    right = np.maximum(0.0, (hits - total * model.false_rate) / np.maximum(1 - model.false_rate, 1e-9))
    best = int(np.argmax(right))
    if right[best] == 0:
        return model.usual, 0.0, 0.0
    return model.languages[best], round(float(right[best] / right.sum()), 6), round(min(1.0, float(right[best]) / max(total, 1)), 6)


def identified(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, coverage), one row per input row, from the text alone, whole: long ones in pieces of PIECE.

    A null text, an empty one or one without letters is ``und`` with score 0. Repeated rows get equal answers; an
    empty table gives no rows. The model's size is bounded by MOST_SLOTS, whatever the corpus.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def predict(batches):
        common.remembered("language")
        model = shared.value
        for batch in batches:
            found = [decide(t.as_py(), model) for t in batch.column("text")]
            lang, score, coverage = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(coverage, pa.float64())],
                ["id", "lang_pred", "score", "coverage"],
            )

    schema = "id long, lang_pred string, score double, coverage double"
    return common.text_rows(docs, id_col, text_col).mapInArrow(predict, schema)


def identified_rows(docs: DataFrame, model: LanguageFilter, columns: list[str], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, these columns, with lang_pred, score and coverage beside them; answers as ``identified``."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*columns)

    def predict(batches):
        common.remembered("language")
        model = shared.value
        for batch in batches:
            lang, score, coverage = zip(*[decide(t.as_py(), model) for t in batch.column(text_col)])
            extra = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(coverage, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*columns, "lang_pred", "score", "coverage"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(predict, f"{fields}, lang_pred string, score double, coverage double")
