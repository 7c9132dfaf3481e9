"""Repeated passages by winnowing: fingerprints of anchor positions are grouped in Spark, then whole windows around them.

This replaces prefix doubling in Spark, which would sort every byte position and join its ranks round by round. No round
here reads names made by an earlier one: the name of a string of any length is a hash, computed inside a task. Spark
groups equal names, each group has the smallest document that holds it, and positions whose string occurs in one
document only are dropped before the next, longer round. The last round reaches the wanted length.

A position counts as an anchor when the name of its first SEED bytes is the smallest of some window of the wanted length.
Equal windows have equal anchors, so a repeated string always shows at its anchors, and about one in thirteen
positions is grouped. What survives is then looked at position by position:

  round 1   anchors, by the name of their first SEED bytes: those found in one document only are dropped
  round 2   surviving anchors, by the name of all bytes that any window over the anchor can cover: an anchor with
            the same surroundings as one in a smaller document is repeated as a whole
  round 3   of what is left, each anchor goes with the bytes around it to the task of its name, which compares windows
            by the fingerprint (64 bits) of their bytes on both sides of the anchor, so nothing is sent window by window;
            only names that very many anchors share send windows, and what a task sees twice is settled there

Documents with equal texts are told apart first: a copy of a smaller document is removed as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common

LENGTH, SEED = 50, 25
#: Bytes of text handled at a time in a task.
PIECE = 2 << 20
#: Anchors whose surroundings are held as bytes at a time.
ANCHORS = 100_000
#: A name that more open anchors than this share is compared window by window, not in one task.
CROWD = 20_000
#: Windows of such names compared with each other in a task before any are sent on.
WINDOWS = 1_500_000
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def names(data: np.ndarray, length: int, salt: np.uint64 = MULTIPLY) -> np.ndarray:
    """A 64-bit name of the string of ``length`` bytes at every position, by a hash that doubles its length inside the task."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    name, h = mixed(data.astype(np.uint64) + salt), 1
    while h < length:
        step = min(h, length - h)
        name = name[: len(name) - step] * salt + name[step:]
        name ^= name >> np.uint64(29)
        h += step
    return mixed(name)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[: len(values) - step], values[step:])
        done += step
    return values


def anchors(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose name is smallest in some window of ``length`` bytes, and those names; ties all count."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    name = names(data, seed)
    width = length - seed + 1
    least = sliding(name, width, np.minimum)  # one for each window start
    edge = np.zeros(width - 1, np.uint64)
    largest = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero(largest == name)
    return at, name[at]


def texts_of(batch) -> list[np.ndarray]:
    """The texts of a batch as byte arrays, without copies."""
    column = batch.column("text")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def overlapping(data: np.ndarray, length: int):
    """(offset, piece): long texts in pieces that share what a window around any anchor needs."""
    if len(data) <= PIECE:
        yield 0, data
        return
    for at in range(0, len(data) - length + 1, PIECE):
        yield at, data[at : at + PIECE + length - 1]


def anchor_rows(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(name, lane, shared, id, at) for each anchor of (id, text) rows.

    Names that a batch holds in more than one document are ``shared`` already: all but one of their rows carry a lane
    other than -1, so that a string all documents share doesn't meet in one task.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            where, name, who = [], [], []
            for k, data in enumerate(texts_of(batch)):
                for offset, piece in overlapping(data, length):
                    at, found = anchors(piece, length, seed)
                    where.append(at + offset)
                    name.append(found)
                    who.append(np.full(len(at), k))
            where, name, who = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (where, name, who))
            if len(where) == 0:
                continue
            order = np.lexsort((ids[who], name))
            where, name, doc = where[order], name[order], ids[who[order]]
            new = np.flatnonzero(np.diff(name, prepend=~name[:1]))
            many = np.diff(new, append=len(name))
            last = new + many - 1
            shared = np.repeat(doc[new] != doc[last], many)
            first = np.zeros(len(name), bool)
            first[new] = True
            lane = np.where(shared & ~first, where & 1023, -1)
            for a in range(0, len(name), 50_000):
                b = a + 50_000
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[a:b].view(np.int64)), pa.array(lane[a:b].astype(np.int32)), pa.array(shared[a:b]), pa.array(doc[a:b]), pa.array(where[a:b])],
                    ["name", "lane", "shared", "id", "at"],
                )

    return rows.mapInArrow(run, "name long, lane int, shared boolean, id long, at long")


def folded(words: np.ndarray, salt: np.uint64, start: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of words."""
    h = mixed(start + salt)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * salt
        h ^= h >> np.uint64(32)
    return mixed(h)


def around_anchors(batch, length: int, seed: int):
    """(id, at, before, after, bytes) of the anchors of an (id, text, ats) batch, some at a time.

    ``bytes`` has a row for each anchor: what any window over it can cover, the anchor in the middle, zero outside the
    text and up to a whole number of words. ``before`` and ``after`` are how many bytes the text has on either side, up
    to what a window can use.
    """
    if not batch.num_rows:
        return
    side = length - seed
    width = -(-(length + side) // 8) * 8
    ids, texts, ats = batch.column("id").to_numpy(), texts_of(batch), batch.column("ats")
    each = [np.unique(a.values.to_numpy()) for a in ats]
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    # Texts of a batch lie one after the other; at either end there is room for a row of bytes.
    data = np.concatenate([np.zeros(side, np.uint8), *texts, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(data, width)
    at, who = np.concatenate(each), np.repeat(np.arange(len(each)), [len(a) for a in each])
    for k in range(0, len(at), ANCHORS):
        here, text = at[k : k + ANCHORS], who[k : k + ANCHORS]
        before, after = np.minimum(here, side), np.minimum(sizes[text] - here - seed, side)
        cover = rows[starts[text] + here]
        cover[:, length + side :] = 0
        short = np.flatnonzero((before < side) | (after < side))
        place = np.arange(width)
        outside = (place < (side - before[short])[:, None]) | (place >= (length + after[short])[:, None])
        cover[short] = np.where(outside, 0, cover[short])
        yield ids[text], here, before, after, cover


def seed_names(cover: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A name of the anchor in the middle of each row."""
    words = np.zeros((len(cover), -(-seed // 8) * 8), np.uint8)
    words[:, :seed] = cover[:, length - seed : length]
    return folded(words.view(np.uint64), OTHER, np.zeros(len(cover), np.uint64))


def surroundings(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(name, name_1, name_2, id, at, before, after) of (id, text, ats) rows: the bytes that windows over an anchor cover."""

    def run(batches):
        for batch in batches:
            for ids, at, before, after, cover in around_anchors(batch, length, seed):
                tag = (before * (length + 1) + after).astype(np.uint64)
                one, two = (folded(cover.view(np.uint64), salt, tag) for salt in (MULTIPLY, OTHER))
                name = seed_names(cover, length, seed)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x.view(np.int64)) for x in (name, one, two)], *[pa.array(x) for x in (ids, at, before, after)]],
                    ["name", "name_1", "name_2", "id", "at", "before", "after"],
                )

    return rows.mapInArrow(run, "name long, name_1 long, name_2 long, id long, at long, before long, after long")


def contexts(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(name, id, at, before, after, cover) of (id, text, ats) rows: each anchor with the bytes themselves."""

    def run(batches):
        for batch in batches:
            for ids, at, before, after, cover in around_anchors(batch, length, seed):
                ends = np.arange(len(at) + 1, dtype=np.int32) * cover.shape[1]
                cells = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(cover))])
                name = seed_names(cover, length, seed).view(np.int64)
                columns = [pa.array(name), pa.array(ids), pa.array(at), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), cells]
                yield pa.RecordBatch.from_arrays(columns, ["name", "id", "at", "before", "after", "cover"])

    return rows.mapInArrow(run, "name long, id long, at long, before int, after int, cover binary")


class Anchors:
    """Rows of ``contexts`` together, and their windows: one for every number of bytes before the anchor."""

    def __init__(self, batches: list, length: int, seed: int):
        columns = [np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("name", "id", "at", "before", "after")]
        self.name, self.ids, self.at, self.before, self.after = columns
        self.length, self.side = length, length - seed
        width = -(-(length + self.side) // 8) * 8
        cover = []
        for b in batches:
            cells = b.column("cover")
            first = np.frombuffer(cells.buffers()[1], np.int64 if pa.types.is_large_binary(cells.type) else np.int32)[cells.offset]
            cover.append(np.frombuffer(cells.buffers()[2], np.uint8)[first : first + len(cells) * width].reshape(-1, width))
        cover = np.concatenate(cover)
        code = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * MULTIPLY)
        start = mixed(self.name.view(np.uint64) * OTHER)
        # Names of the bytes next to the anchor, for each number of them: those after it, and on the way those before.
        self.right = np.empty((self.side + 1, len(start)), np.uint64)
        self.right[0] = start
        for k in range(self.side):
            self.right[k + 1] = mixed(self.right[k] ^ code[cover[:, length + k]])
        self.left, self.code, self.cover = start, code, cover

    def windows(self):
        """(bytes before the anchor, rows, name, where the rows of a name begin), rows ordered by the name of their window."""
        for k in range(self.side + 1):
            if k:
                self.left = mixed(self.left ^ self.code[self.cover[:, self.side - k]])
            rows = np.flatnonzero((self.before >= k) & (self.after >= self.side - k))
            if not len(rows):
                continue
            key = mixed(self.left[rows] * OTHER + self.right[self.side - k][rows])
            order = np.argsort(key)
            rows, key = rows[order], key[order]
            name = self.name[rows]
            new = np.flatnonzero((np.diff(key, prepend=~key[:1]) != 0) | (np.diff(name, prepend=~name[:1]) != 0))
            yield k, rows, key, new

    def repeated(self, single=None):
        """(id, a, b): for each anchor the bytes of its windows that an anchor of a smaller id here has too.

        All windows of an anchor overlap, so the bytes are one range. ``single`` is given the other windows, as
        (bytes before the anchor, rows, names).
        """
        low, high = np.full(len(self.ids), self.side + 1), np.full(len(self.ids), -1)
        for k, rows, key, new in self.windows():
            ids = self.ids[rows]
            known = ids > np.repeat(np.minimum.reduceat(ids, new), np.diff(new, append=len(rows)))
            found = rows[known]
            low[found], high[found] = np.minimum(low[found], k), k
            if single is not None:
                single(k, rows[~known], key[~known])
        rows = np.flatnonzero(high >= 0)
        return self.ids[rows], self.at[rows] - high[rows], self.at[rows] - low[rows] + self.length


def taken(batches, most: int):
    """The batches of a task, in lists of about ``most`` rows."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= most:
            yield held
            held, rows = [], 0
    if held:
        yield held


def compared(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(id, a, b) of ``contexts`` rows whose equal names are in one task: the ranges of ``Anchors.repeated``."""

    def run(batches):
        for held in taken(batches, 1 << 62):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in Anchors(held, length, seed).repeated()], ["id", "a", "b"])

    return rows.mapInArrow(run, "id long, a long, b long")


def single_windows(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(name, rank, id, a, b, known) of ``contexts`` rows in any order, for names that too many anchors share.

    What a task finds repeated among its own rows comes as ranges that are ``known``; all other windows come one by
    one, for comparison with other tasks.
    """

    def run(batches):
        for held in taken(batches, WINDOWS // (length - seed + 1)):
            anchors, out = Anchors(held, length, seed), []
            ids, a, b = anchors.repeated(lambda k, r, key: out.append((anchors.name[r], key.view(np.int64), anchors.ids[r], anchors.at[r] - k)))
            # A known range has a name and rank of no meaning.
            parts = [(a, mixed(ids.view(np.uint64) * MULTIPLY + b.view(np.uint64)).view(np.int64), ids, a, b, np.ones(len(ids), bool))]
            parts += [(name, rank, one, at, at + length, np.zeros(len(at), bool)) for name, rank, one, at in out]
            for columns in parts:
                for k in range(0, len(columns[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in columns], ["name", "rank", "id", "a", "b", "known"])

    return rows.mapInArrow(run, "name long, rank long, id long, a long, b long, known boolean")


def removed(rows: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of (id, text, spans) rows; spans may overlap, or be null."""

    def run(batches):
        for batch in batches:
            out = []
            for data, spans in zip(texts_of(batch), batch.column("spans")):
                gone, runs = np.zeros(len(data), bool), 0
                if spans.is_valid and len(data):
                    pairs = spans.values
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, np.minimum(pairs.field("a").to_numpy(), len(data)), 1)
                    np.add.at(edge, np.minimum(pairs.field("b").to_numpy(), len(data)), -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                n = int(np.count_nonzero(gone))
                out.append((len(data), n, runs, hashlib.sha256(data[~gone].tobytes() if n else data.tobytes()).hexdigest()))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_spans(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(id, spans): for documents with any, byte ranges [a, b) covered by strings of ``length`` bytes that also start
    in a document with a smaller id. Ranges may overlap."""
    spark = docs.sparkSession
    rows = common.text_rows(docs, id_col, text_col).filter("id is not null")
    known = session.durable(
        rows.select("id", F.octet_length("text").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    )
    # One text for each id: should an id come with several, the first by hash takes part.
    texts = known.groupBy("id").agg(F.min("sha").alias("sha"), F.max("sha").alias("last"), F.max("n_bytes").alias("n_bytes"))
    several = texts.filter("sha <> last")
    if several.limit(1).count():
        one = session.durable(texts.select("id", "sha"))
        rows = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).join(one, ["id", "sha"], "left_semi")
        rows = rows.dropDuplicates(["id"]).drop("sha")
    # Copies of a smaller document's text go as a whole and take no further part.
    copies = texts.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("size")).filter("size > 1")
    copies = common.attach(texts, session.durable(copies), ["sha"], "size").filter("id > first").select("id", "n_bytes")
    copies = session.durable(copies)
    rows = rows.filter(F.octet_length("text") >= length)
    rows = rows.join(session.broadcast_if_small(copies.select("id")), "id", "left_anti")

    # Round 1: anchors whose name is in more than one document.
    found = anchor_rows(session.spread(rows), length, seed)
    group = Window.partitionBy("name", "lane")
    found = found.withColumns({"least": F.min("id").over(group), "most": F.max("id").over(group)})
    found = found.filter("shared or least <> most")
    ats = session.durable(found.groupBy("id").agg(F.collect_list("at").alias("ats")))
    common.release(spark)

    # Round 2: all that windows over an anchor can cover.
    around = session.durable(surroundings(rows.join(ats, "id"), length, seed))
    common.release(spark)
    keys = ["name", "name_1", "name_2"]
    classes = session.durable(around.groupBy(*keys).agg(F.min("id").alias("first")))
    common.release(spark)
    split = session.durable(classes.groupBy("name").agg(F.count("*").alias("classes")).filter("classes > 1").select("name"))
    partial = session.durable(
        classes.join(split.withColumn("several", F.lit(True)), "name", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    )
    common.discard(classes, split, ats)
    common.release(spark)
    judged = session.durable(around.join(partial, keys).select("id", "at", "before", "after", (F.col("first") < F.col("id")).alias("whole"), "several"))
    common.discard(around, partial)
    common.release(spark)
    whole = judged.filter(F.col("whole") & (F.col("before") + F.col("after") >= length - seed)).select(
        "id", (F.col("at") - F.col("before")).alias("a"), (F.col("at") + seed + F.col("after")).alias("b")
    )

    # Round 3: single windows where surroundings differ, compared among the anchors of a name.
    still = judged.filter("several and not whole")
    open_ats = session.durable(still.groupBy("id").agg(F.collect_list("at").alias("ats")))
    around = session.durable(contexts(rows.join(open_ats, "id"), length, seed))
    common.discard(open_ats)
    common.release(spark)
    crowded = session.durable(around.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("name"))
    most = around.join(session.broadcast_if_small(crowded), "name", "left_anti")
    windows = compared(session.by_key(most, "name", rows=around.count()), length, seed)
    if crowded.limit(1).count():
        single = single_windows(around.join(session.broadcast_if_small(crowded), "name", "left_semi"), length, seed)
        least = F.min("id").over(Window.partitionBy("name", "rank"))
        windows = windows.unionByName(single.withColumn("least", least).filter("known or id > least").select("id", "a", "b"))
    windows = session.durable(windows)
    common.discard(around)
    common.release(spark)

    copied = copies.filter(F.col("n_bytes") >= length).select("id", F.lit(0).cast("long").alias("a"), F.col("n_bytes").cast("long").alias("b"))
    spans = whole.unionByName(windows).unionByName(copied)
    return session.durable(spans.groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("spans")))


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row.

    Texts are UTF-8 bytes, null is empty; strings never cross documents and are judged on the input. Texts
    shorter than ``length`` lose nothing. Repeated rows of one id are one document; if an id comes with different
    texts, the first by hash takes part and its ranges hold for rows of that id as far as they reach. A null
    id is neither smaller nor larger than another: its rows lose nothing. An empty table gives no rows.
    """
    spans = repeated_spans(docs, id_col, text_col, length, seed)
    common.release(docs.sparkSession)
    return removed(common.text_rows(docs, id_col, text_col).join(spans, "id", "left"))
