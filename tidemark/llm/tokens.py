"""Token ids as binary columns: Parquet list columns in document order, read back selectively.

Files hold (doc_id, n_tokens, part, ids), sorted by doc_id over all files. The writer sets row-group and page sizes;
Parquet keeps a page index, so a reader skips to the pages of some documents, and a reader of the metadata columns
never touches the ids. Ids repeat, so they are dictionary encoded; sorted metadata is delta encoded by the v2 writer.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common

END = 2
ROW_GROUP, PAGE, PAGE_ROWS = 64 << 20, 1 << 20, 2000
#: Units kept with their ids in each Python worker, so that a common unit is encoded once.
REMEMBERED = 1_200_000
#: Texts given to the library at once.
AT_ONCE = 10_000
#: By code: what is not white space, and letters and digits; beyond U+3000 there is no white space, and letters are not cut at.
SOLID = np.array([not chr(c).isspace() for c in range(0x3002)])
WORDLIKE = np.array([chr(c).isalnum() for c in range(0x3001)] + [False])
MARKS = np.zeros(129, bool)
MARKS[[ord(c) for c in string.punctuation]] = True
ODD, PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def solid(codes: np.ndarray) -> np.ndarray:
    return SOLID[np.minimum(codes, len(SOLID) - 1)]


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts side by side, the places where their units begin, and each text's number of units.

    Whatever surrounds it, a new pre-token of this vocabulary begins at a space between two other characters, at and
    after a line feed between two such, and at a punctuation mark after a letter or digit.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.zeros(len(codes), bool)
    ends = np.cumsum(sizes)
    begins[(ends - sizes)[sizes > 0]] = True
    for c in " \n":
        at = np.flatnonzero(codes[1:-1] == ord(c)) + 1
        at = at[solid(codes[at - 1]) & solid(codes[at + 1])]
        begins[at] = True
        if c == "\n":
            begins[at + 1] = True
    at = np.flatnonzero(MARKS[np.minimum(codes[1:], len(MARKS) - 1)]) + 1
    begins[at[WORDLIKE[np.minimum(codes[at - 1], len(WORDLIKE) - 1)]]] = True
    begin = np.flatnonzero(begins)
    return codes, begin, np.diff(np.searchsorted(begin, ends), prepend=0)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of many runs, one run after the other."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def grown(array: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    need = size + len(values)
    if need > len(array):
        array = np.concatenate([array, np.zeros(max(need - len(array), len(array) // 2), array.dtype)])
    array[size:need] = values
    return array


class UnitEncoder:
    """Encodes texts unit by unit, where units are what the vocabulary's own splitting never joins.

    Units are known by a key of their characters; unit n's ids lie in ``ids`` from ``id_at[n]`` on, and its characters
    in ``codes`` from ``code_at[n]`` on, with which every use is compared, so equal keys of different units do no harm.
    A text that holds the content of an added token is encoded whole, as the library splits at such tokens before
    anything else. With ``special_as_text`` the content of a special token is text like any other, which is not the
    library's default.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        # Spark already runs a worker on every core; threads inside them would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if special_as_text:
            self.tokenizer.encode_special_tokens = True
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.clear()

    def clear(self) -> None:
        self.units = 0
        self.keys, self.unit_of = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.id_at, self.code_at = np.zeros((2, 1 << 16), np.int64)
        self.ids, self.codes = np.zeros(1 << 17, np.int32), np.zeros(1 << 18, np.uint32)

    def known(self, keys: np.ndarray) -> np.ndarray:
        """The unit of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.unit_of[at], -1)

    def library(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after the other, and their number in each unit."""
        ids, counts = array("I"), []
        for at in range(0, len(units), AT_ONCE):
            for e in self.tokenizer.encode_batch_fast(units[at : at + AT_ONCE], add_special_tokens=False):
                own = e.ids
                ids.extend(own)
                counts.append(len(own))
        return np.array(ids, np.int32), np.array(counts, np.int64)

    def add(self, codes: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> None:
        """Encode and keep new units, whose characters lie side by side, by ascending key."""
        ends = np.cumsum(sizes)
        text = codes.tobytes().decode("utf-32-le", "surrogatepass")
        ids, counts = self.library([text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())])
        new = np.arange(self.units, self.units + len(sizes))
        for name, values, many in (("ids", ids, counts), ("codes", codes, sizes)):
            where = f"{name[:-1]}_at"
            starts = getattr(self, where)
            begun = int(starts[self.units])
            setattr(self, where, grown(starts, self.units, begun + np.cumsum(np.concatenate([[0], many]))))
            setattr(self, name, grown(getattr(self, name), begun, values))
        self.units += len(sizes)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.unit_of = np.insert(self.keys, place, keys), np.insert(self.unit_of, place, new)

    def units_at(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units that begin at places of a text, and which of them are not what their key stands for."""
        sizes = np.diff(begin, append=len(codes))
        # A unit's key is a sum over its characters of a number for the character and its place.
        place = (np.arange(len(codes)) - np.repeat(begin, sizes)).view(np.uint64)
        keys = np.add.reduceat(mixed(codes * ODD + place * PLACE), begin)
        keys = mixed(keys + sizes.view(np.uint64) * PLACE)
        keys, at, which = np.unique(keys, return_index=True, return_inverse=True)
        units = self.known(keys)
        new = units < 0
        if new.any():
            at = at[new]
            self.add(codes[spans(begin[at], sizes[at])], sizes[at], keys[new])
            units[new] = self.known(keys[new])
        units = units[which]
        stored = self.code_at[units]
        right = self.code_at[units + 1] - stored == sizes
        same = self.codes[np.minimum(np.repeat(stored - begin, sizes) + np.arange(len(codes)), len(self.codes) - 1)] == codes
        return units, ~(right & np.logical_and.reduceat(same, begin))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their number in each text."""
        if self.units > REMEMBERED:
            self.clear()
        whole = {k for k, t in enumerate(texts) if self.added and self.added.search(t)}
        while True:
            codes, begin, many = laid_out(["" if k in whole else t for k, t in enumerate(texts)])
            if not len(begin):
                units = np.empty(0, np.int64)
                break
            units, wrong = self.units_at(codes, begin)
            if not wrong.any():
                break
            whole.update(np.searchsorted(np.cumsum(many), np.flatnonzero(wrong), side="right").tolist())
        start = self.id_at[units]
        n = self.id_at[units + 1] - start
        ids = self.ids[spans(start, n)]
        upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(many)])]
        counts = np.diff(upto)
        if whole:
            # Whole texts are not remembered; they had no units.
            order = sorted(whole)
            own, counts_own = self.library([texts[k] for k in order])
            ids = np.insert(ids, np.repeat(upto[order], counts_own), own)
            counts[order] = counts_own
        return ids, counts


def encoder(path: str, special_as_text: bool = False) -> UnitEncoder:
    key = path, special_as_text
    encoders = common.remembered("tokens")
    if key not in encoders:
        encoders[key] = UnitEncoder(path, special_as_text)
    return encoders[key]


def encoded(rows: DataFrame, path: str, end: int | None = END, special_as_text: bool = False) -> DataFrame:
    """(id, n_tokens, ids) of (id, text) rows, in the order of the rows."""

    def run(batches):
        coder = encoder(path, special_as_text)
        for batch in batches:
            ids, counts = coder.encode(batch.column("text").to_pylist())
            if end is not None:
                ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts), lists], ["id", "n_tokens", "ids"])

    return rows.mapInArrow(run, "id long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, folder: str, path: str, id_col="doc_id", text_col="text", end: int | None = END, special_as_text: bool = True) -> None:
    """Write the token files of all rows, in ascending id order, to ``folder``.

    Texts are dealt by ranges of the id and sorted, so file part-k holds smaller ids than part-(k+1); tokens
    themselves are never shuffled. A null text is empty: its only id is the end id. A null id comes first; rows with
    equal ids stay next to each other. An empty table writes no rows. ``special_as_text`` off gives the ids of the
    tokenizer file as the library reads it; on, no text can forge a special token.
    """
    rows = common.text_rows(docs, id_col, text_col)
    parts = max(common.shuffle_partitions(docs.sparkSession), 1)
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", F.xxhash64("text"))
    out = encoded(ordered, path, end, special_as_text).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    (
        out.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(folder)
    )


def read_tokens(spark, folder: str, *columns: str) -> DataFrame:
    """Chosen columns of token files; ``id``, ``n_tokens``, ``part`` and ``at`` alone read no token pages."""
    schema = "id long, n_tokens long, ids array<int>, part int, at long"
    df = spark.read.schema(schema).parquet(folder)
    return df.select(*columns) if columns else df


def token_starts(spark, folder: str) -> DataFrame:
    """(at, start): ids of all documents before each one, from the metadata columns only.

    Files are ranges of the order, so a running sum inside each and the sums of the files before are enough;
    there is one row for each file in the carried table.
    """
    from pyspark.sql import Window

    rows = read_tokens(spark, folder, "n_tokens", "part", "at")
    sums = session.durable(rows.groupBy("part").agg(F.sum("n_tokens").alias("all")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("carry"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return within.join(F.broadcast(carried), "part").select("at", (F.col("carry") + F.col("within")).alias("start"))


def digests(spark, folder: str) -> DataFrame:
    """(id, at, n_tokens, ids_crc32) read from the files: the checksum of each document's ids as 32-bit words."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            data, offsets = np.ascontiguousarray(ids.values.to_numpy(), "<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("at"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                ["id", "at", "n_tokens", "ids_crc32"],
            )

    return read_tokens(spark, folder, "id", "at", "ids").mapInArrow(run, "id long, at long, n_tokens long, ids_crc32 long")
