"""Near-duplicate detection with b-bit MinHash.

Each document's set of word shingles gets minima under many hash functions. Bands of full minima give candidates;
of every minimum only the low bits are kept and packed into a few words, and the number of equal low bits, corrected
for chance agreement, estimates the similarity. Candidates that the estimate cannot rule out are confirmed on the
full sets.

Documents with the same set are one class and only its first member goes on. Inside a bucket nobody lists all pairs:
first every member is compared with the bucket's first member, and the confirmed links join most of a group of copies
into components. What lies outside a component but shares a bucket with many of its members is then asked for a
link to the component as a whole, which gives one row for each question; only members of small components are
compared pair by pair, by their packed bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common

WORDS, PERCENT = 5, 80
#: A pair at the threshold is missed by all bands with probability (1 - 0.8 ** ROWS) ** BANDS, below one in 100,000.
BANDS, ROWS = 32, 5
#: Minima per document (the first BANDS * ROWS of them make the bands) and low bits kept of each.
MINIMA, BITS = 512, 2
#: Standard deviations below the threshold at which an estimate rules a pair out (of links, one in 3 million).
SIGMAS = 5.0
#: Rows on either side that meet in one task; larger groups are cut into tiles of this many by this many.
TILE = 500
#: Members of one component in a bucket from which on it is compared as a component, not member by member.
CROWD = 8
PRIME = np.uint64((1 << 61) - 1)
WORD_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
LOWER = bytes(range(65, 91)), bytes(range(97, 123))
TO_LOWER = bytes.maketrans(*LOWER)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted 64-bit names of a text's distinct word shingles, words in lower case A-Z.

    A text with fewer words is one shingle; a text without words has none.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        out = mixed(out + names[k : len(words) - size + 1 + k] * WORD_SALT[k % 5])
    return np.unique(out)


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, count, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def minima(sets: list[np.ndarray], count: int = MINIMA, seed: int = 7) -> np.ndarray:
    """sets x count minima; every set is non-empty."""
    a, b = permutations(count, seed)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    flat = np.concatenate(sets)
    out = np.empty((len(sets), count), np.uint64)
    for k in range(count):
        h = flat * a[k] + b[k]
        h ^= h >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def packed(signature: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Low bits of the minima, packed into 64-bit words: one row of words per set. Bit planes lie side by side."""
    n, k = signature.shape
    planes = [((mixed(signature) >> np.uint64(j)) & np.uint64(1)).astype(np.uint8) for j in range(bits)]
    words = -(-k // 64)
    out = np.zeros((n, bits * words), np.uint64)
    for j, plane in enumerate(planes):
        padded = np.zeros((n, words * 64), np.uint8)
        padded[:, :k] = plane
        out[:, j * words : (j + 1) * words] = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    return out


def least_equal(count: int, percent: int = PERCENT, bits: int = BITS) -> int:
    """Equal packed minima below which a pair is ruled out.

    Two sets of similarity J agree in the low bits of a minimum with probability C + (1 - C) J, where C = 2 ** -bits
    is chance agreement; the bound lies SIGMAS deviations under its mean at the threshold.
    """
    chance = 2.0**-bits
    p = chance + (1 - chance) * percent / 100
    return int(max(0, np.floor(count * p - SIGMAS * np.sqrt(count * p * (1 - p)))))


def similarity(equal, count: int, bits: int = BITS):
    """Collision-corrected estimate of J from the number of equal packed minima."""
    chance = 2.0**-bits
    return (equal / F.lit(float(count)) - chance) / (1 - chance)


def slices(sets: list[np.ndarray], most: int = 100_000):
    """Positions of the non-empty sets, in slices of bounded total size (a single larger set is alone)."""
    part, size = [], 0
    for k, one in enumerate(sets):
        if part and size + len(one) > most:
            yield part
            part, size = [], 0
        if len(one):
            part.append(k)
            size += len(one)
    if part:
        yield part


def signatures(docs: DataFrame, id_col="doc_id", text_col="text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, name_1, name_2, bits, bands), one row per input row; without words, 0 and empty arrays.

    The two names stand for the whole set: sums of two hashes of its shingles.
    """

    def sign(batches):
        common.remembered("neardup")
        for batch in batches:
            sets = [shingles(t.as_py(), words) for t in batch.column("text")]
            bits: list = [[] for _ in sets]
            keys: list = [[] for _ in sets]
            names = np.zeros((2, len(sets)), np.uint64)
            for part in slices(sets):
                signature = minima([sets[k] for k in part])
                low = packed(signature).view(np.int64)
                band = np.zeros((len(part), BANDS), np.uint64)
                cells = signature[:, : BANDS * ROWS].reshape(len(part), BANDS, ROWS)
                for r in range(ROWS):
                    band = mixed(band + cells[:, :, r] * WORD_SALT[r % 5])
                for j, k in enumerate(part):
                    bits[k], keys[k] = low[j], band[j].view(np.int64)
                    names[0, k] = mixed(sets[k] ^ WORD_SALT[0]).sum(dtype=np.uint64)
                    names[1, k] = mixed(sets[k] ^ WORD_SALT[1]).sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)),
                    pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())),
                ],
                ["id", "n_shingles", "name_1", "name_2", "bits", "bands"],
            )

    schema = "id long, n_shingles long, name_1 long, name_2 long, bits array<long>, bands array<long>"
    return common.text_rows(docs, id_col, text_col).mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, shingles) of the documents listed in ``ids``, one row for each id."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), words).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    wanted = common.text_rows(docs, id_col, text_col).join(session.broadcast_if_small(ids), "id", "left_semi")
    return wanted.mapInArrow(run, "id long, shingles array<long>").dropDuplicates(["id"])


def equal_minima(a: str, b: str):
    """Number of equal packed minima of two rows: the planes' differences are merged and counted."""
    words = -(-MINIMA // 64)
    different = F.lit(0)
    for w in range(words):
        merged = None
        for j in range(BITS):
            x = F.col(a)[j * words + w].bitwiseXOR(F.col(b)[j * words + w])
            merged = x if merged is None else merged.bitwiseOR(x)
        different = different + F.bit_count(merged)
    return F.lit(MINIMA) - different


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets pass: 100 * intersection >= percent * union.

    Both frames are written tables, so that Spark can split the rows of an id that is in many pairs.
    """
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("shared", shared)
    return both.filter(100 * F.col("shared") >= percent * (F.size("set_a") + F.size("set_b") - F.col("shared"))).select("a", "b")


def linked_to_component(asked: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) for questions (id, root): one member of the component ``root`` linked to ``id``, from each tile.

    A component is connected already, so one link is enough. Documents that ask and members that answer meet in
    tiles of bounded size, with their full sets; sets are joined by id from written tables.
    """
    sizes = roots.groupBy("root").agg(F.count("*").alias("members"))
    stats = session.durable(asked.groupBy("root").agg(F.count("*").alias("asking")).join(sizes, "root"))
    lanes = F.ceil(F.col("asking") / F.lit(TILE)).cast("int")
    parts = F.ceil(F.col("members") / F.lit(TILE)).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    asking = common.attach(asked, stats, ["root"], "asking")
    asking = asking.select("root", "id", deal(lanes).alias("lane"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    members = common.attach(roots, stats, ["root"], "members").filter("asking is not null")
    members = members.select("root", "id", F.explode(F.sequence(F.lit(0), lanes - 1)).alias("lane"), deal(parts).alias("part"))

    def answer(questions: pa.Table, component: pa.Table) -> pa.Table:
        ask, say = questions.combine_chunks(), component.combine_chunks()
        a, b = [], []
        if ask.num_rows and say.num_rows:
            ids = say.column("id").to_numpy()
            lists = [s.values.to_numpy() for s in say.column("member_set")]
            many = np.array([len(s) for s in lists])
            values, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), many)
            order = np.argsort(values)
            values, owner = values[order], owner[order]
            for one, shingle_list in zip(ask.column("id").to_pylist(), ask.column("asking_set")):
                own = shingle_list.values.to_numpy()
                begin = np.searchsorted(values, own)
                n = np.searchsorted(values, own, side="right") - begin
                at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                shared = np.bincount(owner[at], minlength=len(ids))
                linked = np.flatnonzero(100 * shared >= percent * (len(own) + many - shared))
                if len(linked):
                    a.append(one)
                    b.append(int(ids[linked[0]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ["root", "lane", "part"]
    with_sets = lambda rows, name: session.durable(rows).join(sets.select("id", F.col("shingles").alias(name)), "id")
    questions = with_sets(asking, "asking_set").groupBy(*keys)
    return questions.cogroup(with_sets(members, "member_set").groupBy(*keys)).applyInArrow(answer, "a long, b long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per input row.

    Documents are linked when their sets of ``words``-word shingles have a similarity of ``percent`` or more; the
    component is the smallest id reachable by links, and its document is kept. Null texts, empty texts and texts
    without words have no shingles and stay alone. Repeated rows share their id's component; a null id is never
    linked. An empty table gives no rows.
    """
    spark = docs.sparkSession
    signed = session.durable(signatures(docs, id_col, text_col, words))
    set_keys = ["n_shingles", "name_1", "name_2"]
    full = signed.filter("n_shingles > 0 and id is not null")
    classes = session.durable(full.groupBy(*set_keys).agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    reps = classes.select(F.col("rep").alias("id"), *set_keys)
    members = signed.join(reps, ["id", *set_keys], "left_semi").dropDuplicates(["id"])
    banded = members.select("id", "bits", "bands", F.posexplode("bands").alias("band", "key"))
    banded = session.durable(banded.select("id", F.xxhash64("band", "key").alias("bucket"), "band"))
    buckets = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    buckets = session.durable(buckets)
    held = session.durable(common.attach(banded, buckets, ["bucket"], "size").filter("size > 1"))
    ids = session.durable(held.select("id").distinct())
    rows = session.durable(members.join(session.broadcast_if_small(ids), "id", "left_semi").select("id", "bits", "bands"))
    sets = session.durable(shingle_sets(docs, ids, id_col, text_col, words))
    least = least_equal(MINIMA, percent)

    # Every member against its bucket's first member.
    stars = held.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    sig = rows.select("id", "bits")
    stars = session.durable(stars)
    stars = stars.join(sig.withColumnsRenamed({"id": "a", "bits": "bits_a"}), "a").join(
        sig.withColumnsRenamed({"id": "b", "bits": "bits_b"}), "b"
    )
    stars = session.durable(stars.filter(equal_minima("bits_a", "bits_b") >= least).select("a", "b"))
    links = session.durable(confirmed(stars, sets, percent))
    found = session.durable(common.components(links, spark))

    # What a bucket still holds of different components.
    roots = rows.join(found.withColumnRenamed("node", "id"), "id", "left")
    roots = session.durable(roots.select("id", "bits", "bands", F.coalesce("root", "id").alias("root")))
    placed = session.durable(held.select("bucket", "band", "id").join(roots.select("id", "root"), "id"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size"))
    split = session.durable(split.filter("least <> most").select("bucket", "size"))
    open_rows = session.durable(common.attach(placed, split, ["bucket"], "size").filter("size is not null"))
    crowds = open_rows.groupBy("bucket", "root").agg(F.count("*").alias("crowd")).filter(F.col("crowd") >= CROWD)
    crowds = session.durable(crowds)
    open_rows = session.durable(common.attach(open_rows, crowds, ["bucket", "root"], "crowd"))

    # Whole components: is any of its members linked to this document?
    asked = open_rows.join(crowds.select("bucket", F.col("root").alias("other")), "bucket")
    asked = asked.filter("root <> other and (crowd is null or root < other)").select("id", F.col("other").alias("root"))
    asked = session.durable(asked.distinct())
    answers = session.durable(linked_to_component(asked, roots.select("id", "root"), sets, percent))

    # Members of small components, pair by pair.
    few = open_rows.filter("crowd is null").drop("crowd", "root").join(roots, "id")
    tiles = F.ceil(F.col("size") / F.lit(TILE)).cast("int")
    tile = F.pmod(F.xxhash64("id"), tiles).cast("int")
    every = F.explode(F.sequence(F.lit(0), tiles - 1))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("id", "root", "bits", "bands")]
    left = few.select("bucket", "band", tile.alias("tile_a"), every.alias("tile_b"), *side("a"))
    right = few.select("bucket", tile.alias("tile_b"), every.alias("tile_a"), *side("b"))
    keys = ["bucket", "tile_a", "tile_b"]
    match = (F.col("root_a") != F.col("root_b")) & (F.col("id_a") < F.col("id_b"))
    match = match & (equal_minima("bits_a", "bits_b") >= least)
    for s in range(BANDS - 1):  # a pair counts in the first band that it shares
        match = match & ((F.lit(s) >= F.col("band")) | (F.col("bands_a")[s] != F.col("bands_b")[s]))
    for k in keys:
        match = match & (left[k] == right[k])
    pairs = session.durable(left.join(right, match).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    more = session.durable(confirmed(pairs, sets, percent))
    linked = common.components(links.unionByName(answers).unionByName(more), spark)

    roots = reps.join(linked.select(F.col("node").alias("id"), "root"), "id", "left")
    roots = roots.select(*set_keys, F.coalesce("root", "id").alias("root"))
    roots = session.durable(classes.join(roots, set_keys).select(*set_keys, "size", "root"))
    out = common.attach(signed.select("id", *set_keys), roots, set_keys, "size")
    own = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("root"))
    component = F.coalesce(own, F.col("id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, id_col="doc_id", text_col="text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The input's rows, all columns, without those whose component has a smaller id; rows of a kept id all stay."""
    gone = near_duplicates(docs, id_col, text_col, words, percent).filter("not kept").select(F.col("id").alias("__id"))
    gone = session.durable(gone.distinct())
    return docs.join(session.broadcast_if_small(gone), docs[id_col].cast("long") == F.col("__id"), "left_anti")
