"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learnt on a bounded sample so that the signs of the rotated vectors are balanced and
close to the values themselves. The signs are the code. Slices of the code index Hamming tables: a vector stands in one
cell of each, and looks into the cells reached by flipping its least certain bits. Vectors that meet, and whose whole
codes are near enough, are compared by cosine on the original vectors, in double precision.

Crowds never meet pair by pair. Equal vectors are one node with a weight. Where a cell is crowded, its mean becomes the
centre of a ball of half the threshold's angle: all that lie in one ball are linked with each other, which is counted,
not listed. Vectors outside a ball but near it are compared with its members block by block, which gives counts and one
link per block. Only vectors outside all balls go through the tables, where crowds are no longer possible.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import common

COSINE = 0.9
#: Vectors from which the rotation is learnt (the first by a hash of their values); every vector is indexed.
SAMPLE = 20_000
ROUNDS, SEED = 50, 17
#: Hamming tables, and cells that a vector looks into in each: its own and those across its least certain bits. Beyond
#: DIFFERENT bits of a slice expected to differ, every 0.45 more adds a table and doubles the cells (``effort``).
TABLES, PROBES, DIFFERENT = 5, 16, 1.9
#: Vectors for each cell of a table, on average: the length of the slices follows from the number of vectors.
OCCUPANCY = 8
#: Members from which on a cell may give a ball, and cells asked in one round (the next round asks the others).
CROWD, BALLS = 32, 2000
#: Rows on either side of a block of comparisons.
TILE = 500
#: Angles are compared with this margin, so that rounding never decides what is counted without a comparison.
MARGIN = 1e-7


class Quantiser:
    """Mean, principal axes and learnt rotations; ``values`` gives the numbers whose signs are the code."""

    def __init__(self, sample: np.ndarray, bits: int, centre: bool = True, seed: int = SEED, rounds: int = ROUNDS):
        dims = sample.shape[1]
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0) if centre else np.zeros(dims)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred + 1e-12 * np.eye(dims))
        parts = []
        for start in range(0, bits, dims):  # longer codes than dimensions come from further rotations
            width = min(dims, bits - start)
            kept = axes[:, ::-1][:, :width] if start == 0 else axes
            projected = centred @ kept
            turn = np.linalg.qr(rng.standard_normal((kept.shape[1], kept.shape[1])))[0]
            for _ in range(rounds):
                left, _, right = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
                turn = (left @ right).T
            parts.append((kept @ turn)[:, :width])
        self.turn = np.concatenate(parts, axis=1)

    def values(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.mean) @ self.turn


def bit_rate(sample: np.ndarray, cosine: float) -> tuple[float, bool]:
    """(share of bits in which a pair at the threshold differs, whether to take the mean away first).

    Taking the mean away balances the bits but widens angles if vectors lie close to it: with a centred squared norm r a
    pair at the threshold has cosine 1 - (1 - cosine) / r. Where that leaves little, the mean stays.
    """
    centred = sample - sample.mean(axis=0)
    r = np.quantile((centred**2).sum(axis=1), 0.05)
    left = 1 - (1 - cosine) / r if r > 0 else -1.0
    return (math.acos(left) / math.pi, True) if left >= 0.3 else (math.acos(cosine) / math.pi, False)


def effort(n: int, rate: float) -> tuple[int, int, int, int]:
    """(bits of a slice, tables, cells looked into per table, bits of the whole code) for ``n`` vectors.

    Recall does not fall as ``n`` grows: tables and cells follow the bits of a slice expected to differ at the threshold. The
    whole code is so long that linked and unrelated pairs lie nine deviations apart.
    """
    width = min(62, max(4, math.ceil(math.log2(max(2, n / OCCUPANCY)))))
    more = max(0, math.ceil((width * rate - DIFFERENT) / 0.45))
    tables, probes = TABLES + more, PROBES << min(more, 10)
    return width, tables, len(flips(width, probes)), max(math.ceil((4.5 / (0.5 - rate)) ** 2), tables * width)


def flips(width: int, probes: int) -> np.ndarray:
    """probes x width: which of a slice's bits, ordered from the least certain on, are flipped together.

    Sets of bits in order of their expected cost, the squared distance to the other side of their planes.
    """
    drawn = np.sort(np.abs(np.random.default_rng(5).standard_normal((4000, width))), axis=1)
    cost = (drawn**2).mean(axis=0)
    near = range(min(width, 12))
    sets = [s for k in range(0, 7) for s in itertools.combinations(near, k)]
    sets = sorted(sets, key=lambda s: (sum(cost[k] for k in s), s))[:probes]
    out = np.zeros((len(sets), width), bool)
    for row, one in enumerate(sets):
        out[row, list(one)] = True
    return out


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as one array."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, unit, dims); ``unit`` is null where a vector can't be linked: null, empty, zero or not finite, or no id."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = F.coalesce(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite), F.lit(False))
    rows = rows.withColumn("largest", F.when(fit, F.array_max(F.transform("v", F.abs))))
    scaled = F.transform("v", lambda x: x / F.col("largest"))  # no overflow in the squares
    rows = rows.withColumn("v", F.when(F.col("largest") > 0, scaled))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("id", F.transform("v", lambda x: x / norm).alias("unit"), F.size("v").alias("dims"))


def coded(nodes: DataFrame, quantiser: Quantiser, width: int, tables: int, probes: int) -> DataFrame:
    """(node, code, cells, looks): the code's words, the own cell of each table, and the cells looked into."""
    sent = nodes.sparkSession.sparkContext.broadcast((quantiser, flips(width, probes)))

    def code(batches):
        learnt, flip = sent.value
        weight = np.int64(1) << np.arange(width, dtype=np.int64)
        for batch in batches:
            values = learnt.values(matrix(batch.column("unit")))
            ones = values > 0
            padded = np.zeros((len(ones), -(-ones.shape[1] // 64) * 64), np.uint8)
            padded[:, : ones.shape[1]] = ones
            words = np.packbits(padded, axis=1, bitorder="little").view("<i8")
            cells, looks = [], []
            for t in range(tables):
                part = slice(t * width, (t + 1) * width)
                own = ones[:, part] @ weight
                order = np.argsort(np.abs(values[:, part]), axis=1, kind="stable")
                cells.append(own)
                looks.append(own[:, None] ^ (weight[order] @ flip.T.astype(np.int64)))
            lists = lambda x: pa.array(list(x), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), lists(words), lists(np.stack(cells, axis=1)), lists(np.concatenate(looks, axis=1))],
                ["node", "code", "cells", "looks"],
            )

    rows = nodes.select("node", "unit")
    return rows.mapInArrow(code, "node long, code array<long>, cells array<long>, looks array<long>")


def most_different(bits: int, rate: float) -> int:
    """Different bits beyond which a linked pair is not expected: five deviations over the mean at the threshold."""
    return math.ceil(bits * rate + 5 * math.sqrt(bits * rate * (1 - rate)))


def different(a: str, b: str, words: int):
    total = F.lit(0)
    for w in range(words):
        total = total + F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w]))
    return total


def centres_of(free: DataFrame, nodes: DataFrame, half: float) -> np.ndarray:
    """Unit means of the most crowded cells, at most BALLS of them, none within ``half`` of a more crowded one's."""
    placed = free.select("node", F.posexplode("cells").alias("t", "cell"))
    sizes = placed.groupBy("t", "cell").agg(F.count("*").alias("rows")).filter(F.col("rows") >= CROWD)
    top = session.durable(sizes.orderBy(F.desc("rows"), "t", "cell").limit(BALLS))
    members = placed.join(F.broadcast(top), ["t", "cell"]).join(nodes.select("node", "unit"), "node")  # BALLS rows at most
    sums = members.select("t", "cell", "rows", F.posexplode("unit").alias("k", "x")).groupBy("t", "cell", "rows", "k")
    sums = sums.agg(F.sum("x").alias("x")).groupBy("t", "cell", "rows")
    means = sums.agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("c")).orderBy(F.desc("rows"), "t", "cell")
    kept: list[np.ndarray] = []
    for row in means.collect():  # at most BALLS rows of one vector
        centre = np.array([x["x"] for x in row["c"]])
        norm = np.linalg.norm(centre)
        if norm > 0 and not (kept and (np.stack(kept) @ (centre / norm)).max() >= math.cos(half)):
            kept.append(centre / norm)
    return np.stack(kept) if kept else np.empty((0, 0))


def balls(nodes: DataFrame, codes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Members (node, ball, angle), each node in one ball at most, and asks (node, ball, angle): nodes outside a ball
    that are near enough to be linked with one of its members.

    Rounds end when no cell gives a ball of two nodes or more. A round sends at most BALLS centres to the tasks.
    """
    spark = nodes.sparkSession
    whole = math.acos(cosine)
    half = whole / 2 - MARGIN
    free, members, asks, done = codes.select("node", "cells"), [], [], 0
    while True:
        centres = centres_of(free, nodes, half)
        if not len(centres):
            break
        sent = spark.sparkContext.broadcast((centres, done))

        def near(batches, sent=sent):
            centres, first = sent.value
            for batch in batches:
                angles = np.arccos(np.clip(matrix(batch.column("unit")) @ centres.T, -1, 1))
                best = np.where(batch.column("free").to_numpy(zero_copy_only=False), angles.argmin(axis=1), -1)
                row, ball = np.nonzero(angles <= whole + half + MARGIN)
                inside = (best[row] == ball) & (angles[row, ball] <= half)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(pa.array(row)), pa.array(ball + first), pa.array(angles[row, ball]), pa.array(inside)],
                    ["node", "ball", "angle", "inside"],
                )

        rows = nodes.join(session.broadcast_if_small(free.select("node", F.lit(True).alias("free"))), "node", "left")
        rows = rows.select("node", "unit", F.coalesce("free", F.lit(False)).alias("free"))
        met = session.durable(rows.mapInArrow(near, "node long, ball long, angle double, inside boolean"))
        sizes = session.durable(met.filter("inside").groupBy("ball").agg(F.count("*").alias("rows")))
        held = met.join(session.broadcast_if_small(sizes.filter("rows > 1").select("ball")), "ball", "left_semi")
        found = session.durable(held.filter("inside").select("node", "ball", "angle"))
        if not found.limit(1).count():
            break
        members.append(found)
        asks.append(session.durable(held.filter("not inside").select("node", "ball", "angle")))
        free = session.durable(free.join(session.broadcast_if_small(found.select("node")), "node", "left_anti"))
        done += len(centres)
    none = spark.createDataFrame([], "node long, ball long, angle double")
    join = lambda parts: session.durable(functools.reduce(DataFrame.unionByName, parts)) if parts else none
    return join(members), join(asks)


def asked(asks: DataFrame, members: DataFrame, stats: DataFrame, nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Counts (node, n) and links (a, b) between balls and the nodes near them.

    A node so near that it is linked with all members is counted as such. The others are compared in blocks of TILE
    nodes by TILE members. A block gives each of its nodes a count and one link; a member's own count comes from here
    only if the node is in no ball, for else the member asks too.
    """
    whole = math.acos(cosine)
    weights = nodes.select("node", "weight")
    inside = members.select("node").withColumn("held", F.lit(True))
    rows = asks.join(weights, "node").join(inside, "node", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    rows = common.attach(session.durable(rows), stats, ["ball"], "members")
    rows = session.durable(rows)
    sure = rows.filter(F.col("angle") + F.col("radius") <= whole - MARGIN)
    added = session.durable(sure.filter("not held").groupBy("ball").agg(F.sum("weight").alias("n")))
    to_members = members.select("node", "ball").join(session.broadcast_if_small(added), "ball").select("node", "n")
    counts = sure.select("node", F.col("ball_weight").alias("n")).unionByName(to_members)
    links = sure.select(F.col("node").alias("a"), F.col("first").alias("b"))

    open_rows = rows.filter(F.col("angle") + F.col("radius") > whole - MARGIN)
    open_rows = open_rows.filter(F.col("angle") - F.col("radius") <= whole + MARGIN)
    asking = session.durable(open_rows.groupBy("ball").agg(F.count("*").alias("asking")))
    sizes = session.durable(stats.join(asking, "ball").select("ball", "members", "asking"))
    lanes, parts = (F.ceil(F.col(c) / F.lit(TILE)).cast("int") for c in ("asking", "members"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    ask = common.attach(open_rows.select("ball", "node", "weight", "held"), sizes, ["ball"], "asking")
    ask = ask.select("ball", "node", "weight", "held", deal(lanes).alias("lane"), every(parts).alias("part"))
    say = common.attach(members.select("ball", "node"), sizes, ["ball"], "members").filter("asking is not null")
    say = say.select("ball", "node", deal(parts).alias("part"), every(lanes).alias("lane"))
    keys = ["ball", "lane", "part"]
    left = session.durable(ask).join(nodes.select("node", F.col("unit").alias("asking_unit")), "node").groupBy(*keys)
    right = nodes.select("node", F.col("unit").alias("member_unit"), F.col("weight").alias("member_weight"))
    right = session.durable(say).join(right, "node").groupBy(*keys)

    def compare(questions: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"node": [], "n": [], "link": []}
        if questions.num_rows and answers.num_rows:
            linked = matrix(questions.column("asking_unit")) @ matrix(answers.column("member_unit")).T >= cosine
            own, others = (t.column("node").to_numpy() for t in (questions, answers))
            n = linked @ answers.column("member_weight").to_numpy()
            some = np.flatnonzero(n)
            loose = np.where(questions.column("held").to_numpy(), 0, questions.column("weight").to_numpy())
            back = loose @ linked
            more = np.flatnonzero(back)
            out["node"] = [*own[some], *others[more]]
            out["n"] = [*n[some], *back[more]]
            out["link"] = [*others[linked[some].argmax(axis=1)], *[None] * len(more)]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    compared = session.durable(left.cogroup(right).applyInArrow(compare, "node long, n long, link long"))
    counts = counts.unionByName(compared.select("node", "n"))
    links = links.unionByName(compared.filter("link is not null").select(F.col("node").alias("a"), F.col("link").alias("b")))
    return counts, links


def met_in_tables(codes: DataFrame, nodes: DataFrame, bits: int, probes: int, most: int, cosine: float) -> DataFrame:
    """Linked pairs (a, b), a < b, of nodes of which one looks into a cell of the other."""
    words = -(-bits // 64)
    own = codes.select(F.col("node").alias("a"), F.col("code").alias("code_a"), F.posexplode("cells").alias("t", "cell"))
    looks = codes.select(F.col("node").alias("b"), F.col("code").alias("code_b"), F.posexplode("looks").alias("at", "cell"))
    looks = looks.select("b", "code_b", F.floor(F.col("at") / probes).cast("int").alias("t"), "cell")
    near = (F.col("a") != F.col("b")) & (different("code_a", "code_b", words) <= most)
    pairs = own.join(looks, ["t", "cell"]).filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = session.durable(pairs.distinct())

    def rerank(batches):
        for batch in batches:
            cos = np.einsum("ij,ij->i", matrix(batch.column("unit_a")), matrix(batch.column("unit_b")))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(cos >= cosine)) for c in (batch.column("a"), batch.column("b"))], ["a", "b"]
            )

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("unit").alias(f"unit_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "unit_a", "unit_b")
    return session.durable(both.mapInArrow(rerank, "a long, b long"))


def sampled(nodes: DataFrame, n: int, sample: int) -> np.ndarray:
    """The documented sample: the first ``sample`` of ``n`` vectors by a hash. Only about twice as many are sorted."""
    scale = 1 << 31
    rank = F.pmod(F.xxhash64("unit"), F.lit(scale))
    low = nodes.filter(rank <= min(scale, 2 * sample * scale // max(1, n) + 4096 * scale // max(1, n)))
    return matrix(low.orderBy(rank, "node").limit(sample).select("unit").toArrow().column("unit"))


def linked_nodes(nodes: DataFrame, cosine: float, sample: int) -> tuple[DataFrame, DataFrame]:
    """Counts (node, n) of linked vectors in other nodes, and links (a, b) that connect all that is linked.

    ``nodes`` (node, unit, weight) is a written table of vectors of one length.
    """
    n = nodes.count()
    learnt = sampled(nodes, n, sample)
    rate, centre = bit_rate(learnt, cosine)
    width, tables, probes, bits = effort(n, rate)
    quantiser = Quantiser(learnt, bits, centre)
    codes = session.durable(coded(nodes, quantiser, width, tables, probes))
    members, asks = balls(nodes, codes, cosine)
    weighed = members.join(nodes.select("node", "weight"), "node")
    stats = session.durable(
        weighed.groupBy("ball").agg(
            F.sum("weight").alias("ball_weight"), F.count("*").alias("members"), F.max("angle").alias("radius"), F.min("node").alias("first")
        )
    )
    inside = common.attach(session.durable(weighed), stats, ["ball"], "members")
    counts, links = asked(asks, members, stats, nodes, cosine)
    counts = counts.unionByName(inside.select("node", (F.col("ball_weight") - F.col("weight")).alias("n")))
    links = links.unionByName(inside.select(F.col("node").alias("a"), F.col("first").alias("b")).filter("a <> b"))
    free = session.durable(codes.join(session.broadcast_if_small(members.select("node")), "node", "left_anti"))
    pairs = met_in_tables(free, nodes, bits, probes, most_different(bits, rate), cosine)
    two = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = counts.unionByName(two.join(nodes.select(F.col("node").alias("b"), "weight"), "b").select(F.col("a").alias("node"), F.col("weight").alias("n")))
    return counts.groupBy("node").agg(F.sum("n").alias("n")), links.unionByName(pairs)


def near_vectors(
    vectors: DataFrame, id_col="vec_id", vector_col="embedding", cosine: float = COSINE, sample: int = SAMPLE
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row.

    Vectors are linked when their cosine is ``cosine`` (over 0) or more; ``n_links`` counts the other vectors linked
    directly, ``component_id`` is the smallest id reachable by links, and that vector is kept. The tables find a linked pair
    with a probability near 1 (tests measure it); no found pair is below the threshold. Vectors that are null, empty,
    zero, or hold null or non-finite components are linked with nothing, as are rows with a null id; vectors of different
    lengths are never linked, each length is handled in turn. Rows that repeat id and vector count as one vector and share
    its result; a repeated id with another vector is one more vector. An empty table gives no rows.
    """
    spark = common.prepare(vectors.sparkSession)
    names = [F.xxhash64("unit").alias("name_1"), F.xxhash64(F.lit(1), "unit").alias("name_2")]
    rows = session.durable(unit_vectors(vectors, id_col, vector_col).select("id", "unit", "dims", *names))
    keys = ["name_1", "name_2"]
    valid = rows.filter("unit is not null")
    once = valid.groupBy("id", *keys).agg(F.first("unit").alias("unit"), F.first("dims").alias("dims"))
    classes = once.groupBy(*keys).agg(
        F.min("id").alias("least"), F.count("*").alias("weight"), F.first("unit").alias("unit"), F.first("dims").alias("dims")
    )
    classes = session.durable(classes.withColumn("node", F.monotonically_increasing_id()))
    alone = rows.filter("unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    counts, links = [], []
    for row in classes.select("dims").distinct().orderBy("dims").collect():
        nodes = session.durable(classes.filter(F.col("dims") == row["dims"]).select("node", "unit", "weight"))
        n, found = linked_nodes(nodes, cosine, sample)
        counts.append(session.durable(n))
        links.append(session.durable(found))
    if not counts:
        return alone.withColumn("kept", F.lit(True))
    counts, links = (functools.reduce(DataFrame.unionByName, parts) for parts in (counts, links))
    roots = common.components(links, spark).withColumnRenamed("node", "of_node")
    known = classes.join(counts, "node", "left").join(roots, F.col("node") == F.col("of_node"), "left")
    n_links = (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    known = session.durable(known.select(*keys, "least", "weight", F.coalesce("root", "node").alias("root"), n_links))
    least = session.durable(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")))
    known = session.durable(common.attach(known, least, ["root"], "size").select(*keys, "weight", "component_id", "n_links"))
    found = common.attach(valid.select("id", *keys), known, keys, "weight").select("id", "n_links", "component_id")
    return found.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
