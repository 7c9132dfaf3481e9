"""A Merkle manifest of a dataset: one digest for all rows, and for every row the proof that it belongs there.

Each group's rows, in order of id, are the leaves of a tree; runs of ``ARITY`` neighbours become their parent until one
node, the group's root, is left, and the groups' roots are the leaves of one more tree. The tree is evaluated by
time-forward processing. A node's label is (tree, level, place), so children come before parents. Digests are
messages addressed to the parent's label and wait in a priority queue ordered by it: when a label comes up, all its
children have arrived. The queue is external: leaves are cut into aligned blocks of ``ARITY ** LEVELS`` neighbours,
whose queue fits a task, and what leaves a block, one digest, goes to a written table that the next pass reads in label
order. So a pass climbs ``LEVELS`` levels, and a few passes suffice for any number of rows.

The reversed sweep takes the same labels from the root down. Every node hands its children the proof from itself to the
root; a child puts its own siblings before it. Between blocks these suffixes wait in a written table again.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark import session
from tidemark.llm import common

ARITY, LEVELS = 2, 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """'-' for null, else the number of UTF-8 bytes, ':' and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def digest_of(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def widened(rows: DataFrame, **added: str) -> StructType:
    schema = StructType(list(rows.schema.fields))
    for name, kind in added.items():
        schema.add(name, kind)
    return schema


def placed(leaves: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``leaves`` with their place in their tree (0, 1, ...) and the tree's number of leaves, written.

    Rows are range partitioned by (tree, order), numbered inside each written part, and the parts' counts carry the
    numbers on; no tree is sorted in one task, however large.
    """
    spark = leaves.sparkSession
    parted = leaves.repartitionByRange(common.shuffle_partitions(spark), tree, *order).sortWithinPartitions(tree, *order)
    schema = widened(parted, part="long", inside="long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            inside = []
            for t in batch.column(tree).to_pylist():
                last, n = (last, n + 1) if n and t == last else (t, 1)
                inside.append(n - 1)
            columns = [*batch.columns, pa.array([part] * batch.num_rows, pa.int64()), pa.array(inside, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "inside"])

    numbered = session.durable(parted.mapInArrow(number, schema))
    counts = session.durable(numbered.groupBy(tree, "part").agg(F.count("*").alias("rows")))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col(tree).alias("of_tree"), F.col("part").alias("of_part"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("carry"), F.sum("rows").over(whole).alias("total"),
    )
    same = numbered[tree].eqNullSafe(F.col("of_tree")) & (numbered["part"] == F.col("of_part"))
    joined = numbered.join(session.broadcast_if_small(session.durable(counts)), same)
    return session.durable(joined.select(*leaves.columns, (F.col("inside") + F.col("carry")).alias("place"), "total"))


def levels_above(total: int, arity: int) -> int:
    n = 0
    while total > 1:
        total, n = -(-total // arity), n + 1
    return n


def swept_up(digests: list[bytes], climb: int, arity: int) -> dict[tuple[int, int], bytes]:
    """Time-forward: digests of all nodes (level, place) of a block, ``climb`` levels above its leaves."""
    node = {}
    queue = [((0, k), k, d) for k, d in enumerate(digests)]  # (label, child, message), in order already
    while queue:
        label, _, message = heapq.heappop(queue)
        arrived = [message]
        while queue and queue[0][0] == label:
            arrived.append(heapq.heappop(queue)[2])
        node[label] = arrived[0] if label[0] == 0 else digest_of(arrived)
        if label[0] < climb:
            heapq.heappush(queue, ((label[0] + 1, label[1] // arity), label[1], node[label]))
    return node


def swept_down(node: dict[tuple[int, int], bytes], climb: int, above: bytes, arity: int) -> list[bytes]:
    """Reversed: the proof of each leaf of a block, given the proof ``above`` of the block's top.

    One record per level: the node's place in its run, the run's size, and the siblings' digests.
    """
    proof = {(climb, 0): above}
    width = {}
    for level, _ in node:
        width[level] = width.get(level, 0) + 1
    for level in range(climb - 1, -1, -1):
        for place in range(width[level]):
            first = place // arity * arity
            run = range(first, min(first + arity, width[level]))
            siblings = b"".join(node[level, k] for k in run if k != place)
            proof[level, place] = b"%d/%d/" % (place - first, len(run)) + siblings + b";" + proof[level + 1, place // arity]
    return [proof[0, place] for place in range(width[0])]


def siblings_of(proof: bytes) -> bytes:
    return b"".join(r.rsplit(b"/", 1)[1] for r in proof.split(b";") if r)


def folded(leaf: bytes, proof: bytes) -> bytes:
    """The root that follows from a leaf and its proof."""
    for record in proof.split(b";"):
        if record:
            at, _, digests = record.split(b"/")
            before = 64 * int(at)
            leaf = hashlib.sha256(digests[:before] + leaf + digests[before:]).hexdigest().encode()
    return leaf


def blocks_of(rows: DataFrame) -> DataFrame:
    """Rows in label order, every block of a tree in one task."""
    return session.by_key(rows, "tree", "block").sortWithinPartitions("tree", "block", "place")


def block_of(place: Column, arity: int, levels: int) -> Column:
    return F.floor(place / arity**levels).cast("long")


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after the other from sorted batches; a block is bounded, so is what is held."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["tree"], row["block"]) != key:
                yield held
                held = []
            key = (row["tree"], row["block"])
            held.append(row)
    if held:
        yield held


def climbed(rows: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> list[DataFrame]:
    """The passes of the sweep up: tables (tree, place, digest, total), the last with one row per tree.

    ``rows`` is the first of them. Trees that have reached their root stay as they are.
    """

    def climb(batches):
        for block in each_block(batches):
            up = min(levels, levels_above(block[0]["total"], arity))
            top = swept_up([r["digest"].encode() for r in block], up, arity)[up, 0]
            total = block[0]["total"]
            for _ in range(up):
                total = -(-total // arity)
            yield pa.RecordBatch.from_pylist(
                [{"tree": block[0]["tree"], "place": block[0]["block"], "digest": top.decode(), "total": total}], schema=out
            )

    out = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("digest", pa.string()), ("total", pa.int64())])
    passes = [rows]
    while passes[-1].filter("total > 1").limit(1).count():
        rows = passes[-1].select("tree", "place", "digest", "total", block_of(F.col("place"), arity, levels).alias("block"))
        passes.append(session.durable(blocks_of(rows).mapInArrow(climb, "tree string, place long, digest string, total long")))
    return passes


def lowered(passes: list[DataFrame], tops: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """The first pass's rows, all columns, with ``proof``, ``subroot`` and ``root`` from ``tops`` (tree, and these).

    A message to a block has place -1, so it comes up before the block's own nodes. All passes but the last are written.
    """
    sent = ["proof", "subroot", "root"]
    given = tops.select("tree", F.lit(0).cast("long").alias("place"), *sent)
    down = passes[:-1] or passes
    for k in range(len(down) - 1, -1, -1):
        rows = down[k] if k == 0 else down[k].select("tree", "place", "digest", "total")
        own = rows.withColumn("block", block_of(F.col("place"), arity, levels))
        message = given.withColumnRenamed("place", "block").withColumn("place", F.lit(-1).cast("long"))
        both = blocks_of(own.unionByName(message, allowMissingColumns=True))
        schema = widened(rows, **dict.fromkeys(sent, "string"))
        given = both.mapInArrow(lowering(to_arrow_schema(schema), arity, levels), schema)
        if k:
            given = session.durable(given.select("tree", "place", *sent))
    return given


def lowering(schema: pa.Schema, arity: int, levels: int):
    def lower(batches):
        for message, *block in each_block(batches):
            total = block[0]["total"]
            up = min(levels, levels_above(total, arity))
            node = swept_up([r["digest"].encode() for r in block], up, arity)
            proofs = swept_down(node, up, message["proof"].encode(), arity)
            for row, proof in zip(block, proofs, strict=True):
                row |= {"proof": proof.decode(), "subroot": message["subroot"], "root": message["root"]}
            yield pa.RecordBatch.from_pylist([{n: row[n] for n in schema.names} for row in block], schema=schema)

    return lower


def manifest(
    docs: DataFrame, id_col="doc_id", tree_col="lang", fields: list[str] | None = None, changed: dict[str, Column] | None = None,
    when: Column | None = None, arity: int = ARITY, levels: int = LEVELS,
) -> DataFrame:
    """(id, leaf, tampered, subroot, root, proof, proof_sha256, folded_root, verified), one row per input row.

    ``leaf`` is the digest of the columns ``fields``; ``tampered`` that of the row with the columns ``changed`` in place of
    its own where ``when`` holds, else ``leaf`` again; ``folded_root`` follows from it and the untouched siblings.
    ``subroot`` belongs to the row's tree (a null ``tree_col`` is a tree, the first), ``root`` to the whole table. Rows of
    a tree are ordered by id, null first, then by leaf, so repeated rows have neighbouring places and equal leaves.
    Null and empty values have digests of their own; a long text is one digest like any other. A tree of one row is its
    leaf. An empty table gives no rows. Columns outside ``fields`` are not read, whatever their names.
    """
    spark = common.prepare(docs.sparkSession)
    fields = fields or FIELDS
    plain = [docs[c] for c in fields]
    touched = [(changed or {}).get(c, docs[c]) for c in fields]
    leaf = leaf_digest(plain)
    other = F.when(F.coalesce(when, F.lit(False)), leaf_digest(touched)) if when is not None else F.lit(None).cast("string")
    leaves = docs.select(docs[id_col].cast("long").alias("id"), docs[tree_col].cast("string").alias("tree"), leaf.alias("digest"), other.alias("other"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")  # rows are short from here on
    rows = placed(session.durable(leaves), "tree", ["id", "digest"])
    passes = climbed(rows, arity, levels)
    tops = passes[-1].select(F.col("tree").alias("name"), F.lit("").alias("tree"), "digest")
    upper = placed(tops, "tree", ["name"])
    above = climbed(upper, arity, levels)
    root = above[-1].select("tree", F.lit("").alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    top = lowered(above, root, arity, levels)
    tops = session.durable(top.select(F.col("name").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"))
    proofs = lowered(passes, tops, arity, levels)

    def verify(batches):
        for batch in batches:
            proof = [p.encode() for p in batch.column("proof").to_pylist()]
            leaf = [d.encode() for d in batch.column("tampered").to_pylist()]
            again = [folded(d, p).decode() for d, p in zip(leaf, proof, strict=True)]
            siblings = [hashlib.sha256(siblings_of(p)).hexdigest() for p in proof]
            columns = [*batch.columns, pa.array(siblings, pa.string()), pa.array(again, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "proof_sha256", "folded_root"])

    tampered = F.coalesce("other", "digest").alias("tampered")
    out = proofs.select("id", F.col("digest").alias("leaf"), tampered, "subroot", "root", "proof")
    out = out.mapInArrow(verify, widened(out, proof_sha256="string", folded_root="string"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
