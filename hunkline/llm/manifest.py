"""Merkle manifest of a table by time-forward processing.

Every row is a leaf. The nodes of a group's tree are labelled (level, index);
a node's digest is the hash of its children's digests, so work goes forward in
label order, and messages carry it:

1. Leaf digests are built by Spark from the row's fields (the text is read
   once). Rows are range-partitioned on (group, order), numbered inside each
   range, and shifted by the sizes of the ranges before: a group of any size
   lies in many tasks.
2. Up: blocks of ``2**height`` consecutive nodes are aligned subtrees. In a
   block a priority queue ordered by node label delivers child digests to
   parents; the block's root is a message to the next round, where Spark's
   shuffle by label is the queue's external part. Each round divides the nodes by
   the block size, so a trillion leaves take four rounds.
3. The groups' roots, in order, are the leaves of the top tree, built alike.
4. Down: the rounds are swept in reverse. A node's proof is its siblings, then
   its parent's proof, so each block's root hands the proof it has been given to
   its children, down to the leaves. Leaves fold their proof back to the root.

No task holds more than a block; the driver reads two counts and one root digest.

Defined cases: a null field is written ``-``; null groups come first, null ids
before all others. Rows with equal ids are ordered by their digest; rows equal
in all fields are leaves of their own (their proofs differ, in either order). A
group of one leaf has that leaf as its root, and so has a table of one group. An
empty table gives no rows. Other columns are ignored and cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkline.llm.runtime import arrow_map, checkpointed, fields, remainder, ship, take

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEIGHT = 12      # levels of a block: 4,096 nodes
TAMPERED = 7     # rows whose crc32 of the id this divides are tampered with
_NODES = fields(("grp", "string"), ("pos", "long"), ("n", "long"), ("digest", "string"))


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above ``n`` nodes: 0 for a lone one."""
    return (n - 1).bit_length()


def leaf_digest(values: list[Column]) -> Column:
    """Hash of the fields, each ``-`` if null, else byte count, ``:`` and value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
             for v in values]
    return F.sha2(F.concat(*parts), 256)


class Block:
    """An aligned subtree over consecutive nodes, swept in label order."""

    def __init__(self, digests: list[str], height: int) -> None:
        self.height = height
        self.children: list[tuple[int, int, list[str]]] = []  # (level, index, child digests), in label order
        # a message: level and index of its receiver, index of its sender, digest
        queue = [(1, i >> 1, i, d) for i, d in enumerate(digests)]  # in label order: a heap
        self.root = digests[0]
        while queue and height:
            level, index = queue[0][:2]
            inputs = []
            while queue and queue[0][:2] == (level, index):
                inputs.append(heapq.heappop(queue)[3])
            self.children.append((level, index, inputs))
            self.root = digest(*inputs)
            if level < height:
                heapq.heappush(queue, (level + 1, index >> 1, index, self.root))

    def proofs(self, above: str) -> dict[int, str]:
        """Each leaf's steps up to the top, given the root's: ``L`` or ``R`` and the
        sibling on that side, or ``-`` where a node is hashed alone."""
        out = {0: above} if not self.height else {}
        queue = [(-self.height, 0, above)]  # the greatest label first
        for level, index, inputs in reversed(self.children):
            steps = heapq.heappop(queue)[2]
            for side, _ in enumerate(inputs):
                own = "-" if len(inputs) == 1 else ("R" + inputs[1], "L" + inputs[0])[side]
                child = 2 * index + side
                if level == 1:
                    out[child] = own + steps
                else:
                    heapq.heappush(queue, (1 - level, -child, own + steps))
        return out


def split_steps(steps: str) -> Iterator[tuple[str, str]]:
    """(side, sibling) of each step; the sibling is empty for ``-``."""
    at = 0
    while at < len(steps):
        size = 1 if steps[at] == "-" else 65
        yield steps[at], steps[at + 1:at + size]
        at += size


def fold(leaf: str, steps: str) -> str:
    """The root that a leaf and its steps lead to."""
    for side, sibling in split_steps(steps):
        leaf = digest(sibling, leaf) if side == "L" else digest(leaf, sibling)
    return leaf


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` (columns ``grp``, the order columns and others) with ``pos`` (from 0) in
    the group and the group's size ``n``. The order must be total."""
    ranged = df.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    place = df.columns.index("grp")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            grp = batch.column(place)
            new = np.ones(batch.num_rows, bool)
            if batch.num_rows:
                new[0] = grp[0].as_py() != last
                new[1:] = pc.not_equal(grp[1:], grp[:-1]).to_numpy(zero_copy_only=False)
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -seen))
            local = at - start
            if batch.num_rows:
                last, seen = grp[-1].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(local.astype(np.int64))],
                names=[*batch.schema.names, "part", "local"])

    rows = checkpointed(arrow_map(ranged, task, fields(*[(f.name, f.dataType) for f in df.schema], ("part", "integer"), ("local", "long"))))
    sizes = rows.groupBy("part", "grp").agg(F.count("*").alias("size"))  # at most one row a task and group
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "grp", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("skip"),
                           F.sum("size").over(Window.partitionBy("grp")).alias("n"))
    return (rows.join(offsets, ["part", "grp"]).withColumn("pos", F.col("local") + F.col("skip"))
            .select(*df.columns, "pos", "n"))


def _block(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", height))


def _sorted(data: pa.Table) -> pa.Table:
    return data.sort_by("pos")


def _swept(data: pa.Table, height: int) -> Block:
    return Block(data.column("digest").to_pylist(), min(height, levels(data.column("n")[0].as_py())))


def _down(keep: list[str], height: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's nodes with what their root was given, and their own steps."""
    def down(data: pa.Table, given: pa.Table) -> pa.Table:
        data = _sorted(data)
        found = _swept(data, height).proofs(given.column("steps")[0].as_py())
        subroot = pa.array([given.column("subroot")[0].as_py()] * data.num_rows, pa.string())
        return (data.select(keep).append_column("subroot", subroot)
                .append_column("steps", pa.array([found[i] for i in range(data.num_rows)], pa.string())))

    return down


class Forest:
    """The trees of all groups of ``nodes`` (``grp``, ``pos``, ``n``, ``digest``)."""

    def __init__(self, nodes: DataFrame, height: int = HEIGHT) -> None:
        ship(nodes.sparkSession)
        self.height, self.rounds = height, [nodes]
        most = nodes.agg(F.max("n")).first()[0] or 0

        def up(data: pa.Table) -> pa.Table:
            data = _sorted(data)
            n = (data.column("n")[0].as_py() + (1 << height) - 1) >> height
            return pa.table({"grp": data.column("grp")[:1], "pos": pa.array([data.column("pos")[0].as_py() >> height]),
                             "n": pa.array([n]), "digest": pa.array([_swept(data, height).root])})

        while most > 1:
            below = _block(self.rounds[-1].select("grp", "pos", "n", "digest"), height)
            self.rounds.append(checkpointed(below.groupBy("grp", "block").applyInArrow(up, _NODES)))
            most = (most + (1 << height) - 1) >> height

    def roots(self) -> DataFrame:
        return self.rounds[-1].select("grp", "digest")

    def proofs(self, above: DataFrame) -> DataFrame:
        """The nodes of the first round with ``subroot`` and ``steps`` to the top,
        given both for each group's root."""
        height = self.height
        steps = above.select("grp", F.lit(0).cast("long").alias("pos"), "subroot", "steps")
        if len(self.rounds) == 1:  # lone nodes only
            return self.rounds[0].join(steps, ["grp", "pos"])
        for nodes in reversed(self.rounds[:-1]):
            keep = nodes.columns if nodes is self.rounds[0] else ["grp", "pos"]
            schema = fields(*[(f.name, f.dataType) for f in nodes.schema if f.name in keep], ("subroot", "string"), ("steps", "string"))

            steps = (_block(nodes, height).groupBy("grp", "block")
                     .cogroup(steps.withColumnRenamed("pos", "block").groupBy("grp", "block"))
                     .applyInArrow(_down(keep, height), schema))
        return steps


def manifest(df: DataFrame, id_col: str = "doc_id", group: str = "lang", size: str = "n_chars",
             names: tuple[str, ...] = FIELDS, height: int = HEIGHT, tampered: int = TAMPERED) -> DataFrame:
    """One row per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.
    ``tampered`` adds 1 to ``size`` of the rows whose crc32 of the id it divides,
    after the tree is built."""
    rows = take(df, *names)
    bad = {c: (F.col(c).cast("decimal(38,0)") + 1 if c == size else F.col(c)) for c in names}
    leaf = leaf_digest([F.col(c) for c in names])
    leaves = checkpointed(rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("grp"), F.col(id_col).alias("id"), leaf.alias("digest"),
        F.when(remainder(F.col(id_col), tampered) == 0, leaf_digest([bad[c] for c in names])).alias("bad"),
        F.monotonically_increasing_id().alias("seq")))
    forest = Forest(checkpointed(numbered(leaves, ["id", "digest", "seq"]).drop("seq")), height)
    roots = checkpointed(forest.roots())
    order = roots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    top = Forest(checkpointed(numbered(order, ["of"])), height)
    found = top.roots().first()
    root = found.digest if found else ""
    ends = top.proofs(top.roots().select("grp", F.lit("").alias("subroot"), F.lit("").alias("steps")))
    below = forest.proofs(ends.select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), "steps"))
    schema = fields((id_col, df.schema[df.columns.index(id_col)].dataType), *[(c, "string") for c in (
        "leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", "boolean"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, bads, steps = (batch.column(i).to_pylist() for i in (1, 2, 3))
            proofs = [digest(*(s for _, s in split_steps(p))) for p in steps]
            folded = [fold(b or d, p) for d, b, p in zip(digests, bads, steps)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), pa.array([root] * len(proofs), pa.string()),
                 pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())],
                names=schema.names)

    return arrow_map(below.select("id", "digest", "bad", "steps", "subroot"), check, schema)
