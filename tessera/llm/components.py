"""Connected components of an edge table, by hooking, pointer jumping and contraction, on the cluster alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let_go

#: Rounds before giving up; each at least halves the nodes that still have edges.
ROUNDS = 60
#: Edges up to which labels are broadcast, 256 KB, instead of dealt out to all shuffle partitions again and again.
SMALL = 1 << 14
#: Edges that a task joins to trees at a time.
LOCAL = 1 << 16


class Forest:
    """Union-find over the nodes that a task has linked; gives one edge per node but the roots, which are the least of their trees.

    ``joined`` are the pairs that joined two trees, as many as those edges.
    """

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.joined: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        path = []
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            parent[p] = x
        return x

    def link(self, a: int, b: int) -> None:
        pair = (a, b)
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.joined.append(pair)


def sent(labels: DataFrame, rows: int) -> DataFrame:
    """The labels, marked for broadcasting where they are few; the rows of a join with them are the same."""
    return F.broadcast(labels) if rows <= SMALL else labels


def joined(edges: DataFrame, rows: int) -> DataFrame:
    """The edges (a, b), a > b, with each LOCAL of them replaced by edges from the nodes of their trees to the least: no more edges, but shorter chains."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held = 0

        def trees() -> pa.RecordBatch:
            nodes = list(forest.parent)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(forest.root, nodes), pa.int64())], names=["a", "b"])

        for batch in batches:
            for start in range(0, batch.num_rows, LOCAL):
                piece = batch.slice(start, LOCAL)
                if held and held + piece.num_rows > LOCAL:
                    yield trees()
                    forest, held = Forest(), 0
                held += piece.num_rows
                for a, b in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    forest.link(a, b)
        yield trees()

    return edges.select("a", "b").coalesce(max(1, -(-rows // LOCAL))).mapInArrow(work, "a long, b long")


def jumped(hooks: DataFrame, rows: int) -> DataFrame:
    """(node, label) with every label replaced by the end of its chain of labels."""
    for _ in range(ROUNDS):
        up = hooks.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = checkpointed(hooks.join(sent(up, rows), "label", "left").select("node", F.coalesce("up", "label").alias("label"), F.col("up").isNotNull().alias("moved")), rows)
        hooks = step.select("node", "label")
        let_go(step.sparkSession)
        if step.where("moved").isEmpty():
            return hooks
    raise RuntimeError(f"labels did not settle in {ROUNDS} rounds")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of an edge table (a, b) of longs; a component is its smallest node.

    Each round has every task join the edges that it reads to trees, hooks every node to its least smaller neighbour, follows the hooks to
    their ends, and keeps the edges between different ends. Chains settle in one round, so edges are joined about once, however large a group
    is. With the trees, chains of hooks are short, so there are few jumps, and few small jobs for the driver to plan and to keep.
    What is found is written to the checkpoint folder, so an executor may be lost. Loops and repeated edges do no harm. Each round's
    shuffle files and plans are let go at once, so the driver's memory and the disk don't grow with the rounds.
    """
    left = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    rows = left.count()
    found: DataFrame | None = None
    for _ in range(ROUNDS):
        if left.isEmpty():
            break
        left = checkpointed(joined(left, rows), rows)
        hooks = jumped(checkpointed(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), rows), rows)
        of_a = hooks.select(F.col("node").alias("a"), F.col("label").alias("x"))
        of_b = hooks.select(F.col("node").alias("b"), F.col("label").alias("y"))
        ends = left.join(sent(of_a, rows), "a").join(sent(of_b, rows), "b", "left").select("x", F.coalesce("y", "b").alias("y")).where(F.col("x") != F.col("y"))
        left = checkpointed(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), rows)
        if found is not None:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("up"))
            hooks = found.join(sent(up, rows), "label", "left").select("node", F.coalesce("up", "label").alias("label")).unionByName(hooks)
        found = checkpointed(hooks, 2 * rows)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = found.select(F.col("label").alias("node"), "label").distinct()
    return sent(found.unionByName(roots).withColumnRenamed("label", "component"), rows)
