"""Transitive closure and what rests on it, semi-naive: each round joins only the pairs that the last one found.

Without given starts, pairs are joined with all pairs found so far, so that paths double in length each round; a chain of a
million steps takes 20 rounds. From given starts, a round takes one step, as only what they reach is wanted.
Both end when a round finds nothing new, and return the whole closure.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cycles import strong_components
from .lineage import stored


#: Tables that a closure consists of at most.
MOST_PARTS = 24


def transitive(edges: DataFrame, keys: Sequence[str] = (), start: DataFrame | None = None) -> DataFrame:
    """All (keys..., x, y) with a path of one edge or more, from edges (keys..., x, y); cycles are fine.

    ``start`` (keys..., x) restricts the first ends, so that only what they reach is computed.
    """
    keys = list(keys)
    edges = stored(edges.select(*keys, "x", "y").distinct(), "edges")
    parts = [stored(edges.join(start.distinct(), [*keys, "x"], "left_semi"), "pairs") if start is not None else edges]
    new = parts[0]
    while True:
        found = reduce(DataFrame.unionByName, parts)
        step = (found if start is None else edges).select(*keys, F.col("x").alias("y"), F.col("y").alias("z"))
        longer = new.join(step, [*keys, "y"]).select(*keys, "x", F.col("z").alias("y")).distinct()
        new = stored(longer.join(found, [*keys, "x", "y"], "left_anti"), "pairs")
        if new.isEmpty():
            return found
        # Each round's pairs are a table of their own, written once; only many rounds of single steps are put together now and then.
        parts = [*parts, new] if len(parts) < MOST_PARTS else [stored(found.unionByName(new), "pairs")]


def cycles(edges: DataFrame) -> DataFrame:
    """The nodes (x) that reach themselves, by components instead of pairs."""
    return strong_components(edges).select(F.col("node").alias("x"))


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(x): the roots and all that edges (x, y) lead them to.

    Steps double along nodes with one way out, so a long chain takes a number of rounds that grows with its logarithm; where
    ways part, each round takes one step. Only nodes are kept, no pairs.
    """
    edges = stored(edges.select("x", "y").distinct(), "edges")
    single = stored(edges.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("next")).where("n = 1").select("x", "next"), "single")
    jumps, most = [single], single.count()
    while 2 ** (len(jumps) - 1) < most:
        ahead = jumps[-1].select(F.col("x").alias("next"), F.col("next").alias("far"))
        step = stored(jumps[-1].join(ahead, "next").select("x", F.col("far").alias("next")), "jumps")
        if step.isEmpty():
            break
        jumps.append(step)
    found = stored(roots.select("x").distinct(), "reached")
    new = found
    while True:
        # All nodes on the ways that begin at the new ones: from the longest jumps to the shortest, each doubles what was found.
        ahead = new.join(edges, "x").select(F.col("y").alias("x")).distinct()
        for jump in reversed(jumps):
            ahead = stored(ahead.unionByName(ahead.join(jump, "x").select(F.col("next").alias("x"))).distinct(), "ahead")
        new = stored(ahead.join(found, "x", "left_anti"), "reached")
        if new.isEmpty():
            return found
        found = found.unionByName(new)


def orphans(nodes: DataFrame, required_by: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes (x) that no root (x) leads to, given (x needs y) edges: what a cascade of removals takes away."""
    return nodes.select("x").distinct().join(reached(required_by, roots), "x", "left_anti")
