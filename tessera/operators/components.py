"""Classes of connected terms, by hooking to the least neighbour, pointer jumping and contraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import let_go, stored


def settled(hooks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., node, up) with every ``up`` replaced by the end of its chain; a chain halves in each round."""
    while True:
        above = hooks.select(*keys, F.col("node").alias("up"), F.col("up").alias("top"))
        step = stored(hooks.join(above, [*keys, "up"], "left").select(*keys, "node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "hooks")
        hooks = step.select(*keys, "node", "up")
        if step.where("moved").isEmpty():
            return hooks


def representatives(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., node, rep) of every node of the edges (keys..., x, y) but the least of its class, which is the rep.

    A class of any size in form of a star or a chain settles in one round of hooks; each further round at least halves the nodes that still
    have edges. Edges are joined once a round, and no pairs of members are made.
    """
    keys = list(keys)
    ordered = lambda df: stored(df.where(F.col("x") != F.col("y")).select(*keys, F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    left = ordered(edges)
    found = left.select(*keys, F.col("x").alias("node"), F.col("y").alias("rep")).limit(0)
    while not left.isEmpty():
        hooks = settled(stored(left.groupBy(*keys, F.col("x").alias("node")).agg(F.min("y").alias("up")), "hooks"), keys)
        at = lambda column, name: hooks.select(*keys, F.col("node").alias(column), F.col("up").alias(name))  # noqa: E731,B023
        ends = left.join(at("x", "a"), [*keys, "x"]).join(at("y", "b"), [*keys, "y"], "left")
        left = ordered(ends.select(*keys, F.col("a").alias("x"), F.coalesce("b", "y").alias("y")))
        over = found.join(at("rep", "a"), [*keys, "rep"], "left").select(*keys, "node", F.coalesce("a", "rep").alias("rep"))
        found = stored(over.unionByName(hooks.withColumnRenamed("up", "rep")), "classes")
        let_go(found.sparkSession)
    return found
