"""Strongly connected components of a graph, without its closure.

A node with one way out can only return by way of it, so all such nodes are led to the end of their ways by pointers that double; their
in-edges move there, and a ring of such nodes is a component by itself. The same is done against the edges' direction, and nodes without a
way in or out go. So chains, trees and rings of any length take a number of rounds that grows with its logarithm. What is left, where every node has
several ways in and out, is coloured: the least name that reaches a node forwards, then backwards within a colour. Those rounds grow
with the diameter of what is left. No pairs of nodes that reach each other are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import stored


class Contraction:
    """Nodes with one way out, led to the end of their ways."""

    def __init__(self, edges: DataFrame, jumps: list[DataFrame], reverse: bool) -> None:
        self.jumps, self.reverse = jumps, reverse
        last = jumps[-1]
        own = last.select(F.col("x").alias("next"))
        bound = last.join(own, "next", "left_semi")
        #: (x, next): nodes and the node at the end of their way, which has several ways out or none.
        self.rooted = stored(last.join(own, "next", "left_anti"), "rooted")
        ring = stored(bound.select(F.col("next").alias("x")).distinct(), "ring")
        #: (node, component): rings of nodes with one way out.
        self.rings = self.least_around(ring)
        # What leads into a ring, or lies on one, has no other way: its edges are done.
        several = edges.join(last.select("x"), "x", "left_anti")
        led = several.join(self.rooted.select(F.col("x").alias("y"), F.col("next").alias("root")), "y", "left")
        led = led.join(bound.select(F.col("x").alias("y")), "y", "left_anti")
        #: (x, first, root): edges into a way, with the way's end.
        self.entries = stored(led.where("root IS NOT NULL").select("x", F.col("y").alias("first"), "root"), "entries")
        self.left = stored(led.select("x", F.coalesce("root", "y").alias("y")).where("x <> y").distinct(), "contracted")
        #: Nodes that a way leads back to: a cycle of their own, even where no edge is left.
        self.returns = self.entries.where("x = root").select(F.col("x").alias("node"))

    def least_around(self, ring: DataFrame) -> DataFrame:
        label = ring.select("x", F.col("x").alias("component"))
        for jump in self.jumps:
            ahead = jump.join(ring, "x", "left_semi").join(label.select(F.col("x").alias("next"), F.col("component").alias("other")), "next")
            label = stored(label.join(ahead.select("x", "other"), "x").select("x", F.least("component", "other").alias("component")), "ring")
        return label.select(F.col("x").alias("node"), "component")

    def labelled(self, found: DataFrame) -> DataFrame:
        """(node, component) of the nodes on ways that lie on a cycle, given those of the graph that is left (alone is a node by itself)."""
        label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_label"))
        named = self.entries.join(label("x"), "x", "left").join(label("root"), "root", "left")
        marks = stored(named.where(F.coalesce("x_label", "x") == F.coalesce("root_label", "root")).select(F.col("first").alias("x"), F.coalesce("root_label", "root").alias("component")).distinct(), "marks")
        for jump in self.jumps:
            ahead = marks.join(jump.join(self.rooted.select("x"), "x", "left_semi"), "x").select(F.col("next").alias("x"), "component")
            ahead = ahead.join(self.rooted.select("x"), "x", "left_semi")
            marks = stored(marks.unionByName(ahead).distinct(), "marks")
        return marks.select(F.col("x").alias("node"), "component").unionByName(self.rings)


def contraction(edges: DataFrame, reverse: bool) -> Contraction | None:
    """None where no node has a single way out."""
    if reverse:
        edges = edges.select(F.col("y").alias("x"), F.col("x").alias("y"))
    single = stored(edges.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("next")).where("n = 1").select("x", "next"), "single")
    n = single.count()
    if not n:
        return None
    jumps = [single]
    while 2 ** (len(jumps) - 1) < n:
        ahead = jumps[-1].select(F.col("x").alias("next"), F.col("next").alias("far"))
        step = stored(jumps[-1].join(ahead, "next", "left").select("x", F.coalesce("far", "next").alias("next"), F.col("far").isNotNull().alias("moved")), "jumps")
        if step.where("moved").isEmpty():
            break
        jumps.append(step.select("x", "next"))
    return Contraction(edges, jumps, reverse)


def trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges to nodes that have no way out, or from nodes that have no way in."""
    sources, ends = edges.select(F.col("x").alias("y")).distinct(), edges.select(F.col("y").alias("x")).distinct()
    return stored(edges.join(sources, "y", "left_semi").join(ends, "x", "left_semi").select("x", "y"), "trimmed")


def spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(node, colour) after every node has taken the least colour that leads to it; only nodes that changed tell others."""
    changed = label
    while True:
        told = changed.join(edges, changed["node"] == edges["x"]).groupBy(F.col("y").alias("node")).agg(F.min("colour").alias("other"))
        step = stored(label.join(told, "node", "left").select("node", F.least("colour", F.coalesce("other", "colour")).alias("colour"), (F.col("other") < F.col("colour")).alias("moved")), "colours")
        label, changed = step.select("node", "colour"), step.where("moved").select("node", "colour")
        if changed.isEmpty():
            return label


def coloured(edges: DataFrame) -> DataFrame:
    """(node, component) of the components with more than one node, by forward and backward reach."""
    found = []
    while not edges.isEmpty():
        nodes = edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct().withColumn("colour", F.col("node"))
        colour = spread(edges, nodes)
        at = lambda c: colour.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))  # noqa: E731,B023
        inner = stored(edges.join(at("x"), "x").join(at("y"), "y").where("x_colour = y_colour").select("x", "y", F.col("x_colour").alias("colour")), "inner")
        reached = stored(colour.where("node = colour").select("node", "colour"), "reached")
        new = reached
        while not new.isEmpty():
            back = inner.join(new.select(F.col("node").alias("y"), "colour"), ["y", "colour"]).select(F.col("x").alias("node"), "colour").distinct()
            new = stored(back.join(reached, ["node", "colour"], "left_anti"), "reached")
            reached = reached.unionByName(new)
        found.append(stored(reached.select("node", F.col("colour").alias("component")), "component"))
        done = found[-1].select("node")
        edges = trimmed(edges.join(done.withColumnRenamed("node", "x"), "x", "left_anti").join(done.withColumnRenamed("node", "y"), "y", "left_anti"))
    every = reduce(DataFrame.unionByName, found) if found else edges.select(F.col("x").alias("node"), F.col("y").alias("component"))
    size = every.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return every.join(size, "component", "left_semi").select("node", "component")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (x, y) that lies on a cycle, loops included; nodes that reach each other share a component."""
    edges = edges.where("x IS NOT NULL AND y IS NOT NULL").select("x", "y").distinct()
    loops = stored(edges.where("x = y").select(F.col("x").alias("node")), "loops")
    left = trimmed(edges.where("x <> y"))
    steps: list[Contraction] = []
    reverse, idle = False, 0
    while idle < 2 and not left.isEmpty():
        step = contraction(left, reverse)
        idle = 0 if step is not None else idle + 1
        if step is not None:
            steps.append(step)
            left = step.left.select(F.col("y").alias("x"), F.col("x").alias("y")) if reverse else step.left
            left = trimmed(left)
        reverse = not reverse
    found = coloured(left)
    for step in reversed(steps):
        alone = step.returns.distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
        found = stored(found.unionByName(alone), "component")
        found = stored(found.unionByName(step.labelled(found)), "component")
    alone = loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
