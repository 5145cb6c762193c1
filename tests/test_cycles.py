"""Strongly connected components and reach against searches from every node; long rings and chains."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import closure, cycles, lineage


def reach(edges, x):
    seen, todo = set(), [x]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def brute(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    ahead = {n: reach(out, n) for n in {n for p in pairs for n in p}}
    return {frozenset({m for m in ahead[n] if n in ahead[m]}) for n in ahead if n in ahead[n]}


def graph(seed):
    rng = random.Random(seed)
    n = rng.choice([8, 30, 60])
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.7, 1.0, 1.4, 3])))}
    start = n
    for _ in range(3):  # rings, with ways into and out of them
        size = rng.randrange(1, 9)
        pairs |= {(start + i, start + (i + 1) % size) for i in range(size)}
        pairs |= {(rng.randrange(n), start), (start + size - 1, rng.randrange(n))}
        start += size
    return pairs


@pytest.mark.parametrize("seed", range(5))
def test_components_of_random_graphs(spark, seed):
    pairs = graph(seed)
    found = {}
    for r in cycles.strong_components(spark.createDataFrame(list(pairs), "x long, y long")).collect():
        assert r["node"] not in {n for c in found.values() for n in c}
        found.setdefault(r["component"], set()).add(r["node"])
    assert {frozenset(c) for c in found.values()} == brute(pairs)


def test_dense_core_is_coloured(spark):
    rng = random.Random(3)
    pairs = {(a, b) for a in range(12) for b in rng.sample(range(12), 4)} | {(a, b) for a in range(20, 30) for b in rng.sample(range(20, 30), 4)} | {(1, 21)}
    found = {}
    for r in cycles.coloured(cycles.trimmed(spark.createDataFrame([p for p in pairs if p[0] != p[1]], "x long, y long"))).collect():
        found.setdefault(r["component"], set()).add(r["node"])
    assert {frozenset(c) for c in found.values()} == {c for c in brute({p for p in pairs if p[0] != p[1]}) if len(c) > 1}


def test_a_ring_of_ten_thousand_has_no_pairs(spark, monkeypatch):
    sizes = []

    def counted(df, name):
        out = lineage.stored(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(cycles, "stored", counted)
    n = 10_000
    edges = spark.range(n).select(F.col("id").alias("x"), ((F.col("id") + 1) % n).alias("y"))
    tail = spark.range(500).select((F.col("id") + n).alias("x"), F.when(F.col("id") == 499, 5).otherwise(F.col("id") + n + 1).alias("y"))
    assert closure.cycles(edges.unionByName(tail)).count() == n
    assert max(sizes) <= n + 500 and len(sizes) < 60


def test_no_edges_and_loops(spark):
    none = spark.createDataFrame([], "x string, y string")
    assert closure.cycles(none).collect() == []
    some = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "c"), ("b", None)], "x string, y string")
    assert [tuple(r) for r in cycles.strong_components(some).collect()] == [("a", "a")]


@pytest.mark.parametrize("seed", range(3))
def test_reach_of_random_graphs(spark, seed):
    pairs, roots = graph(seed), {1, 3, 999}
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    want = roots.union(*(reach(out, r) for r in roots))
    got = closure.reached(spark.createDataFrame(list(pairs), "x long, y long"), spark.createDataFrame([(r,) for r in roots], "x long"))
    assert sorted(r["x"] for r in got.collect()) == sorted(want)


def test_a_chain_of_a_hundred_thousand(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(closure, "stored", lambda df, name: rounds.append(name) or lineage.stored(df, name))
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    nodes = spark.range(n + 3).select(F.col("id").alias("x"))
    lost = closure.orphans(nodes, edges, spark.createDataFrame([(10,)], "x long"))
    assert {r["x"] for r in lost.collect()} == set(range(10)) | {n + 1, n + 2}
    assert len(rounds) < 70
