"""Links of other radii against all pairs."""

import random

import pytest

from tessera.llm import simhash


@pytest.mark.parametrize(("radius", "meeting"), [(1, 8_192), (2, 8_192), (4, 8_192), (5, 8_192), (4, 2)])
def test_links_equal_all_pairs(spark, radius, meeting):
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for base in list(prints):
        for _ in range(6):
            x = base
            for bit in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << bit
            prints.add(x)
            base = x if rng.random() < 0.5 else base
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= radius and label[a] < label[b]:
                    label[b] = label[a]
                    changed = True
    table = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    forest = simhash.Forest()
    for r in simhash.links(table, meeting, radius).collect():
        assert ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 64
        forest.link(r["a"], r["b"])
    roots = {p: forest.root(simhash.signed(p)) for p in prints}
    assert all((roots[a] == roots[b]) == (label[a] == label[b]) for a in prints for b in prints)


@pytest.mark.parametrize("meeting", [8_192, 2])
def test_near_links_are_within_the_radius_and_connect_the_same(spark, meeting):
    rng = random.Random(9)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(8):
            prints.add(x)
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
    table = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    near, plain = simhash.Forest(), simhash.Forest()
    for r in simhash.links(table, meeting, 4, near=True).collect():
        assert ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4
        near.link(r["a"], r["b"])
    for r in simhash.links(table, meeting, 4).collect():
        plain.link(r["a"], r["b"])
    signed = [simhash.signed(p) for p in prints]
    assert [near.root(p) for p in signed] == [plain.root(p) for p in signed]
    assert len({near.root(p) for p in signed}) < len(signed)
