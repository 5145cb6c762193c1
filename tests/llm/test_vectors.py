"""Product codes against plain rounds, one vector at a time."""

import math

import numpy as np
import pytest

from tessera.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, error string"


def brute(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e, strict=True)), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        sums = {}
        for _, v, _ in kept:
            for p in range(parts):
                sums.setdefault((p, near(p, v)[1]), []).append(v[p * width : (p + 1) * width])
        for (p, n), of in sums.items():
            books[p][n] = [sum(c) // len(of) for c in zip(*of, strict=True)]
    out = []
    for i, v, g in kept:
        found = [near(p, v) for p in range(parts)]
        out.append((i, g, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    total = {g: sum(r[3] for r in out if r[1] == g) for _, g, _, _ in out}
    return [(*r, total[r[1]]) for r in out], books


def table(seed, n):
    rng = np.random.default_rng(seed)
    # Few different values, so that distances tie often.
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 6) / 4096], [None, 1, 1, 1, 2, int(i)][i % 6]) for i in rng.permutation(n)]
    rows += [(n, None, 1), (n + 1, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (n + 2, [math.nan] * 6, 1), (n + 3, [math.inf] + [0.0] * 5, None), (n + 4, rows[0][1], 5), (n + 4, rows[0][1], 5), (None, [-0.3, 2.5, 1.0, 0.0, 7.0, -7.0], None)]
    return rows


@pytest.mark.parametrize("seed, parts, entries, rounds, scale", [(1, 3, 5, 4, 4096), (2, 2, 16, 6, 4096), (3, 6, 7, 3, 4096), (4, 1, 200, 2, 4096), (5, 3, 16, 6, 100)])
def test_equals_brute_force(spark, seed, parts, entries, rounds, scale):
    rows = table(seed, 150)
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    found, books = vectors.compress(frame, parts=parts, entries=entries, rounds=rounds, scale=scale)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows]
    want, want_books = brute(rows, parts, entries, rounds, scale)
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + r[2:]
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)
    assert books.tolist() == want_books
    assert len(vectors.decoded(want[0][2], books)) == 6


def test_labels_with_few_rows_are_joined(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HEAVY", 3)
    frame = spark.createDataFrame([(i, None if i % 2 else i % 40, f"{i}", i) for i in range(400)], "vec_id long, label int, code string, error long")
    got = {(r["label"], r["label_error"]) for r in vectors.with_label_error(frame).collect()}
    assert got == {(g, sum(i for i in range(400) if (None if i % 2 else i % 40) == g)) for g in [None, *range(0, 40, 2)]}
    assert vectors.with_label_error(frame).count() == 400


def test_few_rows_empty_tables_and_odd_lengths(spark):
    frame = spark.createDataFrame([(1, [0.5, 0.25], 1, ""), (2, [0.5], 1, ""), (3, [], 1, "")], SCHEMA)
    found, books = vectors.compress(frame, parts=2)
    assert [tuple(r) for r in found.collect()] == [(1, 1, "0000", 0, 0)] and books.shape == (2, 1, 1)
    none, books = vectors.compress(frame.limit(0))
    assert none.collect() == [] and none.columns == ["vec_id", "label", "code", "error", "label_error"] and books.size == 0
    with pytest.raises(ValueError, match="equal parts"):
        vectors.compress(frame, parts=8)


def test_the_tree_visits_what_is_equally_near():
    rng = np.random.default_rng(9)
    for _ in range(60):
        entries, x = rng.integers(-2, 3, (rng.integers(1, 20), 2)), rng.integers(-4, 5, (50, 2))
        every = ((x[:, None] - entries) ** 2).sum(axis=2)
        index, distance = vectors.KdTree(entries).nearest(x)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
