"""The resampling operator against counts, gains and ranks made one by one."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score string, n int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, most):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, most, buckets, percent, min_words, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, most))
    t = Counter(bucket(f) for x in target for f in features(x, most))
    big_s, big_t = s.total() + buckets, t.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    rows = []
    for doc_id, text in docs:
        found = features(text, most)
        weight = math.floor(sum(gain(bucket(f)) for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], r[0] is None, r[0] or 0, i) for i, r in enumerate(rows) if r[1] >= min_words)
    rank = {x[3]: k for k, x in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r, rank.get(i)) for i, r in enumerate(rows)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


DOCS = [(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 40))) for i in range(120)]
DOCS += [(None, "Straße ÉCOLE école, x9-y8 " * 9), (None, None), (7, None), (7, ""), (8, "twin words " * 15), (8, "twin words " * 15), (-(2**63), "\x00\x7f ..."), (2**63 - 1, "Last " * 3000)]
TARGET = ["w1 w2 w3 école", None, "", "w3 w4"]


@pytest.mark.parametrize("most, nodes", [(1, 1 << 18), (3, 1 << 18), (3, 5)])
def test_equals_brute_force(spark, monkeypatch, most, nodes):
    monkeypatch.setattr(resampling, "NODES", nodes)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in DOCS], SCHEMA).repartition(3)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = resampling.resample(docs, target, most=most, buckets=97, percent=35, min_words=5)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    found = sorted((tuple(r) for r in got.collect()), key=key)
    want = sorted(brute(DOCS, TARGET, most, 97, 35, 5), key=key)
    # Rows that agree in all else may swap their ranks.
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert sorted(r[5] for r in found if r[5]) == sorted(r[5] for r in want if r[5])
    assert {r for r in found if r[0] not in (8, None)} == {r for r in want if r[0] not in (8, None)}


def test_long_texts_are_walked_in_lists(monkeypatch):
    monkeypatch.setattr("tessera.llm.words.STEP", 7)
    text = "a bb ccc dddd é1 " * 20
    trie = resampling.Trie(3)
    got = Counter(node[1] for held, starts in resampling.spans_of_words(text.encode(), 3) for node in trie.paths(held, starts))
    assert got == Counter(zlib.crc32(f.encode()) for f in features(text, 3))


def test_empty_tables_and_equal_scores(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in DOCS], SCHEMA)
    target = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs.limit(0), target).collect() == []
    assert resampling.resample(docs, target, min_words=10**6).where("rank IS NOT NULL").count() == 0
    same = spark.createDataFrame([(3, "x " * 30)] * 50, "doc_id long, text string")
    assert sorted(r["rank"] for r in resampling.resample(same, target, percent=50).collect() if r["rank"]) == list(range(1, 26))
    assert [tuple(r) for r in resampling.draw(same.limit(2), target, percent=50).collect()] == [(1, 3)]
