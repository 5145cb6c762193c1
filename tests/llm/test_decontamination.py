"""Benchmark windows in documents against a search word by word, in one block and in many."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    windows = [(str("" if i is None else i), words(t)[a : a + window]) for i, t in items if words(t) for a in range(max(1, len(words(t)) - window + 1))]
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, named = set(), set()
        for item, x in windows:
            for a in range(len(w) - len(x) + 1):
                if w[a : a + len(x)] == x:
                    hit |= set(range(a, a + len(x)))
                    named.add(item)
        runs = [(a, next(b for b in range(a, len(w) + 1) if b not in hit)) for a in sorted(hit) if a - 1 not in hit]
        out.append((doc_id, len(w), runs, sorted(named)))
    return out


def tables(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "a", "Of", "straße", "x1", "b", "c", "d", "e"]
    said = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, said(rng.choice([1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(14)] + [(None, said(12)), (3, said(14)), (3, said(14)), (90, None), (91, "..."), (100, "the the the the"), (101, "q0 q1 q2 q3 q4")]
    docs = [(i, said(rng.randrange(60))) for i in range(30)]
    docs += [(200 + i, f"{said(4)}, {rng.choice([t for _, t in items if t])}! {said(4)}") for i in range(30)]
    docs += [(None, items[0][1]), (None, None), (5, ""), (5, docs[40][1]), (5, docs[40][1]), (6, "the " * 500), (2**63 - 1, "THE the The the")]
    return docs, items


@pytest.mark.parametrize("seed, window, shingle, block_words", [(1, 10, 3, 1 << 19), (2, 4, 3, 1 << 19), (3, 5, 1, 1 << 19), (4, 6, 8, 1 << 19), (5, 4, 2, 40), (6, 1, 3, 60)])
def test_equals_brute_force(spark, seed, window, shingle, block_words, monkeypatch):
    monkeypatch.setattr(decontamination, "AT_ONCE", 50)
    docs, items = tables(seed)
    frame = spark.createDataFrame([(*r, "clash", [1]) for r in docs], "doc_id long, text string, items string, spans array<int>").repartition(3)
    benchmark = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    found = decontamination.contamination(frame, benchmark, window=window, shingle=shingle, block_words=block_words)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    got = sorted(((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in found.collect()), key=key)
    assert got == sorted(brute(docs, items, window), key=key)


def test_long_items_are_cut_and_keep_all_windows(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 16)
    monkeypatch.setattr("tessera.llm.words.STEP", 30)
    item = " ".join(f"w{i}" for i in range(200))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    parts = [r["words"].split() for r in decontamination.pieces(benchmark, 10, "item_id", "text").collect()]
    assert {b" ".join(p[i : i + 10]) for p in parts for i in range(len(p) - 9)} == {" ".join(item.split()[i : i + 10]).encode() for i in range(191)}
    docs = spark.createDataFrame([(i, " ".join(item.split()[i : i + 10])) for i in range(191)] + [(500, " ".join(item.split()[5:14]))], "doc_id long, text string")
    found = decontamination.digest(decontamination.contamination(docs, benchmark))
    assert {r["doc_id"] for r in found.where("contaminated AND n_hit = 10 AND n_items = 1").collect()} == set(range(191))


def test_empty_tables_and_kept_documents(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "other"), (None, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "One two, three four five six seven eight nine TEN")], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), benchmark).collect() == []
    none = decontamination.digest(decontamination.contamination(docs, benchmark.limit(0))).collect()
    assert {(r["n_hit"], r["n_items"], r["contaminated"]) for r in none} == {(0, 0, False)}
    assert {r["doc_id"] for r in decontamination.cleaned(docs.withColumn("extra", F.lit(1)), benchmark).collect()} == {2, None}


def test_the_rarest_shingle_is_the_prefix():
    index = decontamination.Index([("i", b"a b c d e")], 5, 2)
    counts = np.full(index.offsets[-1], 9)
    rare = dict(zip(*(x.tolist() for x in list(index.tokens(index.numbers(b"a b c d e").astype(np.int64)))[1]), strict=True))[2]
    counts[rare] = 1
    index.choose(counts)
    assert index.offset_of.tolist() == [2] and index.slot[rare] == 0 and (index.slot >= 0).sum() == 1
    counts[rare] = 0
    index.choose(counts)
    assert (index.slot >= 0).sum() == 0
