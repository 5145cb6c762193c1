"""Packing, BPE and token counts against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, sequence_id string, ids string, part int, length int"

ODD = [
    None, "", " ", "\n\n", "a", "A b\tc", "x  y \n z ", "it's we'll  '", "\x1cA\x1d b", "café  nb sp é", "你好\U0001f600 ཀི",
    "<|endoftext|> x<|endoftext|>y", "<|startoftext|>", "word " * 3000, "a" * 9000, "ab" * 4000 + " tail", "\n" * 700 + "x", " " * 3000, "0123456789" * 500, "é" * 5000, "it's" * 2000,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", 7, 7) for i, t in enumerate(texts)], SCHEMA)


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_tree_concatenation_equals_the_library():
    t = library(BYTE)
    rng = random.Random(3)
    texts = [x or "" for x in ODD]
    for _ in range(150):
        letters = rng.choice(["ab", "the and of tion ", "aAbB'st 12\n ", "é你a ", "  \n\t x", "="])
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(1, 600))))
    tree = bpe.TreeEncoder(BYTE, leaf_chars=16, chunk_bytes=24)
    for text in texts:
        assert np.frombuffer(tree.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert tree.joins > 1000 and tree.grown > 10


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_have_the_library_s_ids(path):
    from tessera.llm.tokens import Encoder

    t, e = library(path), Encoder(path)
    assert e.one is not None
    rng = random.Random(6)
    syllables = ["th", "er", "É", "ß", "İ", "ΑΣ", "n\u0303", "'s", "12", "#", "$%", "eau", "Å", "\u00a0", "\U0001f600", "I'LL", "ſ", "ñ", "one", "Tion", "<|endoftext|>"]
    texts = [x or "" for x in ODD] + ["".join(rng.choice(syllables) if rng.random() < 0.85 else rng.choice(" \n\t") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    for text in texts:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_roundtrip_of_spread_texts(spark):
    t = library(BYTE)
    rows = {r["doc_id"]: r for r in bpe.roundtrip(frame(spark, ODD), BYTE, spread_chars=1000).collect()}
    assert len(rows) == len(ODD)
    for i, text in enumerate(ODD):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == ids
        assert rows[i]["decoded"] == t.decode(ids, skip_special_tokens=False) == (text or "")


def test_roundtrip_digests_of_repeated_rows(spark):
    docs = spark.createDataFrame([(5, "one two"), (5, "one two"), (None, "x")], "doc_id long, text string")
    rows = bpe.roundtrip(docs, BYTE, bpe.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string").collect()
    ids = library(BYTE).encode("one two", add_special_tokens=False).ids
    mine = [r for r in rows if r["doc_id"] == 5]
    assert len(rows) == 3 and len(mine) == 2
    assert mine[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert mine[0]["decoded_sha256"] == hashlib.sha256(b"one two").hexdigest()


def check_packed(rows, texts, seq_len):
    t = library(WORD)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want = [(n, at, len(ids[at : at + seq_len]), zlib.crc32(np.array(ids[at : at + seq_len], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), seq_len))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == want
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= seq_len
    return len(by_sequence)


def test_packing(spark):
    rng = random.Random(4)
    texts = ODD + ["word " * rng.randint(0, 90) for _ in range(200)]
    rows = packing.pack(frame(spark, texts).repartition(5), WORD, 64, 1).collect()
    used = check_packed(rows, texts, 64)
    total = sum(r["length"] for r in rows)
    assert used <= 1.03 * -(-total // 64)
    assert packing.pack(frame(spark, texts).limit(0), WORD, 64, 1).count() == 0


@pytest.mark.parametrize("lengths", [{5: 7}, {64: 3}, {1: 1000}, {40: 10, 24: 10}, {33: 50, 30: 20, 1: 5}, {}])
def test_plans_place_every_piece_once(lengths):
    plan = packing.Plan(lengths, 64)
    placed = {}
    for length, low, high, _, offset in plan.places():
        assert placed.get(length, 0) == low and offset + length <= 64
        placed[length] = high
    assert placed == {k: v for k, v in lengths.items() if v}
    assert plan.sequences >= -(-sum(k * v for k, v in lengths.items()) // 64)


def test_plan_is_near_the_bound_and_fits_patterns():
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(np.clip(rng.lognormal(6.5, 1.1, 60_000).astype(int), 1, 4096), return_counts=True)
    histogram = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
    plan = packing.Plan(histogram, 4096)
    bound = -(-int((sizes * counts).sum()) // 4096)
    assert plan.fitted > 0.3 * bound
    assert plan.sequences <= 1.005 * bound


def test_nnls_against_projected_gradient():
    rng = np.random.default_rng(2)
    a, b = rng.random((12, 20)), rng.random(12)
    x = packing.nnls(a, b)
    y = np.zeros(20)
    for _ in range(60_000):
        y = np.maximum(0, y - (a.T @ (a @ y - b)) / np.linalg.norm(a, 2) ** 2)
    assert (x >= 0).all() and abs(np.linalg.norm(a @ x - b) - np.linalg.norm(a @ y - b)) < 1e-4


def test_token_counts(spark):
    t = library(BYTE)
    sizes = [len(t.encode(x or "", add_special_tokens=False).ids) for x in ODD]
    rows = token_counts.context_limits(token_counts.histogram(frame(spark, ODD), BYTE)).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(sizes))
    for r in rows:
        limit = r["n_tokens"]
        assert r["n_docs"] == sizes.count(limit)
        assert r["docs_fit"] == sum(s <= limit for s in sizes) and r["docs_cut"] == sum(s > limit for s in sizes)
        assert r["tokens_kept"] == sum(min(s, limit) for s in sizes) and r["tokens_lost"] == sum(max(0, s - limit) for s in sizes)
        assert r["tokens_fit"] == sum(s for s in sizes if s <= limit)
        assert r["share_fit"] == pytest.approx(r["docs_fit"] / len(sizes))
    assert token_counts.context_limits(token_counts.histogram(frame(spark, ODD).limit(0), BYTE)).count() == 0


def test_empty_tables(spark):
    from tessera.llm import bpe, media
    from tessera.llm.queries import BYTE_BPE

    none = spark.createDataFrame([], "doc_id long, text string, n int")
    assert bpe.roundtrip(none, BYTE_BPE, bpe.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string").collect() == []
    assert media.text_media(none).collect() == []
