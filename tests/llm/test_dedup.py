"""SimHash, components, suffix arrays and removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import components, simhash, substrings
from tessera.llm.suffix_array import suffix_array, suffix_arrays


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes):
    """Smallest key reachable over fingerprints at distance 3 or less."""
    label = {k: k for k, _ in nodes}
    changed = True
    while changed:
        changed = False
        for a, x in nodes:
            for b, y in nodes:
                if (x ^ y).bit_count() <= 3 and label[a] < label[b]:
                    label[b] = label[a]
                    changed = True
    return label


def test_fingerprint():
    for text in ["", " \t\n", "one", "One two", "a b c", "A b C d É e f", "x " * 70000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randint(0, 50)) for _ in range(300)) for _ in range(12)]
    texts = [None, "", " ", "one two", "one two"]
    for b in base:
        words = b.split()
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(300)] = "zz"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i * 3, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp int, component_id string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    nodes = [(i * 3, plain_fingerprint(t)) for i, t in enumerate(texts)]
    want = plain_components(nodes)
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(got[k]["fingerprint"] == f"{f:016x}" for k, f in nodes)
    assert len(set(want.values())) < len(texts) - 20
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_links_reach_every_pair_at_distance_three(spark):
    rng = random.Random(2)
    fps = []
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(5):
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    want = plain_components([(simhash.signed(x), x) for x in fps])
    # Once compared where they meet, once with every crowd sent on to full balls.
    for meeting in (simhash.MEETING, 2):
        got = {r["node"]: r["component"] for r in components.components(simhash.links(frame, meeting)).collect()}
        assert {k: got.get(k, k) for k in want} == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text("ab", max_size=40), st.text("abc", max_size=25), st.text(max_size=12)), max_size=6))
def test_suffix_arrays(texts):
    data = [t.encode() for t in texts]
    order, lengths = suffix_arrays(data)
    for n, text in enumerate(data):
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert suffix_array(text) == want
        assert order[n, : lengths[n]].tolist() == want


def plain_removal(docs, window=50):
    """(doc_id, removed bytes as flags) in the order of docs."""
    first = {}
    for doc_id, data in docs:
        for i in range(len(data) - window + 1):
            s = data[i : i + window]
            first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, data in docs:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - window + 1):
            if first[data[i : i + window]] < doc_id:
                gone[i : i + window] = True
        out.append((doc_id, gone))
    return out


def corpus(rng, n):
    words = ["the", "and", "of", "tion", "enth", "été", "a", "thousand", "."]
    phrase = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [phrase(rng.randint(8, 60)) for _ in range(12)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 400, "ab" * 300, "x" * 51]
    while len(texts) < n:
        parts = [rng.choice(shared) if rng.random() < 0.4 else phrase(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        texts.append(("\n" if rng.random() < 0.5 else " ").join(parts))
        if rng.random() < 0.2:
            texts.append(rng.choice(texts[7:]))
    return texts


def test_removal_of_repeated_strings(spark):
    rng = random.Random(9)
    texts = corpus(rng, 150)
    rows = [(i * 2 % 301, t, "block", 1) for i, t in enumerate(texts)] + [(4, texts[20], "block", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, bucket int")
    plain = [(d, (t or "").encode()) for d, t, *_ in rows]
    want = []
    for (d, data), (_, gone) in zip(plain, plain_removal(plain), strict=True):
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        want.append((d, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    # With room for all contexts of a seed, and with all of them crowded out to single strings.
    for crowd in (substrings.CROWD, 1):
        got = [tuple(r) for r in substrings.remove_repeats(docs, substrings.digest, columns, crowd=crowd).collect()]
        assert sorted(got) == sorted(want)
    kept = {(r["doc_id"], r["text"]) for r in substrings.remove_repeats(docs, columns="doc_id long, text string, block string", carry=("block",)).collect()}
    assert all(len(t.encode()) <= 1500 for _, t in kept) and len(kept) > 100
    assert substrings.remove_repeats(docs.limit(0), substrings.digest, columns).count() == 0


def test_rows_without_ids(spark):
    text = "the one and only passage of this test that two rows share, and more than fifty bytes of it"
    docs = spark.createDataFrame([(None, text), (3, text), (None, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted(substrings.remove_repeats(docs, substrings.digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect(), key=lambda r: -r["n_bytes"])
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == sorted([(3, 0), (-1, len(text)), (-1, 0), (-1, 0)])
    ids = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(docs).collect())
    assert ids == [(-1, -1), (-1, -1), (-1, 3), (3, 3)]
    assert {r["doc_id"] for r in simhash.keep_first(docs).collect()} == {3, None}


def test_blocks_find_what_brute_force_finds():
    rng = random.Random(10)
    for trial in range(6):
        plain = [(i, (t or "").encode()) for i, t in enumerate(corpus(rng, 60))]
        job = substrings.Job(3, 50, 128)
        blocks = [substrings.Block([d for d, _ in plain if d % 4 == k], [t for d, t in plain if d % 4 == k], 50) for k in range(4)]
        answers = [{} for _ in blocks]
        for send, reply in ((job.send_seeds, job.answer_seeds), (job.send_contexts, job.answer_contexts), (job.send_strings, job.answer_strings)):
            rows = {}
            for k, block in enumerate(blocks):
                for r in send(block, k, answers[k]):
                    rows.setdefault(r[0], []).append(dict(zip(("bucket", "block", "kind", "a", "b", "c", "d"), r, strict=True)))
            for found in rows.values():
                for r in reply(found):
                    answers[r[1]].setdefault(r[2], {})[r[0]] = r[3]
        want = dict(plain_removal(plain))
        for k, block in enumerate(blocks):
            gone = job.covered(block, answers[k])
            for d, a, b in zip(block.ids.tolist(), block.starts.tolist(), block.ends.tolist(), strict=True):
                assert (gone[a:b] == want[d]).all(), (trial, d)


def test_components_of_a_long_chain_take_few_steps(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(components, "checkpointed", lambda df, rows=None, f=components.checkpointed: calls.append(rows) or f(df, rows))
    names = list(range(1000))
    random.Random(5).shuffle(names)
    edges = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a long, b long")
    assert {tuple(r) for r in components.components(edges).collect()} == {(n, 0) for n in names}
    assert len(calls) <= 6
    # The same in many small trees.
    monkeypatch.setattr(components, "LOCAL", 50)
    assert {tuple(r) for r in components.components(edges).collect()} == {(n, 0) for n in names}
