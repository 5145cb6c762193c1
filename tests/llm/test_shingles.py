"""Near copies by shingles against brute force."""

import random

import corpus_pipeline
import numpy as np

from tessera.llm import shingles


def plain_set(text, words=5):
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def plain_components(docs):
    sets = {d: plain_set(t) for d, t in docs}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if label[a] < label[b] and (x == y or 100 * len(x & y) >= 80 * len(x | y)):
                    label[b] = label[a]
                    changed = True
    return label


def corpus(seed):
    """Copies with words replaced, from the closest to ones below the similarity, and texts that share half."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", " \n", "one two", "One  two", "one three", "a b c d e", "a b c d f"]
    for _ in range(8):
        base = [word() for _ in range(rng.choice([40, 200, 600]))]
        texts.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base[: len(base) // 2] + [word() for _ in range(len(base) // 2)]))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_equal_brute_force(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs).collect()} == want
    assert {r["doc_id"] for r in shingles.keep_first(docs).collect()} == set(want.values())
    assert 20 < len(set(want.values())) < len(rows) - 10
    assert shingles.keep_first(docs.limit(0)).count() == 0


def test_members_that_a_first_does_not_connect_are_compared(spark, monkeypatch):
    """All texts share every band, so links must not depend on which member is the first."""
    monkeypatch.setattr(shingles, "sketches", lambda docs, *a, made=shingles.sketches: made(docs, *a).withColumn("bands", shingles.F.array(shingles.F.lit(1).cast("long"))))
    rows = [(i, t) for i, t in corpus(4) if (t or "").strip()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_copies(docs).collect()} == plain_components(rows)


def test_simhash_chooses_pairs(spark, monkeypatch):
    """Without any band, nodes of one fingerprint or within the radius are still compared by their sets, and linked if these are similar."""
    monkeypatch.setattr(shingles, "sketches", lambda docs, *a, made=shingles.sketches: made(docs, *a).withColumn("bands", shingles.F.array().cast("array<long>")))
    rows = corpus(5)
    sets = [shingles.shingles(t or "", 5) for _, t in rows]
    prints = [shingles.simhash.fingerprint_of_set(s) for s in sets]
    near = {(a, b) for a in range(len(rows)) for b in range(a) if len({shingles.key_of(sets[a]), shingles.key_of(sets[b])}) == 1 or (prints[a] ^ prints[b]).bit_count() <= shingles.RADIUS}
    label = {i: i for i in range(len(rows))}
    for _ in rows:
        for a, b in near:
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])):
                label[a] = label[b] = min(label[a], label[b])
    found = shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == label
    assert len(set(label.values())) < len({shingles.key_of(s) for s in sets})


def test_bands_of_many_strangers_are_thinned_first(spark, monkeypatch):
    """Where no fingerprint helps, partners by estimate and then all open pairs of a band are compared, with the same result."""
    monkeypatch.setattr(shingles, "BLOCK", 3)
    monkeypatch.setattr(shingles, "sketches", lambda docs, *a, made=shingles.sketches: made(docs, *a).withColumn("fp", shingles.F.xxhash64("key")))
    rows = corpus(6)
    found = shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == plain_components(rows)


def test_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(None, text), (4, text + " more"), (None, "alone here")], "doc_id long, text string")
    assert sorted(map(repr, (r["doc_id"] for r in shingles.keep_first(docs).collect()))) == ["4", "None"]


def test_stage_drops_copies_at_four_fifths(spark):
    """Pairs of sf0.1 at a similarity of 0.82 to 0.85 and 4 or 11 bits apart, and one at 0.74 within 3 bits; 3901 links 2540 to 205."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id IN (205, 3901, 2540, 7394, 3612, 3818, 212, 1329)")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {205, 3612, 212, 1329}


def test_all_pairs_of_a_band_can_be_compared(spark, monkeypatch):
    """With a cut of 1, and blocks of few members and bytes, links are those of all pairs at 0.8 that share a band."""
    import random

    monkeypatch.setattr(shingles, "BLOCK", 7)
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 3_000)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(70):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(90)] = f"x{i}"
        texts.append((i, " ".join(words)))
    sets = {i: set(shingles.shingles(t, 5).tolist()) for i, t in texts}
    bands = {i: set(shingles.bands_of(shingles.shingles(t, 5))) for i, t in texts}
    group = {i: i for i, _ in texts}
    for a in sets:
        for b in sets:
            if a < b and bands[a] & bands[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    for cut in (shingles.CUT, 1.0):
        found = shingles.near_copies(spark.createDataFrame(texts, "doc_id long, text string"), cut=cut)
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == group
    assert 1 < len(set(group.values())) < 70


def test_hops_join_only_what_is_connected(spark):
    """A chain of five nodes and a star come to their ends in two doublings, a longer chain in part; nodes of one component are connected."""
    chains = [[1, 2, 3, 4, 5], [10, 20], list(range(100, 120))]
    pairs = [(b, a) for c in chains for a, b in zip(c, c[1:], strict=False)] + [(31, 30), (32, 30), (33, 30), (33, 31)]
    found = {r["node"]: r["component"] for r in shingles.hops(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert [found[n] for n in (2, 3, 4, 5, 20, 31, 32, 33)] == [1, 1, 1, 1, 10, 30, 30, 30]
    assert all(any(n in c and found[n] in c and found[n] < n for c in [*chains, [30, 31, 32, 33]]) for n in found)
    assert shingles.hops(spark.createDataFrame([], "a long, b long")).count() == 0


def test_open_pairs_of_a_group_are_a_forest(spark, monkeypatch):
    """Copies that no fingerprint connects give links in proportion to their number, not to its square."""
    made = []
    monkeypatch.setattr(shingles, "sketches", lambda docs, *a, made=shingles.sketches: made(docs, *a).withColumn("fp", shingles.F.xxhash64("key")).withColumn("bands", shingles.F.array(shingles.F.lit(1).cast("long"))))
    monkeypatch.setattr(shingles, "open_pairs", lambda *a, f=shingles.open_pairs: made.append(f(*a)) or made[-1])
    texts = [(i, " ".join(f"x{i}" if w == i else f"w{w}" for w in range(200))) for i in range(40)]
    found = shingles.near_copies(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["component_id"] for r in found.collect()} == {0}
    assert made[0].count() == 39
