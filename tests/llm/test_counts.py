"""Any context limit and any quantile, from the histogram; copies of very long texts."""

import numpy as np

from tessera.llm import bpe, token_counts
from tessera.llm.queries import BYTE_BPE


def test_limits_and_quantiles(spark):
    rng = np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(0, 5_000, 400), [0, 0, 70_000]])
    counts = spark.createDataFrame([(int(s), 1) for s in sizes], "n_tokens long, n_docs long")
    limits = [0, 1, 17, 512, 4096, 10**9]
    rows = {r["limit"]: r for r in token_counts.at_limits(counts, limits).collect()}
    assert sorted(rows) == limits
    for limit, r in rows.items():
        assert (r["docs_fit"], r["docs_cut"]) == ((sizes <= limit).sum(), (sizes > limit).sum())
        assert (r["tokens_kept"], r["tokens_lost"]) == (np.minimum(sizes, limit).sum(), (sizes - np.minimum(sizes, limit)).sum())
    shares = [0.1, 0.5, 0.9, 1.0]
    found = {r["share"]: r["n_tokens"] for r in token_counts.quantiles(counts, shares).collect()}
    ordered = np.sort(sizes)
    assert found == {q: ordered[int(np.ceil(q * len(sizes))) - 1] for q in shares}
    none = counts.limit(0)
    assert [tuple(r) for r in token_counts.at_limits(none, [5]).collect()] == [(5, 0, 0, 0, 0)]
    assert [tuple(r) for r in token_counts.quantiles(none, [0.5]).collect()] == [(0.5, None)]


def test_copies_of_very_long_texts(spark):
    texts = ["long words " * 30_000, "other " * 30_000 + "end", "short", None]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[0]), (None, texts[1]), (4, texts[2]), (5, texts[3])]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, k string, n int")
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["decoded_sha256"]) for r in bpe.roundtrip(docs, BYTE_BPE, bpe.digests, "n_tokens long, ids_sha256 string, decoded_sha256 string").collect())
    encoder = bpe.tree_encoder(BYTE_BPE)
    want = sorted((d or -1, len(encoder.encode(t or "")) // 4, bpe.hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    assert got == want
