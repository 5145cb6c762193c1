"""Toxicity on the labelled documents, held out, and against probabilities worked out from the models one by one."""

import math
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import toxicity
from tessera.llm.queries import op6_toxicity, toxicity_labels

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), toxicity_labels(spark, SF)


def test_recall_on_held_out_documents(spark, tables):
    """Three folds, each with a third of every language's toxic documents, as five in a language are few."""
    docs, labels = tables
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    classes = {}
    for r in docs.orderBy("doc_id").select("doc_id", "lang").collect():
        if r["doc_id"] in truth:
            classes.setdefault((r["lang"], truth[r["doc_id"]]), []).append(r["doc_id"])
    caught = false = 0
    for fold in range(3):
        held = [d for found in classes.values() for d in found[fold::3]]
        rows = verdicts(docs, held, labels.where(~labels["doc_id"].isin(held)))
        caught += sum(truth[d] for d, toxic in rows.items() if toxic)
        false += sum(1 - truth[d] for d, toxic in rows.items() if toxic)
    toxic = sum(truth.values())
    assert caught >= 0.9 * toxic and false <= 0.03 * (len(truth) - toxic)


def verdicts(docs, held, seen):
    """Verdicts on the held documents by a chain that has seen the others' labels."""
    chain = toxicity.train(docs, seen, ("low_quality", "toxic"))
    scorer = toxicity.Scorer(chain.models)
    return {r["doc_id"]: scorer.score(r["text"] or "")[-1] >= chain.threshold for r in docs.where(docs["doc_id"].isin(held)).collect()}


def test_query_against_probabilities_one_by_one(spark, tables):
    docs, labels = tables
    chain = toxicity.train(docs, labels, ("low_quality", "toxic"))
    rows = {r["doc_id"]: r for r in op6_toxicity(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert rows.keys() == texts.keys()
    number = lambda s: xxhash.xxh32_intdigest(s.encode()) % 2**20
    for doc_id, text in texts.items():
        words = re.findall(r"\w+", text.lower())
        dense = {}
        for w in words:
            for f in {number(w)} | {number("^" + w[:n]) for n in (4, 5, 6, 7) if n < len(w)}:
                dense[f] = dense.get(f, 0) + 1
        earlier = []
        for model in chain.models:
            z = model.bias + sum(p * c for p, c in zip(earlier, model.chain))
            for f, weight in zip(model.used.tolist(), model.weights.tolist()):
                if f in dense:
                    z += weight * min(1.0, 50 * dense[f] / len(words))
            earlier.append(1 / (1 + math.exp(-z)))
        r = rows[doc_id]
        assert np.allclose([r["p_low_quality"], r["p_toxic"]], earlier, atol=1e-9)
        if abs(earlier[-1] - chain.threshold) > 1e-9:
            assert r["toxic"] == (bool(text.strip()) and earlier[-1] >= chain.threshold)


def test_repeated_rows_do_not_count_twice(spark, tables):
    docs, labels = tables
    some = docs.where("doc_id < 120")
    once = toxicity.train(some, labels, ("low_quality", "toxic"))
    twice = toxicity.train(some.unionByName(some), labels.unionByName(labels), ("low_quality", "toxic"))
    assert once.threshold == twice.threshold
    assert all(np.array_equal(a.used, b.used) and np.allclose(a.weights, b.weights) for a, b in zip(once.models, twice.models))


def test_a_very_long_text_and_none(spark):
    texts = [("the fine words of it " * 200_000) + "moron", None, "", "moron moron", "fine words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "moron")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 0, 1), (4, 0, 0), (None, 1, 1)], "doc_id long, low_quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 6 and not any(r["toxic"] for r in rows if r["doc_id"] in (1, 2))
