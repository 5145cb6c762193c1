"""The pipeline's stages on a small corpus with planted cases."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], SF), name))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    assert all(s.columns == list(corpus_pipeline.COLUMNS) for s in stages[:-1])


def test_labels_agree(spark, stages):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    every, civil, good = ({r["doc_id"] for r in s.collect()} for s in stages[:3])
    toxic = {d for d, r in labels.items() if r["toxic"]}
    assert not toxic & civil and len((set(labels) - toxic) & civil) >= 0.98 * len(set(labels) - toxic)
    junk = {d for d, r in labels.items() if not r["quality"]} & civil
    fine = {d for d, r in labels.items() if r["quality"]} & civil
    assert len(junk & good) <= 0.05 * len(junk) + 1 and len(fine & good) >= 0.98 * len(fine)
    assert every >= civil >= good


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_one_of_each_group_stays(stages):
    """Groups are those of texts with four fifths of their five-word shingles in common."""
    good, single, cut, packed = (s.collect() for s in stages[2:])
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in good}
    near = lambda a, b: sets[a] == sets[b] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    kept = {r["doc_id"] for r in single}
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    assert all(any(near(d, k) for k in sets if k != d) for d in set(sets) - kept)
    assert {r["doc_id"] for r in cut} == kept == {r["doc_id"] for r in packed}
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    seen = set()
    for r in sorted(cut, key=lambda r: r["doc_id"]):
        own = {r["text"][i : i + 60] for i in range(len(r["text"]) - 59)}
        assert not own & seen
        seen |= own


def test_run_gives_the_last_stage_s_rows(spark, stages):
    row = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(row, corpus_pipeline.run(spark, SF).collect())) == sorted(map(row, stages[-1].collect()))
