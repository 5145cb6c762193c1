"""The stages on nulls, repeated rows, clashing columns, very long texts and an empty table."""

import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic int, key long, component_id long"


def test_odd_rows_pass_all_stages(spark):
    rng = random.Random(4)
    words = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND n_chars > 400").orderBy("doc_id").limit(3).collect()]
    fine = words[0]
    long = " ".join("".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 9))) for _ in range(60_000)) + "."
    rows = [(1, fine), (2, fine), (2, fine), (None, fine), (3, None), (4, ""), (5, long), (None, None), (None, words[1])]
    docs = spark.createDataFrame([(i, t, "en", "web", None, 1, 2, 3) for i, t in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(map(repr, (r["doc_id"] for r in docs.collect()))) == ["1", "5", "None"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {1, 5, None} and all(0 < r["length"] <= 4096 for r in packed)


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.count() == 0
