"""Clean documents stay in the quality stage, however short."""

import corpus_pipeline

SF = "/root/testdata/sf0.1"


def test_short_clean_documents_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 200").join(labels, "doc_id").select(*corpus_pipeline.COLUMNS)
    want = {r["doc_id"] for r in docs.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.apply_quality_rules(spark, docs, SF).collect()}
    assert {548, 1944, 490, 3188, 4086, 3574} <= want == kept


def test_short_junk_goes(spark):
    texts = ["", " \n", "That*** atly.###", "this " * 40, "+1 (706) 555-3138 Therou haesst anderinwhha.\nSh. Ndth. 464434839801089"]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate([*texts, "This."])], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.apply_quality_rules(spark, docs, SF).collect()] == [len(texts)]
