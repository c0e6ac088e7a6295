import corpus_pipeline


def test_language_stage_without_labels(spark):
    """With no language to learn from, texts with letters stay."""
    rows = [(i, t, None, "s") for i, t in enumerate(["some words", None, "12 !", "", "\u00e9", "\u4e2d\u6587", "more of them"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 4, 5, 6]
