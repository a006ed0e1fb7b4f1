"""The language stage without any labelled row."""

import corpus_pipeline


def test_corpus_without_lang_keeps_texts_with_letters(spark, sf_dir):
    rows = [(1, None), (2, ""), (3, "12 !"), (4, "a word"), (None, "\n3 ü"), (6, "中\n")]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], schema)
    got = corpus_pipeline.keep_known_language(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert {r.text for r in got.collect()} == {"a word", "\n3 ü", "中\n"}
