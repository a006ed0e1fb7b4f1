"""The decontamination stage with null and shared ids."""

import corpus_pipeline


def test_text_decides_not_the_id(spark, sf_dir):
    leak = "before it " + spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text + " after it"
    rows = [(None, leak), (None, "clean one"), (4, leak), (4, "clean two"), (5, None)]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    got = corpus_pipeline.drop_benchmark_leaks(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(None, "clean one"), (4, "clean two"), (5, None)}
