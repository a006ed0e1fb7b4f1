"""The pipeline against plain versions of its stages."""

import hashlib
import os

from pyspark.sql import functions as F
from tests.llm.test_near_copies import brute
from tests.llm.test_texts import base_spans, leaks_brute

import corpus_pipeline
from undertow.llm.shared import materialise, shared_folder


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    spoken = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    kept = {i: spoken[i] for i, c in brute(list(spoken.items()), 5, 80).items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {i for i, _ in leaks_brute(list(kept.items()), items)}
    folder = shared_folder(spark)
    before = {x for x in os.listdir(folder) if x.startswith("undertow-")}
    done = corpus_pipeline.run(spark, sf_dir)
    assert len({x for x in os.listdir(folder) if x.startswith("undertow-")} - before) == 1  # the result alone
    out = {r.doc_id: r for r in done.collect()}
    assert set(out) == set(kept) - leaked
    from tokenizers import Tokenizer

    from undertow.llm.queries import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    for i, r in out.items():
        if not base_spans(kept[i]):
            ids = t.encode(kept[i], add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.n_chars == len(kept[i])
            assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    odd = [(1, None, "en", "s", None), (2, "", "de", None, 0), (3, "12", None, "s", 2), (4, "a word", "en", "s", 6), (4, "a word", "en", "s", 6), (5, "token=abcdefgh here", "en", "s", 19)]
    docs = spark.createDataFrame(odd, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = out
    got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert got == {4: ("a word", 6), 5: ("[SECRET] here", 13)}


def test_stages_take_columns_of_clashing_names(spark, sf_dir):
    """Columns named like those that the operators make themselves stay as they are; the last stage takes any rows."""
    names = ["_row", "_text", "_lang", "_score", "_key", "_found", "_spans", "_guess", "lang_pred", "score", "spans", "component_id", "node", "doc", "item", "key", "ids", "n_tokens"]
    odd = [(1, None, "en", "s", None), (None, "", "de", None, 0), (4, "a word here", "en", "s", 11), (4, "a word here", "en", "s", 11), (5, "token=abcdefgh here", "en", "s", 19), (6, "long " * 9000, "en", "s", 45000)]
    docs = spark.createDataFrame(odd, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(f"mine {i}"))
    start = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        assert docs.columns == start.columns
    rows = docs.collect()
    assert sorted(r.doc_id for r in rows) == [4, 5, 6] and all(r[n] == f"mine {i}" for r in rows for i, n in enumerate(names))
    last = corpus_pipeline.STAGES[-1][1]
    got = sorted((r.doc_id or 0, r.n_tokens) for r in last(spark, start, sf_dir).collect())
    assert [i for i, _ in got] == [0, 1, 4, 4, 5, 6] and [n > 0 for _, n in got] == [False, False, True, True, True, True]
    assert last(spark, start.limit(0), sf_dir).count() == 0
