"""Language ID and quality: held-out accuracy, and edges."""

import numpy as np

from undertow.llm import language_id, quality
from undertow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and 200 < len(held) < 460
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 ... !!"), (4, "é"), (5, "a"), (6, "中文"), (7, "the " * 50_000), (8, "🎉"), (1, None)], "score long, text string")
    got = language_id.predict(odd.withColumn("lang_pred", odd.text), model).collect()
    by = {r.text: (r.lang_pred, r.score) for r in got}
    assert len(got) == 9 and by[None] == by[""] == by["12 34 ... !!"] == by["🎉"] == ("und", 0.0)
    assert all(by[t][0] in ("de", "en", "es", "fr") for t in ("é", "a", "中文", "the " * 50_000))
    assert language_id.fit(docs.limit(0)) is None
    assert language_id.predict(odd, None).where("lang_pred <> 'und'").count() == 0
    one = language_id.fit(docs.where("lang = 'de'"))
    assert {r.lang_pred for r in language_id.predict(odd.where("text = 'a'"), one).collect()} == {"de"}
    assert language_id.predict(odd.limit(0), model).count() == 0


def test_quality_accuracy(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op8_quality"](spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in label]
    good = [r.score for r in held if label[r.doc_id] == 1]
    bad = [r.score for r in held if label[r.doc_id] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_edges(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "\n\n\n"), (5, "x" * 300_000), (6, "é 中文 🎉"), (1, None)], "score long, text string")
    got = quality.score(odd, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not r.text} == {next(r.score for r in got if r.text is None)}
    assert quality.fit(docs, labels.limit(0)) is None and quality.fit(docs, labels.where("quality = 1")) is None
    assert {r.score for r in quality.score(odd, None).collect()} == {0.5}
    assert quality.score(odd.limit(0), model).count() == 0
