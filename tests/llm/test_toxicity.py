"""The factorization machine against plain sums, on interactions, on held-out labels, and the cases the docstring names."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from undertow.llm import toxicity
from undertow.llm.queries import op12_toxicity

SF = "/root/testdata/sf0.01"


def labelled(n, seed, rule):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(6))}" for _ in range(rng.randint(3, 12))] + ["Insult"] * a + ["grouP"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(rule(a, b))))
    return rows


def of(rows, bits=14):
    return toxicity.terms(pa.array([r[1] for r in rows]), bits)


def test_terms():
    text = ["Ab ab-AB cd", None, "", "12 !?", "Éa éa", "x" * 300_000 + " y"]
    buckets, ends = toxicity.terms(pa.array(text), 18)
    assert np.diff(ends).tolist() == [2, 0, 0, 0, 1, 2]
    one = lambda t: toxicity.terms(pa.array([t]), 18)[0].tolist()
    assert one("ab") == one("AB!") and set(one("ab cd")) == set(buckets[:2].tolist())


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    place = np.arange(16) - 4
    place[:4] = -1
    m = toxicity.Machine(4, place, -0.3, rng.normal(size=12), rng.normal(size=(12, 3)))
    rows = [[], [1, 2], [5], [0, 4, 9, 15], list(range(16))]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = m.score(np.array([b for r in rows for b in r], np.int64), ends)
    for r, s in zip(rows, got, strict=True):
        at = [b - 4 for b in r if b >= 4]
        total = -0.3 + sum(m.weights[i] for i in at) + sum(m.factors[i] @ m.factors[j] for k, i in enumerate(at) for j in at[:k])
        assert s == pytest.approx(1 / (1 + np.exp(-total)))


def test_pairs_that_no_weight_by_term_expresses():
    """Label 1 where both words are there or neither is."""
    learn, held = labelled(2000, 1, lambda a, b: a == b), labelled(500, 2, lambda a, b: a == b)
    m = toxicity.train(*of(learn), np.array([r[2] for r in learn], float), 14, epochs=60, positive=1.0)
    right = (m.score(*of(held)) > 0.5) == np.array([r[2] for r in held])
    assert right.mean() > 0.95
    m.factors[:] = 0
    assert ((m.score(*of(held)) > 0.5) == np.array([r[2] for r in held])).mean() < 0.85


def test_insult_with_group(spark):
    rows = labelled(1500, 5, lambda a, b: a and b)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    tried = spark.createDataFrame([(1, "insult wab"), (2, "the group wcd"), (3, "wab INSULT, group!"), (4, None), (5, ""), (5, ""), (6, "insult group " * 30_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(tried.withColumn("score", tried.doc_id).withColumn("Predicted", tried.doc_id), model).collect()}
    assert [got[i].predicted for i in range(1, 7)] == [0, 0, 1, 0, 0, 1]
    assert got[4].score == got[5].score == pytest.approx(1 / (1 + np.exp(-model.bias)))
    again = toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert (again.weights == model.weights).all() and again.bias == model.bias


def test_sample_is_bounded(spark):
    rows = labelled(300, 6, lambda a, b: a)
    docs = spark.createDataFrame([r[:2] for r in rows] * 2 + [(None, "x"), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    one = toxicity.sample(docs, labels, "doc_id", "text", "toxic", 100).collect()
    assert len(one) == 100 and len({(r.id, r.h) for r in one}) == 100
    assert toxicity.fit(docs, labels, most_terms=300) is not None
    assert toxicity.fit(docs, labels, most_terms=1) is None


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) is None
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0.5, 0.5]
    assert toxicity.score(docs.limit(0), None).collect() == []
    one_kind = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, one_kind) is None


def test_held_out(spark):
    got = {r.doc_id: r for r in op12_toxicity(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = [(got[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    good, bad = [s for s, y in labels if y], [s for s, y in labels if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.93
    assert np.mean([s >= 0.7 for s in good]) > 0.7 and np.mean([s >= 0.7 for s in bad]) < 0.02
