"""Language ID and quality against plain versions, term by term; the training sample; the trained machines."""

import bisect
import math

import numpy as np
import pytest

from undertow.llm import language_id, quality

SF = "/root/testdata/sf0.001"


def plain_margins(text, model):
    """Sums of weights over byte trigrams, one at a time."""
    data = [b if b >= 128 else b | 32 if chr(b).isalpha() else 32 for b in (text or "").encode()]
    total, n = np.zeros(len(model.machines)), 0
    for a, b, c in zip(data, data[1:], data[2:]):
        if (a, b, c) != (32, 32, 32):
            total += model.weights[((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 20]
            n += 1
    return total / max(1, n) + model.bias


def plain_language(text, model):
    """Family by the largest share, then the language with most votes of its pairs."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    chance = dict(zip(model.machines, (1 / (1 + math.exp(-max(-30, min(30, m * s)))) for m, s in zip(plain_margins(text, model), model.slope))))
    family = {f: chance.get(("", f), 1.0) for f in model.families}
    best = max(model.families, key=lambda f: family[f])
    score = family[best] / max(1e-9, sum(family.values()))
    names = model.languages[best]
    votes = {x: sum(chance[x, y] if (x, y) in chance else 1 - chance[y, x] for y in names if y != x) / max(1, len(names) - 1) for x in names}
    lang = max(names, key=lambda x: votes[x])
    return lang, score * votes[lang] if len(names) > 1 else score


def test_language_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(-1, None, ""), (-2, "", ""), (-3, "ab", ""), (-4, "é 12", ""), (-5, "    ", ""), (-6, "die der das", "")], docs.schema)
    rows = language_id.predict(docs.union(odd), model).collect()
    for r in rows:
        lang, score = plain_language(r.text, model)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)


def test_sample_is_the_ranked_one_and_repeats(spark):
    rows = [(i % 50, f"text {i % 70}", "de" if i % 3 else "fr") for i in range(400)] + [(None, "no id", "de"), (3, None, "de"), (4, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    take = lambda d: sorted((r.l, r.h, r.t, r.text) for r in language_id.training_sample(d, "doc_id", "text", "lang", 9).collect())
    got = take(docs)
    assert got == take(docs.repartition(7)) and {x[0] for x in got} == {"de", "fr"}
    assert all(sum(x[0] == lang for x in got) <= 9 for lang in ("de", "fr")) and len({x[:3] for x in got}) == len(got)


def test_machine_is_near_the_best(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) + 0.3 * rng.standard_normal(60) > 0, 1.0, -1.0)
    y[:6] = 0
    w, bias, _ = language_id._svm(x, y, penalty=1e-2, steps=2000)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * (y != 0)

    def loss(v):
        return (share * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum() + 0.5e-2 * (v @ v)

    v = np.append(w, bias).astype(float)
    assert all(loss(v) <= loss(v + d) + 1e-6 for d in 0.02 * rng.standard_normal((500, 6)))


def test_quality_score_equals_plain_version(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    assert model.pairs
    import pyarrow as pa

    for r in quality.score(docs.limit(150), model).collect():
        x = quality.features(pa.array([r.text], pa.string()))[0]
        total = model.base + sum(t[bisect.bisect_left(e.tolist(), v)] for e, t, v in zip(model.edges, model.tables, x))
        at = [bisect.bisect_left(e.tolist(), v) for e, v in zip(model.coarse, x)]
        total += sum(t[at[a]][at[b]] for (a, b), t in model.pairs.items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.7)


def best_leaves(g, h, ridge):
    """The two leaves of the cut with the largest gain, by trying all; one leaf where no cut gains anything."""
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + ridge)
    best, k = max((gain(0, k) + gain(k, len(g)) - gain(0, len(g)), -k) for k in range(1, len(g)))
    return [slice(0, -k), slice(-k, None)] if best > 1e-9 else [slice(0, None)]


def test_one_boosting_step_takes_the_best_cut():
    rng = np.random.default_rng(3)
    for _ in range(30):
        g, h = rng.standard_normal(9), rng.random(9)
        out = quality._tree(g, h, 1, 4.0)
        for leaf in best_leaves(g, h, 4.0):
            assert out[leaf] == pytest.approx(g[leaf].sum() / (h[leaf].sum() + 4))
    g, h = rng.standard_normal((5, 6)), rng.random((5, 6))

    def four(a, b):
        best = 0.0
        for k in range(1, len(a)):
            total = 0.0
            for part in (slice(0, k), slice(k, None)):
                x, y = a[part].sum(0), b[part].sum(0)
                total += sum(x[leaf].sum() ** 2 / (y[leaf].sum() + 4) for leaf in best_leaves(x, y, 4.0))
            best = max(best, total)
        return best

    values, gain = quality._grid_tree(g, h, 4.0)
    assert gain == pytest.approx(max(four(g, h), four(g.T, h.T))) and (g * values).sum() == pytest.approx(gain)


def test_language_sample_of_shared_ids_and_many_languages(spark):
    """Ids tell nothing about the sample, and all languages together stay within the bound."""
    same = spark.range(3000).selectExpr("7L AS doc_id", "concat(if(id % 2 = 0, 'der mann und ', 'le chat et la '), id) AS text", "if(id % 2 = 0, 'de', 'fr') AS lang")
    model = language_id.fit(same)
    assert model.languages == {"germanic": ["de"], "romance": ["fr"]}
    got = {r.lang_pred for r in language_id.predict(same.where("id % 2 = 0" if "id" in same.columns else "lang = 'de'"), model).select("lang_pred").distinct().collect()}
    assert got == {"de"}
    many = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 200) AS lang")
    rows = language_id.training_sample(many, "doc_id", "text", "lang", 400, most=600).groupBy("l").count().collect()
    assert len(rows) == 200 and all(r["count"] == 3 for r in rows)
    few = language_id.training_sample(many, "doc_id", "text", "lang", 5, most=600, most_languages=10).groupBy("l").count().collect()
    assert len(few) == 10 and all(r["count"] == 5 for r in few)
