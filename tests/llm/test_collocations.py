"""Collocations against a plain version with Python's integers, and the filters against counters."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from undertow.llm import collocations
from undertow.llm.quotient_filter import Filter, Packing

SCHEMA = "doc_id long, text string, lang string, n long, phrase string"


def plain_counts(rows, longest):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    return counts, totals


def plain(rows, least, longest, keep):
    counts, totals = plain_counts(rows, longest)
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        lost = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and f[p[i:j]] <= a}
        listed = []
        for p, a in found.items():
            if p not in lost:
                score, _, left, right = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(listed)[:keep]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts(n, seed, words=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Éa", "ÉA", "x-y", "new york", " q", "日本"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(["alpha beta gamma delta Epsilon", "alpha beta", vocabulary[int(rng.paretovariate(0.7)) % len(vocabulary)]]))
            parts.append(rng.choice([" "] * 9 + [". ", "\t", "  ", ",", "\n", " ;"]))
        out.append(("".join(parts), rng.choice(["en", "en", "de", None, "und"])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i % 7 or None, t, g, 1, "p") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(6)


@pytest.mark.parametrize("seed,least,longest,most_words", [(1, 5, 5, 250_000), (2, 3, 4, 4), (3, 2, 5, 1), (4, 12, 2, 10)])
def test_equals_plain(spark, seed, least, longest, most_words):
    rows = texts(150, seed) + [(None, "en"), ("", "fr"), (" \t.,", None), ("Alone", "xx")]
    got = collocations.collocations(frame(spark, rows), least=least, longest=longest, keep=40, most_words=most_words)
    assert sorted(map(tuple, got.collect())) == plain(rows, least, longest, 40)


def test_counts_of_parts(spark):
    rows = texts(80, 9)
    counts, totals = collocations.frequent_phrases(frame(spark, rows), least=4)
    want, n = plain_counts(rows, 5)
    assert {(r.lang, tuple(r.phrase.split(" ")), r.n) for r in counts.collect()} == {(g, p, a) for g, f in want.items() for p, a in f.items() if a >= 4}
    assert {r.lang: r.n for r in totals.collect()} == {g: x for g, x in n.items() if x}


def test_long_text_and_one_word(spark):
    rows = [("ab " * 120_000 + "cd ef", "en"), (". ".join(["one two"] * 50_000), "de"), ("a", "en")] * 2
    got = collocations.collocations(frame(spark, rows), least=100)
    assert sorted(map(tuple, got.collect())) == plain(rows, 100, 5, 2000)


def test_empty(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(None, None), ("a b c", "en")])).collect() == []


def test_many_small_filters(spark):
    """Filters that go on early and ranges of a few n-grams give the same counts."""
    rows = texts(60, 4)
    docs = frame(spark, rows).select("lang", "text").fillna("und", ["lang"])
    known = collocations.count_words(docs, 2).where("word IS NOT NULL").select("lang", "word").collect()
    dictionary = collocations.Dictionary(known, True)
    ids = collocations.as_ids(docs, dictionary)
    want, _ = plain_counts(rows, 3)
    found = collocations.count_phrases(ids, dictionary, 3, 2, None, 12, slots=10)
    assert {(r.lang, tuple(r.words), r.n) for r in found.collect()} == {(g, p, a) for g, f in want.items() for p, a in f.items() if a >= 2 and len(p) == 3}


@pytest.mark.parametrize("k,bits", [(2, 1), (2, 11), (3, 7), (4, 16), (5, 13), (5, 18), (5, 21), (6, 21)])
def test_filter(k, bits):
    rng = np.random.default_rng(k * 100 + bits)
    packing = Packing(k, bits)
    rows = [rng.integers(0, 1 << bits, (n, k)) for n in (1, 50, 700)]
    rows.append(np.repeat(rows[1][:3], [255, 254, 3000], axis=0))
    top, rest = packing.permute(rows[2])
    assert (packing.restore(top, rest) == rows[2]).all()
    whole = Filter.of(packing, rows[0]).merge(*[Filter.of(packing, r) for r in rows[1:]])
    for piece_bits in {0, 1, min(4, packing.top_bits), min(9, packing.top_bits)}:
        pieces = [Filter.from_bytes(packing, piece_bits, at, f.to_bytes(piece_bits)) for at, f in whole.pieces(piece_bits)]
        got = pieces[0].merge(*pieces[1:])
        assert dict(zip(map(tuple, got.ids().tolist()), got.count.tolist(), strict=True)) == Counter(tuple(r) for x in rows for r in x.tolist())
        assert (got.top[1:] >= got.top[:-1]).all()


def test_equal_in_the_first_64_bits():
    packing = Packing(5, 18)
    top = np.array([5, 5, 5, 9], np.uint64)
    f = Filter(packing, top, np.array([1, 2, 2, 0], np.uint64), np.ones(4, np.int64)).merge(Filter(packing, top[:1], np.array([1], np.uint64), np.array([7])))
    assert list(zip(f.top.tolist(), f.rest.tolist(), f.count.tolist(), strict=True)) == [(5, 1, 8), (5, 2, 2), (9, 0, 1)]
