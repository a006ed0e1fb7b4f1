"""The pipeline's near-copy stage and the join at the stage's width, against brute force."""

import random

import numpy as np
import pytest
from tests.llm.test_pairs import WORD, components

import corpus_pipeline
from undertow.llm import ngram_jaccard


def brute(rows, width, percent):
    def shingles(text):
        w = WORD.findall(text.lower())
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}

    sets = {i: shingles(t) for i, t in rows}
    pairs = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return components(sets, pairs)


def test_one_changed_word_of_fifty_is_a_near_copy(spark, sf_dir):
    text = [f"w{i}" for i in range(50)]
    changed = [*text[:25], "other", *text[26:]]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame([(7, " ".join(changed), "en", "s", 1), (3, " ".join(text), "en", "s", 1)], schema)
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, sf_dir).collect()] == [3]


@pytest.mark.parametrize("seed", [1, 2])
def test_five_words_at_80_percent_equal_brute_force(spark, seed):
    """Chains of edits at sizes with few and with many empty fragments."""
    rng, rows = random.Random(seed), []
    for size in (1, 4, 5, 6, 8, 9, 10, 13, 17, 24, 40, 56, 90, 180, 400, 900):
        text = [f"w{rng.randrange(400)}" for _ in range(size)]
        for _ in range(8):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rng.randrange(1 + max(1, size // 40))):
                k = rng.randrange(len(text))
                text = text[:k] + [f"x{rng.randrange(9)}"] * rng.randrange(3) + text[k + 1 :] or ["z"]
    rng.shuffle(rows)
    members, _ = ngram_jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent=80, width=5)
    assert {r.doc_id: r.component_id for r in members.collect()} == brute(rows, 5, 80)


def test_null_and_shared_ids_do_not_decide(spark, sf_dir):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (5, d), (9, d), (2, e), (None, e), (9, a), (1, ""), (1, ""), (None, "")]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, sf_dir).collect()]
    assert sorted(got, key=str) == sorted([(9, a), (None, b), (5, c), (5, d), (2, e), (1, ""), (1, ""), (None, "")], key=str)


def test_sketches_never_say_more_than_sets_differ_in():
    rng = np.random.default_rng(5)
    for n, m, shared in ((1, 1, 0), (3, 700, 2), (600, 600, 0), (1000, 1040, 950), (1023, 1024, 1023), (5000, 4200, 4100), (4000, 4000, 4000)):
        both = rng.integers(0, 2**64, shared, np.uint64)
        x, y = (np.unique(np.append(both, rng.integers(0, 2**64, k - shared, np.uint64))) for k in (n, m))
        least = ngram_jaccard.least_difference(ngram_jaccard.sketch(x), ngram_jaccard.sketch(y))
        assert least <= len(np.setxor1d(x, y)) and (least > 0.4 * n if not shared and n > 500 else True)
    crowd = np.arange(900, dtype=np.uint64)  # all in one range, where counts are cut
    assert ngram_jaccard.least_difference(ngram_jaccard.sketch(crowd), ngram_jaccard.sketch(crowd[:800])) <= 100


def test_long_texts_with_a_common_passage_are_not_moved_as_pairs(spark, monkeypatch):
    """Their fragments are so fine that some agree, and counts of 128 ranges are alike in all of them."""
    rng = random.Random(6)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(2000)]
    texts = [passage + [f"w{rng.randrange(10**6)}" for _ in range(4000)] for _ in range(5)]
    changed = list(texts[0])
    for k in range(0, 6000, 120):
        changed[k] = "n"
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, changed])]
    compared, overlaps = [], ngram_jaccard._overlaps

    def seen(pairs, sets, percent):
        compared.append(pairs.count())
        return overlaps(pairs, sets, percent)

    monkeypatch.setattr(ngram_jaccard, "_overlaps", seen)
    members, _ = ngram_jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), percent=80, width=5, passes=2)
    assert {r.doc_id: r.component_id for r in members.collect()} == brute(rows, 5, 80)
    assert sum(compared) == 1


def test_members_that_can_meet_nobody_stay_out_of_the_join_by_shingle(spark, monkeypatch):
    """A common line of otherwise different sets: beside their pivot they all miss the same shingles of it."""
    line, pivot = list(range(5)), list(range(40))
    sets = {0: pivot} | {i: line + list(range(1000 * i, 1000 * i + 40)) for i in range(1, 13)}
    sets |= {20: line + list(range(50_000, 50_040)), 21: line + list(range(50_001, 50_041))}
    parts = spark.createDataFrame([(n, 0, x) for n, x in sets.items()], "node long, v int, part array<long>")
    known = spark.createDataFrame([(n, len(x)) for n, x in sets.items()], "node long, n int")
    members = spark.createDataFrame([(0, n, n) for n in sets], "a long, b long, c long")
    written, materialise = [], ngram_jaccard.materialise

    def seen(df):
        out = materialise(df)
        if "list" in out.columns:
            written.extend(r.b for r in out.collect())
        return out

    monkeypatch.setattr(ngram_jaccard, "materialise", seen)
    found = {tuple(r) for r in ngram_jaccard._beside_pivot(members, parts, known, 80).collect()}
    assert found == {(20, 21)} | {(0, n) for n in sets if n}
    assert sorted(written) == [20, 21]
