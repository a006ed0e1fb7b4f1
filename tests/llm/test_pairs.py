"""The n-gram Jaccard join and the embedding join against brute force."""

import random
import re

import numpy as np
import pytest

from undertow.llm import embedding_dedup, ngram_jaccard
from undertow.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, percent=90):
    sets = {i: shingles(t) for i, t in rows}
    order = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    pairs = []
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if len(sets[j]) * percent > 100 * len(sets[i]):
                break
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                pairs.append((i, j))
    return {i: (len(sets[i]), c) for i, c in components(sets, pairs).items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_jaccard_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(QUERIES["op1_ngram_jaccard"](spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("percent", [62, 70])
def test_jaccard_at_low_percentages(spark, percent):
    """Signatures grow with the set alone; components equal brute force; beyond the promise the join refuses."""
    rng = random.Random(percent)
    for n in (1, 7, 40, 200, 1000, 10_000):
        x = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        assert len(ngram_jaccard.signatures(x, percent, {})) <= 5 * n + 64
    rows = []
    for size in (3, 8, 20, 60, 200):
        text = [f"w{rng.randrange(400)}" for _ in range(size)]
        for _ in range(8):
            rows.append((len(rows), " ".join(text)))
            for _ in range(max(1, size // 25)):
                k = rng.randrange(len(text))
                text = text[:k] + [f"x{rng.randrange(9)}"] * rng.randrange(3) + text[k + 1 :] or ["z"]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(ngram_jaccard.link(docs, percent)[0]) == brute(rows, percent)
    for wrong in (61, 100):
        with pytest.raises(ValueError):
            ngram_jaccard.link(docs, wrong)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_chains_and_classes(spark, seed):
    """Chains of edits, so that components hold pairs that do not link, at sizes around the class bounds."""
    rng, rows = random.Random(seed), []
    for size in (1, 2, 3, 4, 9, 11, 12, 13, 15, 20, 31, 64, 130, 300):
        text = [f"w{rng.randrange(40)}" for _ in range(size)]
        for _ in range(9):
            rows.append((len(rows), " ".join(text)))
            if rng.random() < 0.7:
                k = rng.randrange(len(text))
                text = text[:k] + [f"x{rng.randrange(9)}"] * rng.randrange(3) + text[k + 1 :] or ["z"]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    members, links = ngram_jaccard.link(docs)
    assert result(members) == brute(rows)
    sets = {i: shingles(t) for i, t in rows}
    for r in links.collect():
        assert r.overlap == len(sets[r.a] & sets[r.b])


def test_jaccard_edges(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, text, "x"), (4, text, "x"), (5, text.upper(), "y"), (None, text, "y"), (6, "one", "y"), (7, "ONE", "y"), (8, "x\x0by\x0cz", None), (9, "x y z", None), (10, "x\u00a0y z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.link(docs)[0].collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 28, 4), (4, 28, 4), (5, 28, 4), (None, 28, None), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 8), (10, 1, 10)], key=str)
    assert ngram_jaccard.link(docs.limit(0))[0].count() == 0


def test_long_sets_are_counted_in_fragments(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(9000)]
    near, far = list(base), list(base)
    for k in range(0, 9000, 61):
        near[k] = "n"
    for k in range(0, 9000, 40):
        far[k] = "f"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    assert result(ngram_jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"))[0]) == brute(rows)


def vectors_brute(rows, cosine=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    pairs = []
    for dims in {len(v) for _, v in ok}:
        some = [(i, v / np.abs(v).max()) for i, v in ok if len(v) == dims]
        x = np.array([v / np.linalg.norm(v) for _, v in some])
        pairs += [(some[a][0], some[b][0]) for a, b in np.argwhere(np.triu(x @ x.T >= cosine, 1))]
    ids = [i for i, _ in rows if i is not None]
    comp, links = components(ids, pairs), dict.fromkeys(ids, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return {i: (links[i], comp[i]) for i in ids}


def vector_result(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect() if r.vec_id is not None}


def test_embedding_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert vector_result(QUERIES["op10_embedding_dedup"](spark, sf_dir)) == vectors_brute(rows)


@pytest.mark.parametrize(("dims", "tile"), [(3, 16), (8, 7), (64, 32)])
def test_embedding_groups_tiles_and_edges(spark, dims, tile):
    rng = np.random.default_rng(dims)
    rows = []
    for _ in range(12):
        centre = rng.standard_normal(dims)
        for _ in range(10):
            rows.append((len(rows), (centre + 0.45 * rng.standard_normal(dims)).tolist()))
    for _ in range(30):
        rows.append((len(rows), rows[5][1]))
    for v in (None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] * dims, [None] * dims):
        rows.append((len(rows), v))
    docs = spark.createDataFrame([(i, v, i) for i, v in rows] + [(None, rows[5][1], 0)], "vec_id long, embedding array<double>, kept long").repartition(4)
    out = embedding_dedup.near_duplicates(docs, tile=tile)
    assert vector_result(out) == vectors_brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out.collect())
    assert embedding_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_embedding_lengths_and_magnitudes(spark):
    """Vectors of several lengths, of the least and largest finite magnitudes, and different ones under one id."""
    rng = np.random.default_rng(4)
    rows = []
    for dims in (1, 2, 3, 3, 3, 17):
        for scale in (1e-200, 1.0, 1e200, 1e-310):
            centre = rng.standard_normal(dims)
            for _ in range(3):
                rows.append((len(rows), ((centre + 0.2 * rng.standard_normal(dims)) * scale).tolist()))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert vector_result(embedding_dedup.near_duplicates(docs)) == vectors_brute(rows)
    shared = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(shared).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_different_texts_under_one_id_do_not_join(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (0, "c d e f")]
    got = sorted((r.doc_id, r.component_id) for r in ngram_jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1)]  # each text its own component; both have 1 as smallest id
    links = {(r.a, r.b) for r in ngram_jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()}
    assert {frozenset(x) for x in links} == {frozenset((1, 2)), frozenset((1, 3))}


def test_a_large_group_of_near_copies_and_hot_fragments(spark):
    """Many near copies of one text, some beyond reach of others, and short texts that share a line."""
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(120)], []
    for _ in range(150):
        text = list(base)
        for _ in range(rng.randrange(7)):
            text[rng.randrange(120)] = f"n{rng.randrange(400)}"
        rows.append((len(rows), " ".join(text)))
    for _ in range(60):
        rows.append((len(rows), "a common line of words " + " ".join(f"v{rng.randrange(30)}" for _ in range(rng.randrange(8)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(ngram_jaccard.link(docs)[0]) == brute(rows)


def test_nodes_of_many_buckets_are_compared_with_one_set(spark):
    """Neighbouring buckets agree on a set, so that a node is not taken apart for each of them; none of their pairs is lost."""
    buckets = {i: range(i, i + 9) for i in range(24)} | {100: range(200, 209)}
    large = spark.createDataFrame([(s, n, 9) for s, nodes in buckets.items() for n in nodes], "sig long, node long, size long")
    comp = spark.createDataFrame([(n, (200, 200)) for n in range(200, 209)], "node long, component struct<rep: long, node: long>")
    rows = [tuple(r) for r in ngram_jaccard._mixed(large, comp).collect()]
    of = {n: {a for a, b, _ in rows if b == n} for n in range(32)}
    assert all(of[x] & of[y] for i in range(24) for x in buckets[i] for y in buckets[i])
    assert len(rows) == len(set(rows)) == 32 and {(a, a, a) for a, _, _ in rows} <= set(rows)
