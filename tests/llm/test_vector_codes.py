"""Product codes against a plain version in Python's integers, and the cases that the docstring names."""

import hashlib
import math
import random

import numpy as np
import pytest

from undertow.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, v array<int>, ID string"


def plain(rows, parts, entries, rounds, scale=256):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    width = length // parts
    x = [[math.floor(scale * c) for c in r[1]] + [0] * (length - len(r[1])) for r in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        places = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, at in zip(cut, places, strict=True) if at[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    places = assign()
    errors = [sum(far(c[p], books[p][at[p]]) for p in range(parts)) for c, at in zip(cut, places, strict=True)]
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    fit = lambda n: n if n < 2**63 else None
    out = [(r[0], "".join(f"{i:02x}" for i in at), fit(e), fit(by_label[r[2]])) for r, at, e in zip(kept, places, errors, strict=True)]
    return sorted(out, key=repr), hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()


def got(spark, rows, parts, entries, rounds):
    df = spark.createDataFrame([(*r, [1], "x") for r in rows], SCHEMA.replace("ID", "other")).repartition(5)
    out, books = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    return sorted(map(tuple, out.drop("label").collect()), key=repr), books.digest()


def vectors(n, length, seed, spread=3.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(length)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("length,parts,entries,rounds", [(8, 4, 4, 2), (15, 3, 8, 1), (7, 7, 5, 3), (10, 4, 6, 2), (24, 2, 3, 0)])
def test_equals_plain(spark, length, parts, entries, rounds):
    rows = vectors(120, length, length)
    assert got(spark, rows, parts, entries, rounds) == plain(rows, parts, entries, rounds)


def test_ties_copies_and_bad_rows(spark):
    rows = [(i, [float(i % 3), 1.0, -0.5, 0.25], i % 2 or None) for i in range(30)] * 2
    rows += [(1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [math.nan] * 4, 1), (4, [math.inf, 0.0, 0.0, 0.0], 1), (None, [9.0, 9.0, 9.0, 9.0], None), (None, [-9.0, 9.0, 9.0, 9.0], 7)]
    assert got(spark, rows, 2, 4, 2) == plain(rows, 2, 4, 2)


def test_lengths_and_few_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [4.0], 1), (3, [], None), (4, [0.5] * 6, 2)]
    assert got(spark, rows, 4, 64, 2) == plain(rows, 4, 64, 2)
    for rows in ([], [(1, None, 1)], [(1, [], 1)]):
        assert got(spark, rows, 4, 64, 2) == plain(rows, 4, 64, 2)


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 10.0 ** (i % 12) for x in v], y) for i, v, y in vectors(60, 8, 5)]
    assert got(spark, rows, 4, 5, 2) == plain(rows, 4, 5, 2)
    assert any(r[2] is None for r in plain([(1, [2.0**44] * 4, 1), (2, [-(2.0**44)] * 4, 1)], 1, 1, 0)[0])
    rows = [(1, [2.0**44] * 4, 1), (2, [-(2.0**44)] * 4, 1), (3, [2.0**50] * 4, 1)]
    assert got(spark, rows, 1, 1, 0) == plain(rows[:2], 1, 1, 0)


def test_one_label_for_most_rows(spark):
    rows = [(i, v, 1 if i % 10 else i) for i, v, _ in vectors(400, 8, 9)]
    assert got(spark, rows, 4, 8, 1) == plain(rows, 4, 8, 1)


def test_transform():
    x = np.random.default_rng(1).integers(-500, 500, (40, 6))
    a = vector_codes.transform(x)
    far = lambda m: ((m[:, None] - m[None]) ** 2).sum(-1)
    assert (far(a) == 8 * far(x)).all()
    eye = vector_codes.transform(np.eye(8, dtype=np.int64)).T
    assert [(np.diff(r) != 0).sum() for r in eye] == list(range(8))
    assert (a[:, 0] == x.sum(1)).all()
