"""Toxicity: a factorization machine over hashed terms.

A text's terms are its different words (letters alone, case folded for A-Z and Latin-1), hashed to 2**`bits` buckets. Its
score is the logistic of a bias, a weight for each term and, for each pair of terms, the product of the terms' factor
vectors: so an insult beside a group's name can weigh more than both alone, which weights by term cannot express. The sum
over pairs takes one pass over the terms, ((sum v)**2 - sum v**2) / 2 for each factor.

Learning uses a bounded sample: at most `most` labelled rows, those of least hashes of id and text, and of these, in that order,
`most_terms` terms in all. Weights are given to terms that go with the label by a likelihood-ratio statistic of `evidence`
(they start at their log odds) and to those that `common` of the texts have, whose pairs may tell. AdaGrad on mini-batches
in a fixed order, label 1 counting `positive` times, so equal tables give equal models. Scores use the text alone, all of it. Null and empty texts have the score of the
bias. Rows stay one to one with their columns (repeated rows too); columns named like the outputs are replaced. Without
labels of both kinds every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from undertow.llm.shared import materialise, scratch, small_batches, text_blocks, word_places

_OTHER = np.ones(256, bool)  # bytes that no word has: all of ASCII but letters
_OTHER[65:91] = _OTHER[97:123] = _OTHER[128:] = False


def _folded(data: np.ndarray) -> np.ndarray:
    """U+00C0 to U+00DE become small letters; A-Z are folded by the hash."""
    out = data.copy()
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[upper] += 0x20
    return out


def terms(text: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of each text's words, in order, and each text's first place among them."""
    found, ends = [np.zeros(0, np.int64)], [0]
    for _, data, offsets in text_blocks(text):
        hashes, at, _, _ = word_places(_folded(data), offsets, _OTHER)
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(at))
        key = np.unique((row << bits) | (hashes >> np.uint64(64 - bits)).astype(np.int64))
        found.append(key & ((1 << bits) - 1))
        ends += (ends[-1] + np.cumsum(np.bincount(key >> bits, minlength=n))).tolist()
    return np.concatenate(found), np.array(ends)


@dataclass
class Machine:
    bits: int
    place: np.ndarray  # by bucket, the row of its weights, or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at = self.place[buckets]
        known = np.concatenate([[0], np.cumsum(at >= 0)])[ends]
        at = at[at >= 0]
        out = np.full(len(ends) - 1, self.bias)
        for a, b in _blocks(known, 1 << 18):
            out[a:b] += _margin(self.weights, self.factors, at[known[a] : known[b]], known[a : b + 1] - known[a])[0]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _blocks(ends: np.ndarray, most: int):
    """Runs of rows with about `most` terms."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b
        a = b


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of x between ends; runs may be empty."""
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    return total[ends[1:]] - total[ends[:-1]]


def _margin(weights: np.ndarray, factors: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear and pairwise terms of each row, and each row's sum of factors."""
    v = factors[at]
    s = _sums(v, ends)
    return _sums(weights[at], ends) + 0.5 * (s * s - _sums(v * v, ends)).sum(1), s


def association(buckets: np.ndarray, ends: np.ndarray, y: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By bucket: its number of texts, its likelihood-ratio statistic of independence from the label, and its log odds of
    label 1 against those of all texts, shrunk by half a text on either side."""
    n = np.bincount(buckets, minlength=1 << bits).astype(float)
    pos = np.bincount(buckets, np.repeat(y, np.diff(ends)), 1 << bits)
    rows, all_pos = len(y), y.sum()
    total = np.zeros(1 << bits)
    for seen, of, label in ((pos, n, all_pos), (n - pos, n, rows - all_pos), (all_pos - pos, rows - n, all_pos), (rows - n - all_pos + pos, rows - n, rows - all_pos)):
        expected = of * label / max(1, rows)
        some = seen > 0.5
        total[some] += 2 * seen[some] * np.log(seen[some] / expected[some])
    odds = np.log((pos + 0.5) / (n - pos + 0.5)) - np.log((all_pos + 0.5) / (rows - all_pos + 0.5))
    return n, total, odds


def train(buckets: np.ndarray, ends: np.ndarray, y: np.ndarray, bits: int, factors: int = 8, epochs: int = 20, batch: int = 64, rate: float = 0.1, ridge: float = 5e-4, evidence: float = 10.0, common: float = 0.1, positive: float = 3.0, seed: int = 7) -> Machine:
    n, statistic, odds = association(buckets, ends, y, bits)
    used = np.flatnonzero((statistic >= evidence) | (n >= max(2, common * len(y))))
    place = np.full(1 << bits, -1, np.int64)
    place[used] = np.arange(len(used))
    at = place[buckets]
    ends = np.concatenate([[0], np.cumsum(at >= 0)])[ends]
    at = at[at >= 0]
    rng = np.random.default_rng(seed)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, w, v = float(np.log(p / (1 - p))), np.where(statistic >= evidence, odds, 0.0)[used], rng.normal(0, 0.01, (len(used), factors))
    seen_w, seen_v = np.full(len(used), 1e-6), np.full((len(used), factors), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            sizes = ends[rows + 1] - ends[rows]
            stop = np.concatenate([[0], np.cumsum(sizes)])
            terms_ = at[np.repeat(ends[rows] - stop[:-1], sizes) + np.arange(stop[-1])]
            linear, s = _margin(w, v, terms_, stop)
            q = 1 / (1 + np.exp(-np.clip(bias + linear, -30, 30)))
            error = (q - y[rows]) * np.where(y[rows] > 0, positive, 1.0) / len(rows)
            each = np.repeat(error, sizes)
            own, back = np.unique(terms_, return_inverse=True)
            slope = np.bincount(back, each, len(own)) + ridge * w[own]
            wide = each[:, None] * (np.repeat(s, sizes, axis=0) - v[terms_])
            steep = np.stack([np.bincount(back, wide[:, f], len(own)) for f in range(factors)], 1) + ridge * v[own] if len(own) else np.zeros((0, factors))
            seen_w[own] += slope**2
            seen_v[own] += steep**2
            w[own] -= rate * slope / np.sqrt(seen_w[own])
            v[own] -= 0.2 * rate * steep / np.sqrt(seen_v[own])
            bias -= rate * float(error.sum())
    return Machine(bits, place, bias, w, v)


def _term_list(bits: int):
    @arrow_udf("array<int>")
    def of(text: pa.Array) -> pa.Array:
        buckets, ends = terms(text, bits)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(buckets, pa.int32()))

    return of


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(h, y, t): at most `most` labelled texts, in the order of a hash of id and text. Equal texts under one id count once, with
    the id's largest label."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    with_hash = lambda df: df.withColumn("h", F.xxhash64("id", "t"))
    keys = with_hash(texts).select("id", "h").join(known, "id").distinct().orderBy("h", "id").limit(most)
    rows = with_hash(texts).join(F.broadcast(keys), ["id", "h"])
    return rows.groupBy("id", "h").agg(F.first("y").alias("y"), F.first("t").alias("t"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 12_000, most_terms: int = 4_000_000, bits: int = 18) -> Machine | None:
    """Fits on at most `most` rows and `most_terms` terms of them, whole texts only."""
    rows = small_batches(sample(docs, labels, id_col, text_col, label_col, most)).select("h", "id", F.col("y").cast("double").alias("y"), _term_list(bits)("t").alias("x"))
    with scratch():
        rows = materialise(rows)
        sizes = rows.select("h", "id", F.size("x").alias("n")).toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
        within = int((np.cumsum(sizes["n"].to_numpy()) <= most_terms).sum())
        if not within:
            return None
        last_h, last_id = sizes["h"][within - 1].as_py(), F.lit(sizes["id"][within - 1].as_py())
        found = rows.where((F.col("h") < last_h) | (F.col("h") == last_h) & (F.col("id") <= last_id)).select("h", "id", "y", "x").toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
    y = found["y"].to_numpy()
    if len(set(y > 0)) < 2:
        return None
    x = found["x"].combine_chunks()
    ends = np.concatenate([[0], np.cumsum(np.diff(x.offsets.to_numpy()))])
    return train(x.flatten().to_numpy().astype(np.int64), ends, (y > 0).astype(float), bits)


def score(docs: DataFrame, model: Machine | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score and predicted (1 where score >= threshold)."""
    if model is None:
        out = docs.withColumn("score", F.lit(0.5))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        @arrow_udf("double")
        def of(text: pa.Array) -> pa.Array:
            return pa.array(sent.value.score(*terms(text, sent.value.bits)))

        out = small_batches(docs).withColumn("score", of(text_col))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
