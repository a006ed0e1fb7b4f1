"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins at quantiles of the training sample. Boosting goes round the features in
turn; each step fits a tree of up to four leaves to one feature's binned gradients and adds it, shrunk, to that
feature's look-up table. The feature pairs whose residuals a tree on a two-way grid fits best then get tables of
their own, boosted in the same way. A score is the logistic of a sum of look-ups, for a whole batch at a time.

Learning uses a bounded sample: `most` labelled rows, picked by a hash of the id, joined to their texts. Scores use
the text alone, all of it. Null and empty texts get the features of an empty text. Rows stay one to one with their
columns (repeated rows too); columns named like the outputs are replaced. Without labels every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from undertow.llm.shared import mix, small_batches, text_blocks, word_hashes

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 , . ; : ' -, 7 other marks, 8 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9]], _CLASS[[10, 13]] = 4, 5
_CLASS[[33, *range(34, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 7
_CLASS[[ord(c) for c in ",.;:'-"]] = 6
_CLASS[128:] = 8
FEATURES = ("length", "words", "word_length", "upper", "digits", "marks", "stops", "lines", "beyond", "distinct_words", "distinct_pairs", "same_next", "top_word", "distinct_lines", "long_line")


def features(text: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = []
    for _, data, offsets in text_blocks(text):
        words, at = word_hashes(data, offsets)
        kinds = _CLASS[data]
        ends = np.flatnonzero(data == 10)
        for i in range(len(offsets) - 1):
            a, b, w = offsets[i], offsets[i + 1], words[at[i] : at[i + 1]]
            n, m = max(1, b - a), max(1, len(w))
            k = np.bincount(kinds[a:b], minlength=9)
            letters = max(1, k[1] + k[2])
            _, counts = np.unique(w, return_counts=True)
            pairs = len(np.unique(mix(w[1:]) + w[:-1])) if len(w) > 1 else 0
            cuts = np.concatenate([[a], ends[np.searchsorted(ends, a) : np.searchsorted(ends, b)] + 1, [b + 1]])
            sizes = np.diff(cuts) - 1
            lines = {bytes(data[p : q - 1]) for p, q in zip(cuts[:-1], cuts[1:], strict=True)} if len(cuts) > 2 else {0}
            out.append((
                np.log1p(b - a), np.log1p(len(w)), (k[1] + k[2] + k[8]) / m, k[2] / letters, k[3] / n, k[7] / n, k[6] / m, len(sizes) / m, k[8] / n,
                len(counts) / m, pairs / m, (w[1:] == w[:-1]).sum() / m, counts.max(initial=0) / m, len(lines) / max(1, len(sizes)), sizes.max(initial=0) / n,
            ))
    return np.array(out, np.float64).reshape(-1, len(FEATURES))


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]  # by feature, upper bounds of all bins but the last
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j])]
        if self.pairs:
            c = [np.searchsorted(e, x[:, j]) for j, e in enumerate(self.coarse)]
            for (a, b), t in self.pairs.items():
                total += t[c[a], c[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Values by bin of a tree of up to 2**depth leaves over gradient and curvature sums."""
    gs, hs = np.cumsum(g), np.cumsum(h)
    value = gs[-1] / (hs[-1] + ridge)
    if depth and len(g) > 1:
        gain = _gain(gs[:-1], hs[:-1], ridge) + _gain(gs[-1] - gs[:-1], hs[-1] - hs[:-1], ridge) - _gain(gs[-1], hs[-1], ridge)
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] > 1e-9:
            return np.append(_tree(g[:k], h[:k], depth - 1, ridge), _tree(g[k:], h[k:], depth - 1, ridge))
    return np.full(len(g), value)


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Values by cell of the best four-leaf tree that cuts one axis and then, on either side, the other; its gain."""
    best, gain = np.zeros_like(g), 0.0
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(a)):
            out, total = np.empty_like(a), 0.0
            for rows in (slice(0, k), slice(k, None)):
                v = _tree(a[rows].sum(0), b[rows].sum(0), 1, ridge)
                out[rows] = v
                total += float((a[rows].sum(0) * v).sum())
            if total > gain:
                best, gain = (out.T if flip else out).copy(), total
    return best, gain


def train(x: np.ndarray, y: np.ndarray, bins: int = 32, grid: int = 8, rounds: int = 60, rate: float = 0.15, pairs: int = 6, ridge: float = 4.0) -> AdditiveModel:
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = AdditiveModel(_cuts(x, bins), _cuts(x, grid), float(np.log(p / (1 - p))), [], {})
    at = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def sums(place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return np.bincount(place, y - q, n), np.bincount(place, q * (1 - q), n)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            step = rate * _tree(*sums(at[j], len(table)), 2, ridge)
            table += step
            total += step[at[j]]
    c = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.coarse)]
    shape = [len(e) + 1 for e in model.coarse]
    place = {(a, b): c[a] * shape[b] + c[b] for a, b in combinations(range(len(c)), 2)}
    grids = lambda a, b: [s.reshape(shape[a], shape[b]) for s in sums(place[a, b], shape[a] * shape[b])]
    gains = {k: _grid_tree(*grids(*k), ridge)[1] for k in place}
    chosen = sorted(gains, key=gains.get, reverse=True)[:pairs]
    model.pairs = {k: np.zeros((shape[k[0]], shape[k[1]])) for k in chosen}
    for _ in range(rounds // 3):
        for k in chosen:
            step = rate * _grid_tree(*grids(*k), ridge)[0]
            model.pairs[k] += step
            total += step.reshape(-1)[place[k]]
    return model


@arrow_udf(T.ArrayType(T.DoubleType()))
def _feature_list(text: pa.Array) -> pa.Array:
    x = features(text)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.reshape(-1)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 12_000) -> AdditiveModel | None:
    """Fits on at most `most` of the rows of `labels` (id, label) that have a text, those of least hashes; equal texts
    under one id count once."""
    wanted = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    wanted = wanted.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = small_batches(texts).join(F.broadcast(wanted), "id").groupBy("id", F.xxhash64("t").alias("k")).agg(F.first("y").alias("y"), F.first("t").alias("t"))
    rows = rows.orderBy(F.xxhash64("id", "k"), "id", "k").limit(most).select("id", "y", _feature_list("t").alias("x")).collect()
    if len({r.y for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.id, r.x))
    return train(np.array([r.x for r in rows]), np.array([float(r.y) for r in rows]))


def score(docs: DataFrame, model: AdditiveModel | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score and predicted (1 where score >= threshold)."""

    @arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        return pa.array(model.score(features(text)))

    out = small_batches(docs).withColumn("score", F.lit(0.5) if model is None else of(text_col))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
