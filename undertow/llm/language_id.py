"""Language identification by hierarchical discrimination.

A linear model first decides the language family; one-versus-one linear support vector machines then separate the
languages within it. Features are the shares of hashed byte trigrams of the whole text (letters lower-cased where
ASCII, runs of other ASCII read as a space each), so a text's margin is a mean of table look-ups and needs no
feature vector.

Learning uses a bounded sample: of the `most_languages` languages with most documents at most `per_language` documents each,
and `most` in all, picked by a hash of id and text, so ids may repeat.
Predictions use the text alone, the whole of it however long. A text that is null, empty or without a letter is `und`
with score 0. Rows are kept one to one, repeated ones too, with all their columns; the outputs' names are parameters
and replace columns of these names. With no labelled rows all are `und`. Between equal scores the language that is
first in alphabetical order wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from undertow.llm.shared import small_batches, spare_name, text_blocks

BINS = 4096
#: Families of ISO 639-1 codes; a language that is not listed is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "cs": "slavic", "pl": "slavic", "ru": "slavic", "uk": "slavic",
}

_MAP = np.arange(256, dtype=np.uint32)
_MAP[:128] = 32
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bin of the trigram at each byte; BINS where it would leave its row or is blank."""
    x = np.append(_MAP[data], np.array([32, 32], np.uint32))
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    bins = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
    bins[code == 0x202020] = BINS
    for back in (1, 2):
        at = offsets[1:] - back
        bins[at[at >= offsets[:-1]]] = BINS
    return bins


@arrow_udf(T.BinaryType())
def feature_vector(text: pa.Array) -> pa.Array:
    out = []
    for _, data, offsets in text_blocks(text):
        bins = trigrams(data, offsets)
        for i, j in zip(offsets[:-1], offsets[1:], strict=True):
            v = np.bincount(bins[i:j], minlength=BINS + 1)[:BINS].astype(np.float32)
            out.append((v / max(1.0, v.sum())).tobytes())
    return pa.array(out, pa.binary())


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float, float]:
    """Linear SVM (squared hinge, L2) by accelerated gradient steps: weights, bias, slope of its logistic score.
    Rows with y = 0 take no part. The step is bounded by the largest eigenvalue, which power iterations estimate."""
    plus, minus = y > 0, y < 0
    share = (0.5 * plus / max(1, plus.sum()) + 0.5 * minus / max(1, minus.sum())).astype(np.float32)
    y = y.astype(np.float32)

    def product(w: np.ndarray) -> np.ndarray:
        return x @ w[:-1] + w[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(x.T @ r, r.sum())

    v = np.ones(x.shape[1] + 1, np.float32)
    for _ in range(30):
        v = back(share * product(v / np.linalg.norm(v)))
    bound = np.float32(2.2 * np.linalg.norm(v) + penalty)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * product(v))
        nxt = v - (np.float32(penalty) * v - 2 * back(share * y * slack)) / bound
        w, v = nxt, nxt + np.float32(t / (t + 3)) * (nxt - w)
    margin = np.median(np.abs(product(w)[y != 0]))
    return w[:-1], float(w[-1]), 4.0 / max(float(margin), 1e-6)


@dataclass
class LanguageModel:
    families: list[str]
    languages: dict[str, list[str]]  # by family
    machines: list[tuple[str, str]]  # ("", family) against the rest, or two languages of one family
    weights: np.ndarray  # (BINS + 1, machines), float32
    bias: np.ndarray
    slope: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row of margins."""
        chance = 1 / (1 + np.exp(-np.clip(margins * self.slope, -30, 30)))
        n, column = len(margins), {m: i for i, m in enumerate(self.machines)}
        of = np.stack([chance[:, column["", f]] if ("", f) in column else np.ones(n) for f in self.families], 1)
        of = of / np.maximum(of.sum(1, keepdims=True), 1e-9)
        family, lang, score = of.argmax(1), np.empty(n, object), of.max(1).copy()
        for k, f in enumerate(self.families):
            rows, names = np.flatnonzero(family == k), self.languages[f]
            votes = np.zeros((len(rows), len(names)))
            for a, b in combinations(range(len(names)), 2):
                p = chance[rows, column[names[a], names[b]]]
                votes[:, a] += p
                votes[:, b] += 1 - p
            votes /= max(1, len(names) - 1)
            best = votes.argmax(1)
            lang[rows] = np.array(names, object)[best]
            if len(names) > 1:
                score[rows] *= votes[np.arange(len(rows)), best]
        return lang, score


def training_sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, most: int = 4800, most_languages: int = 400) -> DataFrame:
    """(l, h, t, text): at most `per_language` texts of each language, and an equal part of `most`, those of least hash of id
    and text; of the `most_languages` most frequent languages (ties in alphabetical order).

    Equal texts under one id count once. The rank runs over narrow rows, expected twice the wanted number a language,
    and only the ranked ones' texts are read on; so neither repeated rows or ids nor the schedule change the sample.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("l"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 40)).alias("h"), F.col(text_col).alias("text"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "l").limit(most_languages).collect()}
    each = min(per_language, max(1, most // max(1, len(counts))))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 2.0 * each / max(1, n) + 20 / max(1, n)))]) if counts else F.lit(None).cast("map<string,double>")
    rows = rows.where(F.col("h") < share[F.col("l")] * float(1 << 40))
    rows = rows.withColumn("t", F.xxhash64("text"))
    narrow = rows.select("l", "h", "t").distinct()
    ranked = narrow.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("r") <= each)
    picked = rows.join(F.broadcast(ranked.drop("r")), ["l", "h", "t"])  # `most` rows at most
    return picked.groupBy("l", "h", "t").agg(F.first("text").alias("text"))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, families: dict[str, str] | None = None, most: int = 4800, most_languages: int = 400) -> LanguageModel | None:
    """Fits on the training sample, `most` vectors of 16 KB at most; None where no row has a language."""
    families = FAMILIES if families is None else families
    sample = training_sample(small_batches(labelled), id_col, text_col, lang_col, per_language, most, most_languages)
    got = sample.select("l", "h", "t", feature_vector("text").alias("v")).sort("l", "h", "t").toArrow()
    if not got.num_rows:
        return None
    y = np.array(got.column("l").to_pylist())
    x, at = np.empty((len(y), BINS), np.float32), 0
    for chunk in got.column("v").chunks:
        if len(chunk):
            _, where, data = chunk.buffers()
            first = np.frombuffer(where, np.int32, 1, chunk.offset * 4)[0]
            x[at : at + len(chunk)] = np.frombuffer(data, np.float32, len(chunk) * BINS, int(first)).reshape(-1, BINS)
            at += len(chunk)
    del got, where, data, chunk
    scale = 1 / (np.sqrt(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x)) + 1e-4)
    x *= scale.astype(np.float32)
    family = np.array([families.get(k, k) for k in y])
    found = sorted(set(family))
    groups = {f: sorted(set(y[family == f])) for f in found}
    machines, fits = [], []
    if len(found) > 1:
        for f in found:
            machines.append(("", f))
            fits.append(_svm(x, np.where(family == f, 1.0, -1.0)))
    for f in found:
        for a, b in combinations(groups[f], 2):
            machines.append((a, b))
            fits.append(_svm(x, (y == a) * 1.0 - (y == b) * 1.0))
    w = np.zeros((BINS + 1, len(fits)), np.float32)
    for i, (v, _, _) in enumerate(fits):
        w[:BINS, i] = v * scale
    return LanguageModel(found, groups, machines, w, np.array([f[1] for f in fits]), np.array([f[2] for f in fits]))


def _letters(texts: pa.Array, rows: np.ndarray) -> np.ndarray:
    return np.array([any(c.isalpha() for c in (texts[int(i)].as_py() or "")) for i in rows], bool)


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", lang_pred: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds the predicted language and its score."""
    if model is None:
        return docs.withColumns({lang_pred: F.lit("und"), score_col: F.lit(0.0)})

    @arrow_udf("lang string, score double")
    def guess(text: pa.Array) -> pa.Array:
        margins, counts, ascii_letters = [], [], []
        for _, data, offsets in text_blocks(text):
            bins = trigrams(data, offsets)
            got = model.weights[bins]
            sums = np.add.reduceat(np.vstack([got, np.zeros((1, got.shape[1]), np.float32)]), np.minimum(offsets[:-1], len(got)), axis=0, dtype=np.float64)
            sums[offsets[1:] == offsets[:-1]] = 0
            used = np.append(0, np.cumsum(bins < BINS))
            seen = np.append(0, np.cumsum(_MAP[data] < 128) - np.cumsum(_MAP[data] == 32))
            margins.append(sums)
            counts.append(used[offsets[1:]] - used[offsets[:-1]])
            ascii_letters.append(seen[offsets[1:]] - seen[offsets[:-1]])
        if not margins:
            return pa.array([], pa.struct([("lang", pa.string()), ("score", pa.float64())]))
        m = np.vstack(margins) / np.maximum(1, np.concatenate(counts))[:, None] + model.bias
        lang, score = model.decide(m)
        rare = np.flatnonzero(np.concatenate(ascii_letters) == 0)
        none = rare[~_letters(text, rare)] if len(rare) else rare
        lang[none], score[none] = "und", 0.0
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    spare = spare_name(docs, "_guess")
    return small_batches(docs).withColumn(spare, guess(text_col)).withColumns({lang_pred: F.col(spare)["lang"], score_col: F.col(spare)["score"]}).drop(spare)
