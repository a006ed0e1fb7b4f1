"""Phrase collocation mining with counting quotient filters.

A-Z are lower-cased, texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at spaces and tabs into words. All
counts are per language (null: `und`) and over all texts, whole:

1. Words are counted in each task and summed; those seen `least` times get an id (language and word), the `most_words`
   most frequent of them at most, so that the dictionary that tasks hold is bounded. Texts are written once as ids.
2. Length by length, each task counts its n-grams of such words in a counting quotient filter, cut by the leading bits of
   the permuted n-grams; pieces of one range are merged where they meet, counts below `least` go. An n-gram is counted
   only if both its n-grams of one word less may be frequent: the quotients that the last length occupies, a bit vector of
   fixed size, tell so. The vector errs on one side only, and the counts stay exact.
3. Phrases with a frequent word beyond the dictionary, if there are any, are counted as strings by Spark instead.

A phrase's parts are at least as frequent as the phrase, so these tables hold every count that a score needs. Filters go on
when they hold `slots` n-grams, and ranges are numerous enough for 2**23 n-gram occurrences each, so memory is bounded.

Null and empty texts and pieces without words count nothing; a table without candidates gives an empty result. Repeated
rows count as often as they occur; no other column than text and language is read. Ties in score and count are broken by
the phrase's UTF-8 bytes. Scores are whole numbers in decimals of 38 digits: exact while a * n < 10**35.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.quotient_filter import Filter, Packing
from undertow.llm.shared import few, materialise, scratch, text_blocks

#: Bits of the vector that tells which n-grams may be frequent (16 MB), of a part of it (4 KB).
_BITS, _PART = 27, 15
_SPLITS, _GAPS = np.zeros(256, bool), np.zeros(256, bool)
_SPLITS[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAPS[[32, 9]] = True
_GAPS |= _SPLITS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """For runs of texts: the first row, all words, each word's row, and whether it begins a piece."""
    for row, data, offsets in text_blocks(column, 1 << 20):
        word = ~_GAPS[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        begins[edges], ends[edges - 1] = word[edges], word[edges - 1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
        where = np.concatenate([[0], np.cumsum(stops - starts + 1)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(_LOWER[data[word]]))
        of = np.searchsorted(offsets, starts, "right") - 1
        piece = np.cumsum(_SPLITS[data])[starts] if len(starts) else np.zeros(0, np.int64)
        first = np.ones(len(starts), bool)
        first[1:] = (piece[1:] != piece[:-1]) | (of[1:] != of[:-1])
        yield row, words, of, first


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, word, count) of a task's texts, and with a null word the language's count of all words."""
    names, held, size = ["lang", "word", "n"], [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(names)

    for batch in batches:
        lang, langs = _codes(batch.column(0))
        for row, words, of, _ in words_of(batch.column(1)):
            if not len(words):
                continue
            at, known = _codes(words)
            key, n = np.unique(lang[row + of] * len(known) + at, return_counts=True)
            held.append(pa.table([langs.take(pa.array(key // len(known))), known.take(pa.array(key % len(known))), pa.array(n)], names))
            code, n = np.unique(lang[row + of], return_counts=True)
            held.append(pa.table([langs.take(pa.array(code)), pa.nulls(len(code), pa.string()), pa.array(n)], names))
            size += len(held[-2])
            if size > 400_000:
                held = [summed()]
                size = len(held[0])
                if size > 200_000:
                    yield from held.pop().to_batches()
                    size = 0
    if held:
        yield from summed().to_batches()


def count_words(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, n) of words seen `least` times; a null word has the count of all words of the language."""
    found = docs.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return found.where(F.col("word").isNull() | (F.col("n") >= least))


class Dictionary:
    """Ids of frequent words by language; `whole` if every frequent word has one."""

    def __init__(self, rows: list, whole: bool):
        self.whole = whole
        self.langs, self.words = [r.lang for r in rows], [r.word for r in rows]
        self.bits = max(1, (len(rows) - 1).bit_length())

    def places(self) -> dict[str, dict[str, int]]:
        """The ids by language and word. A task makes them when it begins."""
        out: dict[str, dict[str, int]] = {}
        for i, (lang, word) in enumerate(zip(self.langs, self.words, strict=True)):
            out.setdefault(lang, {})[word] = i
        return out


def _ids(words: pa.Array, lang: np.ndarray, langs: list, places: dict) -> np.ndarray:
    """Each word's id, or -1."""
    at, known = _codes(words)
    pair, back = np.unique(lang * max(1, len(known)) + at, return_inverse=True)
    known = known.to_pylist()
    own = [places.get(langs[p // len(known)], {}).get(known[p % len(known)], -1) for p in pair.tolist()]
    return np.array(own, np.int64)[back] if len(own) else np.zeros(0, np.int64)


def as_ids(docs: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Runs of two and more words with ids, -1 between them, as 32-bit integers in one value for each block of texts."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionary)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value.places()
        for batch in batches:
            lang, langs = _codes(batch.column(0))
            langs = langs.to_pylist()
            for row, words, of, first in words_of(batch.column(1)):
                ids = _ids(words, lang[row + of], langs, places)
                out = np.full(len(ids) + int(first.sum()), -1, np.int32)
                out[np.arange(len(ids)) + np.cumsum(first)] = ids
                alone = (out < 0) | ((np.append(out[1:], -1) < 0) & (np.append(-1, out[:-1]) < 0))  # no neighbour with an id
                out[alone] = -1
                out = out[~alone | np.append(False, ~alone[:-1])]
                if len(out):
                    yield pa.record_batch([pa.array([out.astype("<i4").tobytes()], pa.binary())], ["ids"])

    return docs.mapInArrow(coded, "ids binary")


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def count_phrases(ids: DataFrame, dictionary: Dictionary, k: int, least: int, occupied: np.ndarray | None, range_bits: int, slots: int = 1 << 20) -> DataFrame:
    """(lang, words, n, at) of n-grams of k words seen `least` times; `at` is the place in the next length's bit vector.
    `occupied`: that vector of one length less."""
    packing, shorter = Packing(k, dictionary.bits), Packing(k - 1, dictionary.bits)
    range_bits = min(range_bits, packing.top_bits)
    places, before = min(_BITS, packing.top_bits), min(_BITS, shorter.top_bits)
    spark = ids.sparkSession
    seen = spark.sparkContext.broadcast(occupied) if occupied is not None else None
    sent = spark.sparkContext.broadcast(dictionary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Filter] = []

        def sent_on() -> Iterator[pa.RecordBatch]:
            pieces = held[0].merge(*held[1:]).pieces(range_bits)
            held.clear()
            yield pa.record_batch([pa.array([r for r, _ in pieces], pa.int32()), pa.array([f.to_bytes(range_bits) for _, f in pieces], pa.binary())], ["range", "filter"])

        waiting: list[np.ndarray] = []

        def count() -> None:
            flat = np.concatenate(waiting)
            waiting.clear()
            known = flat >= 0
            fits = np.flatnonzero(np.logical_and.reduce([known[i : len(flat) - k + 1 + i] for i in range(k)]))
            if seen is not None and len(fits):
                ends = np.union1d(fits, fits + 1)
                ends = ends[_set(seen.value, shorter.quotient(shorter.permute(np.stack([flat[ends + i] for i in range(k - 1)], 1))[0], before))]
                fits = fits[np.isin(fits, ends, assume_unique=True) & np.isin(fits + 1, ends, assume_unique=True)]
            if len(fits):
                held.append(Filter.of(packing, np.stack([flat[fits + i] for i in range(k)], 1)))
            if len(held) > 8 or sum(map(len, held)) > slots:
                held[:] = [held[0].merge(*held[1:])] if held else []

        for batch in batches:
            for value in batch.column(0):
                waiting += [np.frombuffer(value.as_buffer(), "<i4"), np.full(1, -1, np.int32)]
                if sum(map(len, waiting)) > 1 << 18:
                    count()
                    if sum(map(len, held)) > slots:
                        yield from sent_on()
        if waiting:
            count()
        if held:
            yield from sent_on()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of a range follow each other."""
        langs, words = sent.value.langs, sent.value.words
        now, held = None, []

        def frequent() -> Iterator[pa.RecordBatch]:
            f = held[0].merge(*held[1:])
            held.clear()
            keep = f.count >= least
            if keep.any():
                f = Filter(packing, f.top[keep], f.rest[keep], f.count[keep])
                rows = f.ids().tolist()
                yield pa.record_batch([
                    pa.array([langs[r[0]] for r in rows]), pa.array([[words[i] for i in r] for r in rows]), pa.array(f.count), pa.array(packing.quotient(f.top, places).astype(np.int64)),
                ], ["lang", "words", "n", "at"])

        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and at != now:
                    yield from frequent()
                now = at
                held.append(Filter.from_bytes(packing, range_bits, at, data.as_py()))
                if len(held) > 1 and sum(map(len, held[1:])) > max(len(held[0]), slots):
                    held[:] = [held[0].merge(*held[1:])]
        if held:
            yield from frequent()

    pieces = ids.mapInArrow(counted, "range int, filter binary").repartition("range").sortWithinPartitions("range")
    return pieces.mapInArrow(merged, "lang string, words array<string>, n long, at long")


def occupied(found: DataFrame) -> np.ndarray:
    """The bit vector of the places in `at`, put together from parts of 4 KB; at most 4096 of them reach the driver."""
    out = np.zeros(1 << (_BITS - 3), np.uint8)
    parts = found.groupBy(F.shiftright("at", _PART).alias("part")).agg(F.expr(f"bitmap_construct_agg(at & {(1 << _PART) - 1})").alias("bits"))
    for r in parts.collect():
        out[r.part << (_PART - 3) : (r.part + 1) << (_PART - 3)] = np.frombuffer(r.bits, np.uint8)
    return out


def rare_phrases(docs: DataFrame, dictionary: Dictionary, longest: int, least: int) -> DataFrame:
    """(lang, words, n) of phrases with a word beyond the dictionary."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionary)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value.places()
        for batch in batches:
            lang, langs = _codes(batch.column(0))
            langs = langs.to_pylist()
            for row, words, of, first in words_of(batch.column(1)):
                rare = np.concatenate([[0], np.cumsum(_ids(words, lang[row + of], langs, places) < 0)])
                piece = np.cumsum(first)
                for k in range(2, longest + 1):
                    start = np.arange(max(0, len(words) - k + 1))
                    start = start[(piece[start] == piece[start + k - 1]) & (rare[start + k] > rare[start])]
                    for at in np.array_split(start, -(-len(start) // 20_000)) if len(start) else ():
                        text = pc.binary_join_element_wise(*[words.take(pa.array(at + i)) for i in range(k)], " ")
                        yield pa.record_batch([pa.array([langs[i] for i in lang[row + of[at]]], pa.string()), text], ["lang", "phrase"])

    found = docs.mapInArrow(phrases, "lang string, phrase string").groupBy("lang", "phrase").agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= least).select("lang", F.split("phrase", " ").alias("words"), "n")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, most_words: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of all phrases of 1 to `longest` words seen `least` times, and (lang, n) with the count of all
    words."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    with scratch() as tables:
        words = tables.keep(materialise(count_words(texts, least)))
        known = words.where("word IS NOT NULL")
        rows = known.orderBy(F.col("n").desc(), "lang", "word").select("lang", "word").limit(most_words).collect()
        totals = words.where("word IS NULL").select("lang", "n")
        total = totals.agg(F.sum("n")).first()[0] or 0
        parts = [known.select("lang", F.array("word").alias("words"), "n")]
        if rows:
            dictionary = Dictionary(rows, len(rows) < most_words or known.count() == len(rows))
            ids, seen = materialise(as_ids(texts, dictionary)), None
            range_bits = max(8, (total >> 23).bit_length())
            for k in range(2, longest + 1):
                found = tables.keep(materialise(count_phrases(ids, dictionary, k, least, seen, range_bits)))
                parts.append(found.select("lang", "words", "n"))
                seen = occupied(found)
                if not seen.any():
                    break
            if not dictionary.whole:
                parts.append(rare_phrases(texts, dictionary, longest, least))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        counts = tables.keep(materialise(out.select("lang", F.array_join("words", " ").alias("phrase"), F.size("words").alias("k"), "n")))
    return counts, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, keep: int = 2000, absorb: int = 100, most_words: int = 250_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the first `keep` phrases of 2 to `longest` words seen a >=
    `least` times. Score is floor(1000 * a * n / (l * r)) of the cut into l and r that gives the least. Phrases inside a
    longer one with 100 * its count >= absorb * a are left out."""
    counts, totals = frequent_phrases(docs, text_col, lang_col, least, longest, most_words)
    phrases = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("right"))
    shorter = counts.where(f"k < {longest}")
    cuts = cuts.join(shorter.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(shorter.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(few(totals), "lang")
    whole = cuts.withColumn("over", F.expr("CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0))")).withColumn("under", F.expr("CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))"))
    scored = whole.withColumn("score", F.expr("CAST((over - over % under) / under AS BIGINT)"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda at: F.array_join(F.slice("w", at, n), " "))))
    inside = phrases.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(inside, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {absorb} * a")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    rows = left.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= keep)  # a language may hold most phrases
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
