"""License scans: winnowed fingerprints in an inverted index, then banded alignment.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Every template's word 3-grams are hashed and
winnowed: of each `window` neighbouring hashes the least is kept. The index has a posting (fingerprint, template,
place) for each. Texts are winnowed in the same way, so any run of `window` + 2 words in common gives a common
fingerprint. Texts with a fingerprint of the index go on; their fingerprints are joined with the postings, and each
(text, template) gets its diagonals, gathered into bands. Whole copies on a diagonal are reported first. In each band a local
alignment of the template with the text between them is computed, and reported when it covers at least `least` of the
template's words: (template, coverage, start, end) with the span in code points; what lies left and right of it in the
band is aligned again, so copies next to each other are all reported. A band whose best alignment covers less ends there. Of overlapping reports the one with most matched words stays, then the one with
the larger coverage, then the smaller template id.

Templates of one or two words have one hash each, for which every place of a text is looked up: of them whole copies are
reported, from the left. The index's
fingerprints go to the tasks with the function while they are at most `most_prints`, so that texts without one are
left out at once; a larger index is only joined. Either way the postings are joined, and the results are the same.

Fingerprints find whatever has `window` + 2 words of the template in a row. A copy with a substitution in each run of
that length has none in common and is missed although its coverage may be high: measured in the tests, at most a tenth
of copies with 80 % coverage. Nulls, empty texts and templates without words match nothing; long texts and templates
are read whole. Equal templates count once; two texts under one template name are two templates of that name. Rows
stay one to one and keep their columns, repeated ones too; a column named `licenses` is replaced.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from undertow.llm.shared import materialise, mix, small_batches, text_blocks, word_hashes, word_places

GRAM, WINDOW, BAND = 3, 2, 4
_U = np.uint64
_GAPS = np.ones(256, bool)  # all but letters, digits and bytes of characters beyond ASCII
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _grams(w: np.ndarray, n: int) -> np.ndarray:
    h = w[: max(0, len(w) - n + 1)]
    for i in range(1, n):
        h = mix(h) + w[i : i + len(h)]
    return mix(h)


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the hashes that are least in some window."""
    if len(h) <= WINDOW:
        return np.array([int(np.argmin(h))]) if len(h) else np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(1) + np.arange(len(h) - WINDOW + 1)
    return least[np.append(True, least[1:] != least[:-1])]


def _print_rows(text: pa.Array, known: np.ndarray | None, short: list[int]) -> pa.Array:
    """Each text's winnowed (hash, place) and those of all its n-grams of the short lengths; with `known`, those among
    them."""
    hashes, places, counts = [], [], []
    for _, data, offsets in text_blocks(text):
        w, at = word_hashes(data, offsets, _GAPS)
        whole, brief = _grams(w, GRAM), {n: _grams(w, n) for n in short}
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            h = whole[i : max(i, j - GRAM + 1)]
            p = winnow(h)
            h = h[p].view(np.int64)
            for n in short:
                more = brief[n][i : max(i, j - n + 1)].view(np.int64)
                h, p = np.append(h, more), np.append(p, np.arange(len(more)))
            if known is not None:
                ok = np.isin(h, known)
                h, p = h[ok], p[ok]
            hashes.append(h), places.append(p.astype(np.int32)), counts.append(len(h))
    ends = pa.array(np.cumsum([0, *counts]), pa.int32())
    flat = [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((hashes, np.int64), (places, np.int32))]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x) for x in flat], ["fp", "at"]))


def words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's word hashes and their (start, end) in code points."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    w, _, first, last = word_places(data, np.array([0, len(data)]), _GAPS)
    chars = np.cumsum((data & 0xC0) != 0x80)
    return w, np.stack([chars[first] - 1, chars[last]], 1) if len(w) else np.zeros((0, 2), int)


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Local alignment of text[i + shift + (-band..band)] with template[i]: (equal words, first and last text word).

    Equal words score 2, others and gaps -1. Cells of a row are computed together; a gap in the text runs along the
    row, which a running maximum resolves."""
    width = 2 * band + 1
    offsets = np.arange(width)
    score, start, equal = np.zeros(width, int), np.full(width, -1), np.zeros(width, int)
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        at = i + shift - band + offsets
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.clip(at, 0, max(0, len(text) - 1))] == word)
        straight = score + np.where(same, 2, -1)
        begun, hits = np.where(score > 0, start, at), np.where(score > 0, equal, 0) + same
        above = np.append(score[1:], 0) - 1  # a template word that the text lacks
        up = above > straight
        new = np.where(up, above, straight)
        begun = np.where(up, np.append(start[1:], -1), begun)
        hits = np.where(up, np.append(equal[1:], 0), hits)
        lead = np.maximum.accumulate(new + offsets)
        source = np.maximum.accumulate(np.where(new + offsets == lead, offsets, 0))
        new, begun, hits = lead - offsets, begun[source], hits[source]
        dead = (new <= 0) | ~inside
        score, start, equal = np.where(dead, 0, new), np.where(dead, -1, begun), np.where(dead, 0, hits)
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (int(score[k]), int(equal[k]), int(start[k]), int(at[k]))
    return best[1:]


def _bands(shifts: list[int], n: int) -> list[tuple[int, int]]:
    """(first, last) shift of the bands of a template of n words; shifts further apart than a band are apart. Runs of more
    than 2 n shifts are cut into bands that overlap by n, so that the work grows with the text only."""
    runs: list[list[int]] = []
    for s in shifts:
        if runs and s - runs[-1][1] <= BAND:
            runs[-1][1] = s
        else:
            runs.append([s, s])
    return [(at, min(b, at + 2 * n)) for a, b in runs for at in range(a, max(a, b - 2 * n + n - 1) + 1, n)]


def occurrences(template: np.ndarray, text: np.ndarray, shifts: list[int], least: float) -> list[tuple[int, int, int]]:
    """(equal words, first and last text word) of the template's copies near the diagonals: whole ones from the left, then
    in each band the best alignment between them, and again on what it leaves on either side while it reports one."""
    n, shifts = len(template), sorted(set(shifts))
    out, free, at = [], [], 0
    for s in shifts:
        if s >= at and s + n <= len(text) and text[s] == template[0] and np.array_equal(text[s : s + n], template):
            out.append((n, s, s + n - 1))
            free.append((at, s))
            at = s + n
    if n < GRAM:
        return out
    free = [(a, b) for a, b in [*free, (at, len(text))] if b - a >= least * n]
    ends = [b for _, b in free]
    for low, high in _bands(shifts, n):
        low, high = low - BAND, high + BAND
        todo = []
        for a, b in free[bisect_right(ends, low) :]:
            if a >= high + n:
                break
            todo.append((max(a, low), min(b, high + n)))
        while todo:
            a, b = todo.pop()
            if b - a < least * n:
                continue
            left, right = max(low, a - n + 1), min(high, b - 1)
            matched, first, last = align(template, text[a:b], (left + right) // 2 - a, (right - left + 1) // 2)
            if matched and matched >= least * n:
                out.append((matched, a + first, a + last))
                todo += [(a, a + first), (a + last + 1, b)]
    return out


_REPORT = "array<struct<template:string,coverage:double,matched:int,start:int,end:int>>"


_PRINTS = T.ArrayType(T.StructType([T.StructField("fp", T.LongType()), T.StructField("at", T.IntegerType())]))


@arrow_udf(T.StructType([T.StructField("prints", _PRINTS), T.StructField("body", T.ArrayType(T.LongType()))]))
def _template(text: pa.Array) -> pa.Array:
    """A template's fingerprints, one hash of the whole below GRAM words, and its words."""
    prints, bodies = [], []
    for t in text:
        w = words(t.as_py())[0]
        n = len(w)
        prints += _print_rows(pa.array([t.as_py()], pa.string()), None, [n] if 0 < n < GRAM else []).to_pylist()
        bodies.append(w.view(np.int64).tolist())
    kind = [pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int32())])), pa.list_(pa.int64())]
    return pa.StructArray.from_arrays([pa.array(prints, kind[0]), pa.array(bodies, kind[1])], ["prints", "body"])


def scan(docs: DataFrame, templates: DataFrame, text_col: str = "text", template_col: str = "template", template_text_col: str = "text", least: float = 0.8, most_prints: int = 500_000) -> DataFrame:
    """Adds licenses: array of (template, coverage, matched, start, end), by start."""
    listed = templates.where(F.col(template_text_col).isNotNull()).select(F.col(template_col).cast("string").alias("template"), F.col(template_text_col).alias("t")).distinct()
    listed = materialise(listed.select("template", _template("t").alias("x")).select("template", F.xxhash64("template", "x.body").alias("tid"), "x.prints", "x.body").where(F.size("body") > 0))
    index = listed.select("tid", F.explode("prints").alias("p")).select("tid", F.col("p.fp").alias("fp"), F.col("p.at").alias("place"))
    held = index.select("fp").distinct().limit(most_prints + 1)
    few = held.count() <= most_prints
    known = np.sort(np.array([r.fp for r in held.collect()], np.int64)) if few else None
    short = sorted(r[0] for r in listed.where(F.size("body") < GRAM).select(F.size("body")).distinct().collect())

    @arrow_udf(_PRINTS)
    def hits(text: pa.Array) -> pa.Array:
        return _print_rows(text, known, short)

    @arrow_udf(_REPORT)
    def report(text: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, c in zip(text, found, strict=True):
            w, spans = words(t.as_py())
            got = []
            for x in c.as_py():
                body = np.array(x["body"], np.int64).view(_U)
                got += [(-matched, -matched / len(body), x["template"], first, last) for matched, first, last in occurrences(body, w, x["shifts"], least)]
            kept: list[tuple] = []  # apart from each other, by place
            for m, cover, name, first, last in sorted(got):
                i = bisect_right(kept, last, key=lambda k: k[0])
                if i == 0 or kept[i - 1][1] < first:
                    kept.insert(i, (first, last, {"template": name, "coverage": -cover, "matched": -m, "start": int(spans[first][0]), "end": int(spans[last][1])}))
            out.append([k[2] for k in kept])
        kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(out, kind)

    rows = small_batches(docs).drop("licenses")
    text = F.col(text_col)
    keep = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)])
    staged = materialise(rows.select(keep.alias("row"), text.alias("t")).select("row", "t", hits("t").alias("found")).select("row", F.when(F.size("found") > 0, F.col("t")).alias("t"), F.when(F.size("found") > 0, F.col("found")).alias("found")))
    some = staged.where("t is not null").withColumn("key", F.xxhash64("t"))
    shifts = some.select("key", F.explode("found").alias("f")).select("key", F.col("f.fp").alias("fp"), F.col("f.at").alias("at")).join(index, "fp")
    shifts = shifts.groupBy("key", "tid").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))  # within one text
    shifts = shifts.join(listed.select("tid", "template", "body"), "tid")
    candidates = shifts.groupBy("key").agg(F.collect_list(F.struct("template", "shifts", "body")).alias("c"))  # at most one for each template
    done = some.join(candidates, "key", "left").select("row", F.when(F.col("c").isNotNull(), report("t", F.coalesce("c", F.array().cast("array<struct<template:string,shifts:array<int>,body:array<long>>>")))).alias("licenses"))
    done = done.select("row", F.coalesce("licenses", F.array().cast(_REPORT)).alias("licenses"))
    none = staged.where("t is null").select("row", F.array().cast(_REPORT).alias("licenses"))
    return done.union(none).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rows.columns)], "licenses")
