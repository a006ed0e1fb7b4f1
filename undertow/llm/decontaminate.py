"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Tokens are runs of letters and digits, lower-cased. A seed is a mask over a span of aligned tokens: the span, 12 tokens
or the whole of a shorter item, is three blocks, and each mask cares for two and ignores the third. Every position of
every text and test item is hashed under each mask and the hashes are joined. An aligned span with at most one
substitution leaves two blocks untouched, so some mask finds it. A hit gives a diagonal (text position less item
position); the item is laid along each diagonal once and compared token by token. The two leak when some aligned span
has all tokens equal but one at most. So the rule is the same for items of any length from `least` tokens on; shorter
items, null and empty ones leak nowhere, as a few common words are no passage.

A text's key is a hash of its content, and an item's too: copies share hits, ids may be null or shared, and each row
is verified with its own text. The seed table is broadcast only below `small_seeds` rows, counted first; beyond that
the hashes are shuffled. Hits, some 20 bytes each, are written down; Spark sends them to the texts where they are
at most a million, counted first, and shuffles both sides by key beyond it.

Null and empty texts hold nothing; texts of any length are read whole. One n-gram that a text repeats m times and an
item q times makes m * q hits, which each task sums by diagonal before they are shuffled. Of several diagonals the one
with most equal tokens is returned, then the longest, then the first. Repeated rows and items give one row for each
different (doc, item) pair, null ids being one id. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.llm.shared import few, materialise

SPAN = 12


def masks(span: int) -> list[tuple[int, ...]]:
    """Positions cared for: all but one of three blocks of the span; all of them where it has less than three tokens."""
    edges = [span * i // 3 for i in range(4)]
    return [tuple(p for p in range(span) if not lo <= p < hi) for lo, hi in zip(edges, edges[1:])] if span >= 3 else [tuple(range(span))]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _seeds(rows: DataFrame, key: str, spans: list[int], own: bool = False) -> DataFrame:
    """(key, at, seed) for each position and mask of the column `t`; with `own`, only of the row's own span.
    explode_outer, as the optimiser would otherwise add a filter that tokenises once more."""
    places = F.sequence(F.lit(0), F.greatest(F.size("t") - min(spans), F.lit(0)))
    at = rows.select(key, "t", F.explode_outer(places).alias("at"))
    hashes = []
    for span in spans:
        for n, mask in enumerate(masks(span)):
            h = F.xxhash64(F.lit(3 * span + n), *[F.get("t", F.col("at") + j) for j in mask])
            fits = F.col("at") + span <= F.size("t")
            hashes.append(F.when(fits & (F.least(F.size("t"), F.lit(SPAN)) == span) if own else fits, h))
    return at.select(key, "at", F.explode_outer(F.array(*hashes)).alias("seed")).where("seed is not null")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 6, small_seeds: int = 200_000) -> DataFrame:
    """Returns (doc, item, matched, overlap, start, best): equal tokens along the best diagonal, the number of
    tokens laid over each other, their first token in the text, and the equal ones of the best span."""
    listed = items.select(F.col(item_col).alias("item"), tokens(F.col(item_text_col)).alias("u")).where(F.size("u") >= max(1, least))
    listed = listed.select("item", F.xxhash64("u").alias("whole"), "u").distinct()
    tests = listed.select("whole", F.col("u").alias("t")).dropDuplicates(["whole"])
    spans = sorted(r[0] for r in tests.select(F.least(F.size("t"), F.lit(SPAN))).distinct().collect()) or [SPAN]
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    wanted = _seeds(tests, "whole", spans, own=True).withColumnRenamed("at", "q")
    seeds = _seeds(texts.select("key", tokens(F.col("text")).alias("t")), "key", spans)
    hits = seeds.join(few(wanted, small_seeds), "seed")
    hits = materialise(hits.select("key", "whole", (F.col("at") - F.col("q")).alias("d")).distinct())
    met = texts.join(few(hits), "key").join(listed, "whole")
    rows = met.select("doc", "item", "d", "u", tokens(F.col("text")).alias("t"))
    first = F.greatest(F.lit(0), -F.col("d"))
    n = F.least(F.size("u"), F.size("t") - F.col("d")) - first
    rows = rows.select("doc", "item", "d", "u", "t", first.alias("first"), n.alias("n")).where(F.col("n") >= F.least(F.lit(SPAN), F.size("u")))
    same = F.zip_with(F.slice("u", F.col("first") + 1, F.col("n")), F.slice("t", F.col("first") + F.col("d") + 1, F.col("n")), lambda a, b: (a == b).cast("int"))
    rows = rows.select("doc", "item", "n", (F.col("first") + F.col("d")).alias("start"), same.alias("same"))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    width = F.least(F.lit(SPAN), F.col("n"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), lambda i: total(F.slice(F.col("same"), i, width))))
    rows = rows.select("doc", "item", total(F.col("same")).alias("matched"), F.col("n").alias("overlap"), "start", best.alias("best"))
    leaks = rows.where(f"best >= least({SPAN}, overlap) - 1")
    top = leaks.groupBy("doc", "item").agg(F.max(F.struct("matched", "overlap", (-F.col("start")).alias("s"), "best")).alias("x"))
    return top.select("doc", "item", "x.matched", "x.overlap", (-F.col("x.s")).alias("start"), "x.best")
