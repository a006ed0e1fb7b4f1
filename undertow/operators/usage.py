"""The log of a language model's calls as tables: what each call read, wrote and cost, by stage and in total.

A call is a row (tag, model, input, output, cache_read, cache_write, cost); tag names the stage that made it. Null amounts
count as 0, a null tag is a group of its own, and more columns may follow. Costs are summed as decimals, so that no sum
depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.sources.artifacts import document_parts

AMOUNTS = ["input", "output", "cache_read", "cache_write"]
MONEY = "decimal(28,9)"
_CALL = "tag string, model string, " + ", ".join(f"{c} long" for c in AMOUNTS) + f", cost {MONEY}"
_SUMS = "calls long, " + ", ".join(f"{c} long" for c in AMOUNTS) + f", cost {MONEY}"
_GROUP = f"tag string, {_SUMS}"


def _typed(calls: DataFrame) -> DataFrame:
    zero = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c)
    return calls.select("tag", "model", *[zero(c, "long") for c in AMOUNTS], zero("cost", MONEY))


def record(calls: DataFrame, folder: str) -> None:
    """Adds calls to the log. Several jobs may add at once; one that fails adds nothing."""
    _typed(calls).write.mode("append").parquet(folder)


def log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_CALL).parquet(folder)


def cached_percent(read: Column, total: Column) -> Column:
    """The share of the input that came from a cache, in percent with one digit; 0 without input."""
    return F.coalesce(F.round(100.0 * read / F.nullif(total, F.lit(0)), 1), F.lit(0.0))


def summary(calls: DataFrame) -> DataFrame:
    """(tag, is_total, calls, input, output, cache_read, cache_write, cost, cached_percent): one row for each tag, and one
    of all calls with the tag null. A log without calls has no rows."""
    rows = _typed(calls).rollup("tag")
    sums = [F.sum(c).alias(c) for c in AMOUNTS]
    out = rows.agg((F.grouping("tag") == 1).alias("is_total"), F.count("*").alias("calls"), *sums, F.sum("cost").cast(MONEY).alias("cost"))
    return out.withColumn("cached_percent", cached_percent(F.col("cache_read"), F.col("input")))


def line(totals: DataFrame) -> DataFrame:
    """(line): the row of all calls as a sentence."""
    text = lambda c: F.col(c).cast("string")
    parts = [text("calls"), " calls, ", text("input"), " in (", text("cache_read"), " cached = ", text("cached_percent"), "%), ", text("output"), " out, $", F.round("cost", 3).cast("decimal(28,3)").cast("string")]
    return totals.where("is_total").select(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("line"))


def _renamed(names: list[str]) -> list[Column]:
    """Columns under the names that the document uses."""
    return [F.col(c).alias({"cache_read": "cacheRead", "cache_write": "cacheWrite"}.get(c, c)) for c in names]


def save_report(calls: DataFrame, path: str, rows: int = 10_000) -> None:
    """Writes totals, sums by tag and all calls as one document of parts (see artifacts.save_run): a line holds the totals or
    at most `rows` calls or tags, so no task holds the log. Calls stand in the order of their column seq, if they have one.
    Without calls nothing is written."""
    if calls.isEmpty():
        return
    sums = summary(calls)
    of = _renamed(["calls", *AMOUNTS, "cost"])
    head = sums.where("is_total").select(F.to_json(F.struct(F.struct(*of).alias("totals"))).alias("value"))
    tags = sums.where("not is_total").withColumn("seq", F.coalesce("tag", F.lit(""))).select("seq", "tag", *of)
    seq = [F.col("seq")] if "seq" in calls.columns else []
    told = _typed(calls) if not seq else calls.select(*[c for c in calls.columns if c in ("seq", "tag", "model", *AMOUNTS, "cost")])
    told = told.select(*seq, "tag", "model", *[c.cast(MONEY if n == "cost" else "long").alias(a) for n, a, c in ((n, r, F.coalesce(F.col(n), F.lit(0))) for n, r in zip([*AMOUNTS, "cost"], ["input", "output", "cacheRead", "cacheWrite", "cost"], strict=True))])
    parts = head.unionByName(document_parts(tags, "perTag", [c for c in tags.columns if c != "seq"], rows))
    parts.unionByName(document_parts(told, "calls", [c for c in told.columns if c != "seq"], rows)).write.mode("overwrite").text(path)


def load_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """totals, by_tag and calls of a saved document, in the columns of this module."""
    names = lambda s: s.replace("cache_read", "cacheRead").replace("cache_write", "cacheWrite")
    doc = spark.read.schema(f"totals struct<{names(_SUMS)}>, perTag array<struct<{names(_GROUP)}>>, calls array<struct<{names(_CALL)}>>").json(path)
    back = lambda df: df.withColumnsRenamed({"cacheRead": "cache_read", "cacheWrite": "cache_write"})
    return {
        "totals": back(doc.where("totals is not null").select("totals.*")),
        "by_tag": back(doc.select(F.inline("perTag"))),
        "calls": back(doc.select(F.inline("calls"))),
    }
