"""Contiguous, balanced shards from global byte-size prefix sums.

Rows are dealt into ranges of the id order once and written down, so that every later step sees the same ranges.
Each range's totals are summed, the few totals get running sums, and a row's global offset is its range's offset
plus a running sum inside the range. A row goes to the shard in which the middle of its bytes falls, so each cut
lies within half a row of its equal target.

A null text has no bytes; null ids sort first; repeated rows and ties on the id are ordered by checksum and size,
and rows equal in all three are interchangeable. No shard is promised to be non-empty when rows are fewer than
shards. A size above 2**62 / shards bytes in total is outside the arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.shared import materialise


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Returns each row's id, size, text_crc32, shard, slot (place in its shard) and start (its global offset)."""
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.coalesce(F.length(text), F.lit(0)) + overhead).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("crc"))
    order = ["id", "crc", "size"]
    rows = materialise(rows)  # texts are read once; what follows sees three numbers a row
    rows = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_before"), F.sum("bytes").over(whole).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    before = rows.withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("place", F.row_number().over(inside) - 1)
    placed = before.join(starts, "part").select("id", "size", "crc", (F.col("bytes_before") + F.col("run")).alias("start"), (F.col("rows_before") + F.col("place")).alias("place"), "total")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * start + size) * {int(shards)} div (2 * total)")).cast("int"))
    placed = materialise(placed)
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    out = placed.join(firsts, "shard")  # one row for each shard
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first_place")).cast("long").alias("slot"), "start")
