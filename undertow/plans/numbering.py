"""Row numbers over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.plans.closure import checkpointed


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Numbers rows 1, 2, ... by the given columns, which must tell rows apart. Rows are dealt into ranges once and
    written down; a row's number is the count of the ranges before plus its place in its own range."""
    rows = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
    place = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return place.join(before, "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_before", "_place")


def collated(df: DataFrame, column: str, name: str = "place") -> DataFrame:
    """Numbers rows 1, 2, ... in the order of people's alphabets (a, A, b, B) and not of bytes; nulls first. Texts that
    collate as equal go by their bytes."""
    rows = df.withColumn("_key", F.collate(F.col(column), "UNICODE"))
    return numbered(rows, ["_key", column], name).drop("_key")
