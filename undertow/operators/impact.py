"""Impact of a change: what depends on it, which screens, flows and requirements are at risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def screens_at_risk(affected: DataFrame, rendered_by: DataFrame) -> DataFrame:
    return rendered_by.join(affected.select("node"), "node", "left_semi")


def flows_touching(flows: DataFrame, risky: DataFrame) -> DataFrame:
    """Flows with either end at risk, as one join of the exploded ends instead of a disjunction."""
    ends = flows.select("src", "dst", F.explode(F.array("src", "dst")).alias("screen"))
    return ends.join(risky.select("screen"), "screen", "left_semi").select("src", "dst").distinct()


def flows_inside(flows: DataFrame, risky: DataFrame) -> DataFrame:
    a, b = risky.select(F.col("screen").alias("src")), risky.select(F.col("screen").alias("dst"))
    return flows.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def requirements_at_risk(covered_by: DataFrame, implemented_by: DataFrame, risky: DataFrame, affected: DataFrame) -> DataFrame:
    """(req, via): one row a requirement; a file is named before a screen, the least of either."""
    files = implemented_by.join(affected.select("node"), "node", "left_semi").groupBy("req").agg(F.min("node").alias("file"))
    shown = covered_by.join(risky.select("screen"), "screen", "left_semi").groupBy("req").agg(F.min("screen").alias("screen"))
    via = F.coalesce(F.concat(F.lit("file "), F.col("file").cast("string")), F.concat(F.lit("screen "), F.col("screen").cast("string")))
    return files.join(shown, "req", "full").select("req", via.alias("via"))


def losing_coverage(covered_by: DataFrame, risky: DataFrame) -> DataFrame:
    """Requirements all of whose covering screens are at risk."""
    flags = covered_by.join(risky.select("screen").distinct().withColumn("hit", F.lit(True)), "screen", "left")
    return flags.groupBy("req").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("lost")).where("lost").select("req")


def coverage_gaps(requirements: DataFrame, covered_by: DataFrame) -> DataFrame:
    return requirements.join(covered_by, "req", "left_anti")


def upsert_nodes(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the given order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}") for c in rest])


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist, once each."""
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst").distinct()


def dangling(edges: DataFrame, column: str, nodes: DataFrame, key: str) -> DataFrame:
    return edges.join(nodes.select(F.col(key).alias(column)), column, "left_anti")
