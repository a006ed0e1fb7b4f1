"""Bounded reverse reachability over a dependency edge table (src depends on dst)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; only a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; lineage ends there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(edges: DataFrame) -> DataFrame:
    """The edges as (node, src), node being the one depended on; checkpointed unless they are so already."""
    if edges.columns == ["node", "src"]:
        return edges
    return checkpointed(edges.select(F.col("dst").alias("node"), "src"))


def upstream_of_others(seeds: DataFrame, edges: DataFrame, max_depth: int = 6) -> DataFrame:
    """(node): nodes that depend within max_depth hops on a seed other than themselves; a seed may depend on another.

    Each node keeps its two nearest different seeds at most (by level, then the least and the greatest new one), which
    is enough: whatever reaches a node through another one, that one passes on two seeds no farther away.
    """
    edges = written(edges)
    seen = checkpointed(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct().select("node", F.col("node").alias("seed")))
    frontier = seen
    for _ in range(max_depth):
        step = frontier.join(edges, "node").select(F.col("src").alias("node"), "seed").distinct().join(seen, ["node", "seed"], "left_anti")
        new = step.groupBy("node").agg(F.min("seed").alias("a"), F.max("seed").alias("b"))
        held = seen.groupBy("node").agg(F.count("*").alias("held"))
        new = new.join(held, "node", "left").where("coalesce(held, 0) < 2")
        pick = F.when(F.col("held").isNull() & (F.col("a") != F.col("b")), F.array("a", "b")).otherwise(F.array("a"))
        frontier = checkpointed(new.select("node", F.explode(pick).alias("seed")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("node <> seed").select("node").distinct()


def bounded_upstream(seeds: DataFrame, edges: DataFrame, max_depth: int = 6, enough: int | None = None) -> DataFrame:
    """(node, depth): nodes that depend on a seed within max_depth hops, seeds at depth 0.

    Semi-naive: each level joins only the newest nodes with the edges, and drops those seen before. Lineage is cut
    at each level; the loop ends at the first empty level, so cycles and self-loops end too. With `enough`, it also ends
    after the level that reaches so many nodes. The edges are written down once, by their ends alone, dealt by dst.
    """
    edges = written(edges)
    seen = checkpointed(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        if enough is not None and seen.count() >= enough:
            break
        step = frontier.join(edges, "node").select(F.col("src").alias("node")).distinct()
        frontier = checkpointed(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def upstream_sql(spark: SparkSession, seeds: DataFrame, edges: DataFrame, max_depth: int = 6) -> DataFrame:
    """The same set as one recursive SQL plan. Each level keeps a node once (DISTINCT), however many paths lead to it, but
    again on each level that reaches it, so there are at most max_depth + 1 rows a node. LIMIT ALL lifts Spark's limit on
    the rows of a recursion (spark.sql.cteRecursionRowLimit). The edges are written down once for all levels.
    """
    edges = written(edges)
    return spark.sql(
        """WITH RECURSIVE r(node, depth) AS (
             SELECT node, 0 FROM {seeds} UNION ALL SELECT DISTINCT e.src, r.depth + 1 FROM r JOIN {edges} e ON e.node = r.node WHERE r.depth < {depth})
           SELECT node, min(depth) AS depth FROM (SELECT * FROM r LIMIT ALL) GROUP BY node""",
        seeds=seeds, edges=edges, depth=max_depth,
    )


def upstream_of_others_sql(seeds: DataFrame, edges: DataFrame, max_depth: int = 6) -> DataFrame:
    """The set of upstream_of_others as one recursive SQL plan (see upstream_sql). Each level keeps each pair of a node and
    a seed that reaches it, so it is for sparse graphs; the loop keeps two seeds a node.
    """
    spark = seeds.sparkSession
    first = seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct()
    return spark.sql(
        """WITH RECURSIVE r(node, seed, depth) AS (
             SELECT node, node, 0 FROM {seeds} UNION ALL SELECT DISTINCT e.src, r.seed, r.depth + 1 FROM r JOIN {edges} e ON e.node = r.node WHERE r.depth < {depth})
           SELECT DISTINCT node FROM (SELECT * FROM r LIMIT ALL) WHERE node <> seed""",
        seeds=first, edges=written(edges), depth=max_depth,
    )
