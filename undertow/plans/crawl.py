"""Breadth-first order of discovery, as a queue gives it, level by level and without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.plans.closure import checkpointed
from undertow.plans.numbering import numbered


def bfs_crawl(start: DataFrame, links: DataFrame, budget: int) -> DataFrame:
    """(node, depth, place): the first `budget` nodes that a queue visits from the start along links (src to dst).

    The start is in the order of its column `ord`, and the links of a node in that of theirs; without one, and where they are
    equal, by node. A node waits from its first discovery on: at the place of the earliest visited page that links to
    it, and there at its first link. So a level's order is that of (place of the parent, position of the link). What lies
    beyond the budget discovers nothing, so no level has more than `budget` rows; nulls are no nodes.
    """
    at = lambda df, node: F.col("ord") if "ord" in df.columns else F.col(node)
    edges = checkpointed(links.select("src", "dst", at(links, "dst").alias("ord")).where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("ord").alias("ord")))
    first = start.select("node", at(start, "node").alias("ord")).where("node is not null").groupBy("node").agg(F.min(F.struct("ord")).alias("rank"))
    seen, count, depth = None, 0, 0
    while True:
        level = numbered(first.select("rank", "node"), ["rank", "node"], "place").where(F.col("place") <= budget - count)
        level = checkpointed(level.select("node", F.lit(depth).alias("depth"), (F.col("place") + count).alias("place")))
        new = level.count()
        seen, count, depth = level if seen is None else seen.unionByName(level), count + new, depth + 1
        if not new or count >= budget:
            return seen
        found = level.join(edges, level["node"] == edges["src"]).select(F.col("dst").alias("node"), F.struct("place", "ord").alias("rank"))
        first = found.groupBy("node").agg(F.min("rank").alias("rank")).join(seen.select("node"), "node", "left_anti")
