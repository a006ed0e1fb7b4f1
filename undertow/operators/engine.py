"""One call from changed files to everything that they put at risk.

The engine holds a graph (see operators.graph; a table may have more columns than named here) and answers with tables,
each of which may be large: nothing is collected. Two plans reach the same closure: a semi-naive loop with reliable
checkpoints, and one recursive SQL statement for sparse graphs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions.text import label
from undertow.operators import impact
from undertow.plans.closure import checkpointed, upstream_of_others, upstream_of_others_sql

HOPS = 6


@dataclass
class Impact:
    changed: DataFrame  # path: the changed files that the code layer knows
    files: DataFrame  # path: those, and files of symbols that depend on theirs
    symbols: DataFrame  # name: defined in changed files
    upstream_symbols: DataFrame  # name: depend on those within six hops
    screens: DataFrame  # key, url, label: rendered by an affected file
    flows: DataFrame  # src, dst, from_label, to_label: either end at risk
    flows_inside: DataFrame  # both ends at risk
    requirements: DataFrame  # key, req_id, title, via
    losing_coverage: DataFrame  # key, req_id, title: all covering screens at risk
    uncovered: DataFrame  # req_id, title: had no screen before the change


class Engine:
    """graph: files (key, path), symbols (key, path, name), renders and calls (src, dst), screens (key, url, title,
    label), navigates_to (src, dst), rendered_by (src, dst), requirements (key, req_id, title), covered_by and
    implemented_by (src, dst, confidence), gaps (src)."""

    def __init__(self, graph: dict[str, DataFrame], plan: str = "loop"):
        self.graph, self.closure = graph, {"loop": upstream_of_others, "sql": upstream_of_others_sql}[plan]

    def impact(self, changed: DataFrame) -> Impact:
        """changed: (path), any paths; those that are no file of the code layer are left out."""
        g = self.graph
        files, symbols = g["files"].select("key", "path"), g["symbols"].select("key", "path", "name")
        changed = checkpointed(files.join(changed.select("path").distinct(), "path", "left_semi"))
        seeds = symbols.join(changed, "path", "left_semi")
        uses = g["renders"].select("src", "dst").union(g["calls"].select("src", "dst")).where("src <> dst").distinct()
        upstream = checkpointed(symbols.join(self.closure(seeds.select("key"), uses, HOPS).withColumnRenamed("node", "key"), "key", "left_semi"))
        affected = checkpointed(files.join(changed.select("path").union(upstream.select("path")).distinct(), "path", "left_semi"))

        screens = g["screens"].select("key", "url", "title", "label")
        rendered = g["rendered_by"].join(affected.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key")).distinct()
        risky = checkpointed(screens.join(rendered, "key", "left_semi").select("key", "url", label(F.col("label"), F.col("title"), F.col("url")).alias("label")))
        at_risk = risky.select(F.col("key").alias("screen"))
        names = screens.select("key", label(F.col("label"), F.col("title"), F.col("url")).alias("name"))

        def labelled(flows: DataFrame) -> DataFrame:
            a, b = (names.select(F.col("key").alias(end), F.col("name").alias(n)) for end, n in (("src", "from_label"), ("dst", "to_label")))
            return flows.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "from_label", "to_label")

        covered, implemented = g["covered_by"].select("src", "dst"), g["implemented_by"].select("src", "dst")
        titles = g["requirements"].select("key", "req_id", "title")
        by_file = implemented.join(affected.select(F.col("key").alias("dst"), "path"), "dst").groupBy("src").agg(F.min("path").alias("file"))
        by_screen = covered.join(risky.select(F.col("key").alias("dst"), "url"), "dst").groupBy("src").agg(F.min("url").alias("screen"))
        via = F.coalesce(F.concat(F.lit("file "), F.col("file")), F.concat(F.lit("screen "), F.col("screen")))
        reqs = by_file.join(by_screen, "src", "full").select(F.col("src").alias("key"), via.alias("via"))
        lost = impact.losing_coverage(covered.select(F.col("src").alias("req"), F.col("dst").alias("screen")), at_risk)
        return Impact(
            changed=changed.select("path"),
            files=affected.select("path"),
            symbols=seeds.select("name").distinct(),
            upstream_symbols=upstream.select("name").distinct(),
            screens=risky,
            flows=labelled(impact.flows_touching(g["navigates_to"], at_risk)),
            flows_inside=labelled(impact.flows_inside(g["navigates_to"], at_risk)),
            requirements=titles.join(reqs, "key"),
            losing_coverage=titles.join(lost.select(F.col("req").alias("key")), "key", "left_semi"),
            uncovered=titles.join(g["gaps"].select(F.col("src").alias("key")), "key", "left_semi").select("req_id", "title"),
        )

    def confidence(self, requirements: DataFrame) -> DataFrame:
        """One row (n, avg): the links of these requirements (key) to screens and files that have a confidence; 0 and 0
        where there are none."""
        links = self.graph["covered_by"].select("src", "confidence").unionByName(self.graph["implemented_by"].select("src", "confidence"))
        some = links.where("confidence is not null").join(requirements.select(F.col("key").alias("src")).distinct(), "src", "left_semi")
        return some.agg(F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg"))
