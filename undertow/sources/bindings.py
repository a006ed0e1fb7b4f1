"""Tables of the logical model, bound to the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Typed node and edge tables over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def nodes(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("node"))

    def changed(self) -> DataFrame:
        return self.raw("part").where("p_brand = 'Brand#2' and p_size <= 10").select(F.col("p_partkey").alias("node"))

    def depends(self) -> DataFrame:
        """src depends on dst: neighbouring lines of an order."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
        lines = self.raw("lineitem").select("l_quantity", F.col("l_partkey").alias("dst"), F.lead("l_partkey").over(order).alias("src"))
        return lines.where("l_quantity >= 49 and src <> dst").select("src", "dst").distinct()

    def screens(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("screen"))

    def rendered_by(self) -> DataFrame:
        top = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("screen")).agg(F.max(F.struct("l_extendedprice", "l_partkey")).alias("m"))
        return top.select("screen", F.col("m.l_partkey").alias("node"))

    def navigates(self) -> DataFrame:
        order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        steps = self.raw("orders").select(F.lag("o_orderkey").over(order).alias("src"), F.col("o_orderkey").alias("dst"))
        return steps.where("src is not null and src <> dst")

    def requirements(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("req"))

    def covered_by(self) -> DataFrame:
        links = self.raw("orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
        return links.select(F.col("o_custkey").alias("req"), F.col("o_orderkey").alias("screen"), clamp(F.col("o_totalprice") / 300000).alias("confidence"))

    def implemented_by(self) -> DataFrame:
        lines = self.raw("lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("node"))
        return self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("req")).join(lines, "o_orderkey").select("req", "node").distinct()


def clamp(x):
    """A confidence between 0 and 1, 0.5 where none is given."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x.cast("double"), F.lit(0.5))))


def graph_of(t: Tables) -> dict[str, DataFrame]:
    """The star schema as one graph: parts are symbols, four to a file; orders are screens, customers requirements."""
    text = lambda c: F.col(c).cast("string")
    file = lambda c: F.concat(F.lit("lib/f"), F.expr(f"{c} div 4").cast("string"), F.lit(".ts"))
    parts = t.raw("part").select(text("p_partkey").alias("key"), file("p_partkey").alias("path"), F.concat("p_name", F.lit(" "), text("p_partkey")).alias("name"))
    orders = t.raw("orders").select(text("o_orderkey").alias("key"), F.concat(F.lit("https://shop.test/o/"), text("o_orderkey")).alias("url"), F.lit("").alias("title"), F.expr("if(o_orderkey % 2 = 0, 'Order ' || o_orderkey, '')").alias("label"))
    edges = lambda df, a, b: df.select(text(a).alias("src"), b.alias("dst"))
    covered, gaps = t.covered_by(), t.requirements().join(t.covered_by(), "req", "left_anti")
    depends = t.depends()
    implemented = t.implemented_by().select(text("req").alias("src"), file("node").alias("dst")).distinct().withColumn("confidence", F.lit(0.5))
    return {
        "files": parts.select(F.col("path").alias("key"), "path").distinct(), "symbols": parts,
        "imports": depends.select(file("src").alias("src"), file("dst").alias("dst")).where("src <> dst").distinct(),
        "renders": edges(depends.where("dst % 2 = 1"), "src", text("dst")), "calls": edges(depends.where("dst % 2 = 0"), "src", text("dst")),
        "screens": orders, "navigates_to": edges(t.navigates(), "src", text("dst")), "rendered_by": edges(t.rendered_by(), "screen", file("node")),
        "requirements": t.raw("customer").select(text("c_custkey").alias("key"), F.concat(F.lit("R"), text("c_custkey")).alias("req_id"), F.col("c_name").alias("title")),
        "covered_by": covered.select(text("req").alias("src"), text("screen").alias("dst"), "confidence"), "implemented_by": implemented,
        "gaps": gaps.select(text("req").alias("src")),
    }
