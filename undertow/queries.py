"""Registered queries of the change-impact engine, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undertow.functions import text as X
from undertow.functions import keys, model_output
from undertow.operators import code, evaluate, graph, impact, mappings, prompts, report, resolve, store, usage
from undertow.operators.engine import Engine, Impact
from undertow.plans.closure import bounded_upstream, checkpoint_folder, checkpointed, upstream_sql
from undertow.plans.crawl import bfs_crawl as crawl
from undertow.plans.numbering import collated, numbered
from undertow.sources import artifacts
from undertow.sources.bindings import Tables, clamp, graph_of
from undertow.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SQL = {
    "changed": "SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#2' AND p_size <= 10",
    "depends": """SELECT DISTINCT src, dst FROM (SELECT l_quantity, l_partkey AS dst, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
        l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS src FROM lineitem) WHERE l_quantity >= 49 AND src <> dst""",
    "reached": "SELECT node, 0 AS depth FROM changed UNION SELECT d.src, r.depth + 1 FROM reached r JOIN depends d ON d.dst = r.node WHERE r.depth < 6",
    "affected": "SELECT node, min(depth) AS depth FROM reached GROUP BY node",
    "rendered": "SELECT l_orderkey AS screen, max(struct_pack(p := l_extendedprice, k := l_partkey)).k AS node FROM lineitem GROUP BY l_orderkey",
    "risky": "SELECT screen FROM rendered WHERE node IN (SELECT node FROM affected)",
    "navigates": """SELECT src, dst FROM (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS src, o_orderkey AS dst FROM orders)
        WHERE src IS NOT NULL AND src <> dst""",
    "covered": "SELECT o_custkey AS req, o_orderkey AS screen, least(1.0, greatest(0.0, o_totalprice / 300000)) AS confidence FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'",
    "implemented": "SELECT DISTINCT o_custkey AS req, l_partkey AS node FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 49",
}
_HTML = r"SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages"


def _with(body: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in _SQL.items()) + " " + body


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLE_SQL[f.__name__] = sql if sql.startswith("WITH") else _with(sql)
        return f

    return add


def _affected(t: Tables) -> DataFrame:
    return bounded_upstream(t.changed(), t.depends())


def _risky(t: Tables) -> DataFrame:
    return impact.screens_at_risk(_affected(t), t.rendered_by()).select("screen")


# --- seeds, graph, closure ---------------------------------------------------------------


@query("SELECT node, p_name AS name FROM changed JOIN part ON p_partkey = node")
def changed_symbols(t: Tables) -> DataFrame:
    return t.raw("part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name")).join(t.changed(), "node", "left_semi")


@query("SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_partkey IN (SELECT node FROM changed)")
def changed_in_code(t: Tables) -> DataFrame:
    return t.raw("lineitem").where("l_shipdate >= timestamp_ntz'1998-01-01'").select(F.col("l_partkey").alias("node")).join(t.changed(), "node", "left_semi").distinct()


@query("SELECT 'depends' AS kind, src, dst FROM depends UNION ALL SELECT 'navigates', src, dst FROM navigates")
def edge_union(t: Tables) -> DataFrame:
    return t.depends().select(F.lit("depends").alias("kind"), "src", "dst").unionByName(t.navigates().select(F.lit("navigates").alias("kind"), "src", "dst"))


@query("SELECT DISTINCT src, dst FROM depends WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 5) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def edge_upsert(t: Tables) -> DataFrame:
    return impact.upsert_edges(t.depends(), t.raw("part").where("p_size > 5").select(F.col("p_partkey").alias("node")))


@query("SELECT k AS user_id, r.event_type AS event_type, r.value AS value, r.event_id AS event_id FROM (SELECT user_id AS k, max_by(struct_pack(event_type := event_type, value := value, event_id := event_id), struct_pack(ts := ts, event_id := event_id)) AS r FROM events GROUP BY user_id)")
def node_upsert(t: Tables) -> DataFrame:
    return impact.upsert_nodes(t.raw("events").select("user_id", "event_type", "value", "event_id", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1")
def namespace_reset(t: Tables) -> DataFrame:
    return t.raw("nation").where("n_regionkey <> 1").select("n_nationkey", "n_name")


@query("SELECT node, depth FROM affected")
def upstream_closure(t: Tables) -> DataFrame:
    return _affected(t)


@query("SELECT node, depth FROM affected")
def upstream_recursive_sql(t: Tables) -> DataFrame:
    return upstream_sql(t.spark, t.changed(), t.depends())


@query("SELECT 0::BIGINT AS only_loop, 0::BIGINT AS only_sql, (SELECT count(*) FROM affected) AS both_sides")
def adapter_agreement(t: Tables) -> DataFrame:
    a, b = _affected(t), upstream_sql(t.spark, t.changed(), t.depends())
    both = a.select("node", "depth", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("node", "depth", F.lit(0), F.lit(1))).groupBy("node", "depth").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return both.agg(F.count_if(F.col("x") > F.col("y")).alias("only_loop"), F.count_if(F.col("y") > F.col("x")).alias("only_sql"), F.count_if(F.col("x") == F.col("y")).alias("both_sides"))


@query("SELECT node FROM affected")
def affected_files(t: Tables) -> DataFrame:
    return t.changed().union(_affected(t).select("node")).distinct()


@query("""WITH RECURSIVE c AS (SELECT p_partkey // 4 AS file FROM part WHERE p_brand = 'Brand#2' AND p_size <= 10), d AS (SELECT DISTINCT src // 4 AS src, dst // 4 AS dst FROM ("""
       + _SQL["depends"] + """) WHERE src // 4 <> dst // 4), r AS (SELECT file, 0 AS depth FROM c UNION SELECT d.src, r.depth + 1 FROM r JOIN d ON d.dst = r.file WHERE r.depth < 6)
    SELECT file, min(depth) AS depth FROM r GROUP BY file""")  # fmt: skip
def file_closure(t: Tables) -> DataFrame:
    """Closure over files of four symbols each; edges inside a file do not count."""
    edges = t.depends().select(F.expr("src div 4").alias("src"), F.expr("dst div 4").alias("dst")).where("src <> dst").distinct()
    return bounded_upstream(t.changed().select(F.expr("node div 4").alias("node")), edges).withColumnRenamed("node", "file")


@query("""WITH RECURSIVE d AS (""" + _SQL["depends"] + """), r AS (SELECT p_partkey AS node, 0 AS depth, [-p_partkey] AS k FROM part WHERE p_brand = 'Brand#2' AND p_size <= 10
    UNION ALL SELECT d.dst, r.depth + 1, min(list_append(r.k, (d.dst * 7919) % 10007)) FROM r JOIN d ON d.src = r.node WHERE r.depth < 25 GROUP BY ALL), f AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
    SELECT node, depth, row_number() OVER (ORDER BY depth, k, node) AS place FROM (SELECT node, f.depth AS depth, min(r.k) AS k FROM f JOIN r USING (node, depth) GROUP BY ALL) QUALIFY place <= 300""")  # fmt: skip
def bfs_crawl(t: Tables) -> DataFrame:
    """The first 300 items that a queue visits from the changed ones, greatest first, along their dependencies; a page's links
    have an order of their own, which is not that of the ids."""
    links = t.depends().withColumn("ord", F.expr("dst * 7919 % 10007"))
    return crawl(t.changed().withColumn("ord", -F.col("node")), links, 300)


# --- code -------------------------------------------------------------------------------------

_PATH = "'src/m' || {k} % 7 || '/p' || {k} || CASE {k} % 3 WHEN 0 THEN '.tsx' WHEN 1 THEN '.ts' ELSE '/index.tsx' END"
_FROM_TO = f"SELECT {_PATH.format(k='src')} AS from_file, {_PATH.format(k='dst')} AS to_file, CASE WHEN dst % 2 = 0 THEN 'call' ELSE 'render' END AS kind, CASE WHEN dst % 2 = 0 THEN 'use' ELSE 'P' END || dst AS name FROM depends"


def _path(key: str):
    return F.expr(_PATH.format(k=key))


def _sources(t: Tables) -> DataFrame:
    """One source file for each part, which imports and uses the parts that it depends on."""
    way = F.concat(F.when(F.col("src") % 3 == 2, "../../m").otherwise("../m"), (F.col("dst") % 7).cast("string"), F.lit("/p"), F.col("dst").cast("string"))
    called = F.col("dst") % 2 == 0
    take = F.concat(F.lit("import "), F.when(called, F.expr("'{ use' || dst || ' }'")).otherwise(F.expr("'P' || dst")), F.lit(" from '"), way, F.lit("';"))
    # a .ts file has no tags; there the name is a type argument, which renders nothing
    use = F.when(called, F.expr("'  use' || dst || '();'")).when(F.col("src") % 3 == 1, F.expr("'  let w: Promise<P' || dst || '>;'")).otherwise(F.expr("'  show(<P' || dst || ' />);'"))
    lines = t.depends().select("src", take.alias("take"), use.alias("use")).groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("take")).alias("top"), F.array_sort(F.collect_list("use")).alias("body"))
    own = F.expr("'export ' || CASE WHEN node % 2 = 0 THEN 'const use' || node || ' = () => {' ELSE 'function P' || node || '() {' END")
    empty = F.array().cast("array<string>")
    text = F.array_join(F.concat(F.coalesce("top", empty), F.array(own), F.coalesce("body", empty), F.array(F.lit("  fetch(1);"), F.lit("}"))), "\n")
    return t.nodes().join(lines, "node", "left").select(_path("node").alias("path"), text.alias("source"))


@query(f"SELECT {_PATH.format(k='p_partkey')} AS file, CASE WHEN p_partkey % 2 = 0 THEN 'use' ELSE 'P' END || p_partkey AS name, 'function' AS kind, 1 + coalesce(n, 0) AS line, TRUE AS exported FROM part LEFT JOIN (SELECT src, count(*) AS n FROM depends GROUP BY src) ON src = p_partkey")
def code_symbols(t: Tables) -> DataFrame:
    return code.symbols(_sources(t))


@query(f"SELECT from_file, to_file, name AS imported_name FROM ({_FROM_TO})")
def import_resolution(t: Tables) -> DataFrame:
    sources = _sources(t)
    return code.import_edges(code.resolve_imports(code.imports(sources), sources))


@query(f"SELECT from_file, to_file, kind, name FROM ({_FROM_TO}) WHERE kind = 'call' OR NOT from_file LIKE '%.ts'")
def edge_resolution(t: Tables) -> DataFrame:
    return code.code_model(_sources(t))["edges"]


@query(f"""SELECT kind, from_file, holder AS from_symbol, to_file, name AS to_symbol FROM (SELECT *, CASE WHEN regexp_extract(from_file, '/p(\\d+)', 1)::BIGINT % 2 = 0 THEN 'use' ELSE 'P' END || regexp_extract(from_file, '/p(\\d+)', 1) AS holder FROM ({_FROM_TO}))
    WHERE kind = 'call' OR NOT from_file LIKE '%.ts'""")  # fmt: skip
def symbol_resolution(t: Tables) -> DataFrame:
    """Edges between symbols: the one that holds a use, and the one that is used."""
    return code.code_model(_sources(t))["symbol_edges"]


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 4 AS s FROM part), u AS (SELECT k, s, unnest([{'kind': 'call', 'name': 'go', 'at': 3, 'holder': 'inner'}, {'kind': 'call', 'name': 'deep', 'at': 3, 'holder': 'inner'}, {'kind': 'call', 'name': 'mid', 'at': 5, 'holder': 'Outer'},
    {'kind': 'render', 'name': 'Card', 'at': 6, 'holder': 'Outer'}, {'kind': 'call', 'name': 'leaf', 'at': 6, 'holder': 'Outer'}, {'kind': 'call', 'name': 'after', 'at': 8, 'holder': NULL}]) AS u FROM p)
    SELECT 'p' || k || '.tsx' AS file, u.kind AS kind, u.name || k AS name, u.at + s AS line, u.holder || k AS holder FROM u""")
def code_uses(t: Tables) -> DataFrame:
    """Uses in sources that name others in comments, strings, templates, regular expressions and JSX text, and their holders."""
    text = """// no#() @
const text# = 'no#() it\\'s', rx# = /no#()["']/g;
export function Outer#(a = {}) {
  const inner# = (x) => { go#(`no#() ${deep#(x)} it's`); };
  /* no#()
  <No#/> */ mid#();
  return <Card# t="no#()">it's no#() {leaf#(a)}</Card#>;
}
after#();"""
    start, rest = text.split("\n", 1)
    lines = F.array_join(F.array_repeat(F.replace(F.lit(start), F.lit("@"), F.col("p_name")), F.col("p_size") % 4), "\n")
    source = F.when(lines == "", rest).otherwise(F.concat(lines, F.lit("\n"), F.lit(rest)))
    key = F.col("p_partkey").cast("string")
    return code.uses(t.raw("part").select(F.concat(F.lit("p"), key, F.lit(".tsx")).alias("path"), F.replace(source, F.lit("#"), key).alias("source")))


@query(f"SELECT {_PATH.format(k='p_partkey')} AS path, CASE p_partkey % 3 WHEN 1 THEN 'typescript' ELSE 'tsx' END AS language FROM part")
def language_names(t: Tables) -> DataFrame:
    return t.nodes().select(_path("node").alias("path")).select("path", code.language(F.col("path")).alias("language"))


@query("SELECT DISTINCT path, unnest(list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS word FROM (SELECT 'app/' || c_mktsegment || '/[handle' || c_nationkey || ']/page.tsx' AS path FROM customer)")
def path_vocabulary(t: Tables) -> DataFrame:
    paths = t.raw("customer").select(F.concat(F.lit("app/"), "c_mktsegment", F.lit("/[handle"), F.col("c_nationkey").cast("string"), F.lit("]/page.tsx")).alias("path")).distinct()
    return paths.select("path", F.explode(X.vocabulary(F.col("path"))).alias("word"))


@query(f"""SELECT o_custkey AS req, {_PATH.format(k='l_partkey')} AS file, max_by(round(least(1.0, greatest(0.0, l_discount * 15 - 0.2)), 6), struct_pack(o := l_orderkey, n := l_linenumber, p := l_extendedprice, d := l_discount)) AS confidence
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_suppkey % 3 <> 0 GROUP BY 1, 2""")  # fmt: skip
def resolve_files(t: Tables) -> DataFrame:
    """Proposals from the returned lines; a third of them name a path that does not exist."""
    lines = t.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_suppkey") % 3 == 0, F.lit("src/none.ts")).otherwise(_path("l_partkey")).alias("path"), "l_discount", F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount").alias("ord"))
    asked = t.raw("orders").select("o_orderkey", F.col("o_custkey").alias("req")).join(lines, "o_orderkey")
    asked = asked.select("req", F.concat(F.lit(" "), "path", F.lit("\t")).alias("path"), (F.col("l_discount") * 15 - 0.2).alias("confidence"), "ord")
    return resolve.resolve_files(asked, t.nodes().select(_path("node").alias("path"))).withColumn("confidence", F.round("confidence", 6))


# --- risk ------------------------------------------------------------------------------------


@query("SELECT screen FROM risky")
def screens_at_risk(t: Tables) -> DataFrame:
    return _risky(t)


@query("SELECT src, dst FROM navigates")
def navigates_to(t: Tables) -> DataFrame:
    return t.navigates()


@query("SELECT src, dst FROM navigates WHERE src IN (SELECT screen FROM risky) OR dst IN (SELECT screen FROM risky)")
def flows_touching(t: Tables) -> DataFrame:
    return impact.flows_touching(t.navigates(), _risky(t))


@query("SELECT src, dst FROM navigates WHERE src IN (SELECT screen FROM risky) AND dst IN (SELECT screen FROM risky)")
def flows_both_at_risk(t: Tables) -> DataFrame:
    return impact.flows_inside(t.navigates(), _risky(t))


@query("""SELECT req, coalesce('file ' || min(node), 'screen ' || min(screen)) AS via FROM (SELECT req, node, NULL AS screen FROM implemented WHERE node IN (SELECT node FROM affected)
    UNION ALL SELECT req, NULL, screen FROM covered WHERE screen IN (SELECT screen FROM risky)) GROUP BY req""")  # fmt: skip
def reqs_at_risk(t: Tables) -> DataFrame:
    affected = _affected(t)
    return impact.requirements_at_risk(t.covered_by(), t.implemented_by(), impact.screens_at_risk(affected, t.rendered_by()), affected)


@query("SELECT req FROM covered GROUP BY req HAVING bool_and(screen IN (SELECT screen FROM risky))")
def losing_coverage(t: Tables) -> DataFrame:
    return impact.losing_coverage(t.covered_by(), _risky(t))


@query("SELECT c_custkey AS req FROM customer WHERE c_custkey NOT IN (SELECT req FROM covered)")
def coverage_gaps(t: Tables) -> DataFrame:
    return impact.coverage_gaps(t.requirements(), t.covered_by())


_LINKS = """SELECT req, CAST(confidence AS DOUBLE) AS confidence FROM covered UNION ALL SELECT req, CASE WHEN node % 4 = 0 THEN NULL ELSE 0.25 + (node % 3) / 4.0 END FROM implemented"""


def _confident(t: Tables) -> Engine:
    """An engine over the links alone; a quarter of the links to code have no confidence."""
    sure = F.when(F.col("node") % 4 != 0, 0.25 + (F.col("node") % 3) / 4.0)
    covered = t.covered_by().select(F.col("req").alias("src"), "confidence")
    return Engine({"covered_by": covered, "implemented_by": t.implemented_by().select(F.col("req").alias("src"), sure.alias("confidence"))})


@query(f"SELECT count(confidence) AS n, round(coalesce(avg(confidence), 0), 6) AS avg_confidence FROM ({_LINKS}) WHERE req % 2 = 0")
def edge_confidence(t: Tables) -> DataFrame:
    """Links of the requirements asked for (those of even customers), to screens and to code, that have a confidence."""
    asked = t.requirements().where("req % 2 = 0").select(F.col("req").alias("key"))
    return _confident(t).confidence(asked).select("n", F.round("avg", 6).alias("avg_confidence"))


@query("SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS avg_confidence FROM (SELECT count(*) FROM customer WHERE c_custkey < 0)")
def edge_confidence_of_none(t: Tables) -> DataFrame:
    """No requirement asked for."""
    asked = t.requirements().where("req < 0").select(F.col("req").alias("key"))
    return _confident(t).confidence(asked).select("n", F.col("avg").alias("avg_confidence"))


@query("SELECT CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM covered GROUP BY 1")
def confidence_band(t: Tables) -> DataFrame:
    return t.covered_by().groupBy(X.band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(least(1.0, greatest(0.0, (o_totalprice - 60000) / 200000)), 9) AS confidence FROM orders")
def confidence_clamp(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", F.round(clamp((F.col("o_totalprice") - 60000) / 200000), 9).alias("confidence"))


@query("""SELECT (SELECT count(*) FROM customer) AS requirements, (SELECT count(DISTINCT req) FROM covered) AS covered_n, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT req FROM covered)) AS gaps,
    (SELECT count(*) FROM covered) AS cover_edges, (SELECT count(DISTINCT screen) FROM covered) AS cover_screens, (SELECT count(*) FROM implemented) AS impl_edges""")  # fmt: skip
def invariants(t: Tables) -> DataFrame:
    covered = t.covered_by().groupBy("req").agg(F.count("*").alias("n"))
    per = t.requirements().join(covered, "req", "left").agg(F.count("*").alias("requirements"), F.count("n").alias("covered_n"), F.count_if(F.col("n").isNull()).alias("gaps"), F.coalesce(F.sum("n"), F.lit(0)).alias("cover_edges"))
    return per.crossJoin(t.covered_by().agg(F.count_distinct("screen").alias("cover_screens"))).crossJoin(t.implemented_by().agg(F.count("*").alias("impl_edges")))  # one row each


@query("""SELECT 'depends' AS kind, (SELECT count(*) FROM depends WHERE src NOT IN (SELECT p_partkey FROM part WHERE p_size > 1)) AS n UNION ALL
    SELECT 'covered', (SELECT count(*) FROM covered WHERE screen NOT IN (SELECT l_orderkey FROM lineitem)) UNION ALL SELECT 'rendered', (SELECT count(*) FROM rendered WHERE node NOT IN (SELECT p_partkey FROM part))""")  # fmt: skip
def dangling_edges(t: Tables) -> DataFrame:
    parts = t.raw("part")
    found = [
        ("depends", impact.dangling(t.depends(), "src", parts.where("p_size > 1"), "p_partkey")),
        ("covered", impact.dangling(t.covered_by(), "screen", t.raw("lineitem"), "l_orderkey")),
        ("rendered", impact.dangling(t.rendered_by(), "node", parts, "p_partkey")),
    ]
    out = [d.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, d in found]
    return out[0].union(out[1]).union(out[2])


@query("SELECT (SELECT count(*) FROM part) AS files, (SELECT count(*) FROM depends) AS imports, (SELECT count(*) FROM orders) AS screens, (SELECT count(*) FROM navigates) AS transitions, (SELECT count(*) FROM rendered) AS rendered_n")
def layer_stats(t: Tables) -> DataFrame:
    layers = [("files", t.nodes()), ("imports", t.depends()), ("screens", t.screens()), ("transitions", t.navigates()), ("rendered_n", t.rendered_by())]
    out = None
    for name, df in layers:
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


_GRAPH = """files AS (SELECT DISTINCT p_partkey // 4 AS f FROM part), seed_files AS (SELECT DISTINCT node // 4 AS f FROM changed), seeds AS (SELECT p_partkey AS node FROM part WHERE p_partkey // 4 IN (SELECT f FROM seed_files)),
    up AS (SELECT node, node AS seed, 0 AS depth FROM seeds UNION SELECT d.src, up.seed, up.depth + 1 FROM up JOIN depends d ON d.dst = up.node WHERE up.depth < 6),
    upstream AS (SELECT DISTINCT node FROM up WHERE node <> seed AND node IN (SELECT p_partkey FROM part)), touched AS (SELECT f FROM seed_files UNION SELECT node // 4 FROM upstream),
    at_screens AS (SELECT screen FROM rendered WHERE node // 4 IN (SELECT f FROM touched)), named AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' || o_orderkey ELSE 'https://shop.test/o/' || o_orderkey END AS name FROM orders),
    moves AS (SELECT src, dst, a.name || ' > ' || b.name AS line FROM navigates JOIN named a ON a.k = src JOIN named b ON b.k = dst),
    vias AS (SELECT req, coalesce('file ' || min(file), 'screen ' || min(url)) AS via FROM (SELECT req, 'lib/f' || (node // 4) || '.ts' AS file, NULL AS url FROM implemented WHERE node // 4 IN (SELECT f FROM touched)
      UNION ALL SELECT req, NULL, 'https://shop.test/o/' || screen FROM covered WHERE screen IN (SELECT screen FROM at_screens)) GROUP BY req)"""


@query(_with("").rstrip() + ", " + _GRAPH + """ SELECT 'changed' AS kind, 'lib/f' || f || '.ts' AS item FROM seed_files UNION ALL SELECT 'file', 'lib/f' || f || '.ts' FROM touched
    UNION ALL SELECT 'symbol', p_name || ' ' || p_partkey FROM part WHERE p_partkey IN (SELECT node FROM seeds) UNION ALL SELECT 'upstream', p_name || ' ' || p_partkey FROM part WHERE p_partkey IN (SELECT node FROM upstream)
    UNION ALL SELECT 'screen', name FROM named WHERE k IN (SELECT screen FROM at_screens) UNION ALL SELECT 'flow', line FROM moves WHERE src IN (SELECT screen FROM at_screens) OR dst IN (SELECT screen FROM at_screens)
    UNION ALL SELECT 'flow inside', line FROM moves WHERE src IN (SELECT screen FROM at_screens) AND dst IN (SELECT screen FROM at_screens) UNION ALL SELECT 'requirement', 'R' || req || ' via ' || via FROM vias
    UNION ALL SELECT 'losing', 'R' || req FROM covered GROUP BY req HAVING bool_and(screen IN (SELECT screen FROM at_screens)) UNION ALL SELECT 'uncovered', 'R' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT req FROM covered)""")  # fmt: skip
def impact_all(t: Tables) -> DataFrame:
    """Everything that the changed files put at risk, by one call."""
    return _flat(_impact(t, "loop"))


@query("SELECT 0::BIGINT AS only_loop, 0::BIGINT AS only_sql FROM (SELECT count(*) FROM part)")
def impact_agreement(t: Tables) -> DataFrame:
    """Rows of one plan's impact that the other's lacks."""
    both = _flat(_impact(t, "loop")).withColumn("side", F.lit(1)).unionByName(_flat(_impact(t, "sql")).withColumn("side", F.lit(-1)))
    apart = both.groupBy("kind", "item").agg(F.sum("side").alias("side"))
    return apart.agg(F.count_if(F.col("side") > 0).alias("only_loop"), F.count_if(F.col("side") < 0).alias("only_sql"))


def _impact(t: Tables, plan: str) -> Impact:
    files = t.changed().select(F.concat(F.lit("lib/f"), F.expr("node div 4").cast("string"), F.lit(".ts")).alias("path")).union(t.spark.range(1).select(F.lit("lib/unknown.ts")))
    return Engine(graph_of(t), plan).impact(files)


def _flat(i: Impact) -> DataFrame:
    flow = F.concat("from_label", F.lit(" > "), "to_label")
    parts = [("changed", i.changed, "path"), ("file", i.files, "path"), ("symbol", i.symbols, "name"), ("upstream", i.upstream_symbols, "name"), ("screen", i.screens, "label"), ("flow", i.flows, flow), ("flow inside", i.flows_inside, flow),
             ("requirement", i.requirements, F.concat("req_id", F.lit(" via "), "via")), ("losing", i.losing_coverage, "req_id"), ("uncovered", i.uncovered, "req_id")]
    out = None
    for kind, df, item in parts:
        one = df.select(F.lit(kind).alias("kind"), (F.col(item) if isinstance(item, str) else item).alias("item"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT (SELECT count(*) FROM customer) AS requirements, (SELECT count(DISTINCT req) FROM covered) AS covered, (SELECT count(*) FROM covered) AS cover_edges, (SELECT count(DISTINCT screen) FROM covered) AS cover_screens,
    (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT req FROM covered)) AS gaps, (SELECT count(*) FROM (SELECT DISTINCT req, node // 4 FROM implemented)) AS impl_edges, (SELECT count(DISTINCT node // 4) FROM implemented) AS impl_files,
    0::BIGINT AS dangling_cover, 0::BIGINT AS dangling_impl, 0::BIGINT AS dangling_render, TRUE AS ok""")  # fmt: skip
def graph_invariants(t: Tables) -> DataFrame:
    return evaluate.invariants(graph_of(t))


@query("""SELECT (SELECT count(DISTINCT p_partkey // 4) FROM part) AS files, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM customer) AS requirements, (SELECT count(*) FROM orders) AS screens, (SELECT count(*) FROM navigates) AS transitions,
    (SELECT count(*) FROM depends WHERE dst % 2 = 1) AS render_edges, (SELECT count(*) FROM depends WHERE dst % 2 = 0) AS call_edges, (SELECT count(*) FROM (SELECT DISTINCT src // 4, dst // 4 FROM depends WHERE src // 4 <> dst // 4)) AS import_edges,
    (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT req FROM covered)) AS uncovered, (SELECT count(DISTINCT req) FROM covered) AS covered_by_ui, (SELECT count(DISTINCT req) FROM implemented) AS implemented_in_code""")  # fmt: skip
def graph_stats(t: Tables) -> DataFrame:
    return graph.layer_stats(graph_of(t))


@query("SELECT row_number() OVER (ORDER BY 'R' || c_custkey) AS place, 'R' || c_custkey AS req_id FROM customer WHERE c_custkey NOT IN (SELECT req FROM covered)")
def uncovered_ids(t: Tables) -> DataFrame:
    """Ids of the gaps in the order of their letters, R10 before R2."""
    ids = impact.coverage_gaps(t.requirements(), t.covered_by()).select(F.concat(F.lit("R"), F.col("req").cast("string")).alias("req_id"))
    return numbered(ids, ["req_id"], "place")


_SHOP = "SELECT c_custkey, 'https://shop.test/' || c_mktsegment || '/' || CASE WHEN c_custkey % 3 = 0 THEN 'list' WHEN c_custkey % 3 = 1 THEN 'a' || c_nationkey ELSE 'fr/' || c_nationkey END AS url FROM customer"
_SHOP_FILES = "SELECT DISTINCT 'app/' || c_mktsegment || '/' || CASE c_nationkey % 4 WHEN 0 THEN '[id]' WHEN 1 THEN 'list' WHEN 2 THEN '[lang]/[id]' ELSE 'a' || c_nationkey END || '/page.tsx' AS path FROM customer"


@query(f"""WITH files AS ({_SHOP_FILES}), routes AS (SELECT *, '^https://shop.test' || regexp_replace(pattern, '\\[[^/]*', '[^/]+', 'g') || '$' AS rx, length(pattern) - length(replace(pattern, '[', '')) AS d FROM (SELECT path, '/' || regexp_extract(path, '^app/(.+)/page\\.(tsx|ts|js|jsx)$', 1) AS pattern FROM files)),
    shop AS ({_SHOP}), met AS (SELECT url, min(struct_pack(d := d, l := -length(pattern), p := pattern, path := path)).path AS path FROM (SELECT DISTINCT url FROM shop) JOIN routes ON regexp_matches(url, rx) GROUP BY url),
    first AS (SELECT url, min(c_custkey) AS k FROM shop GROUP BY url), moves AS (SELECT o_custkey AS a, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_orderkey % 100 END AS b FROM orders)
    SELECT 'rendered' AS kind, 'acme/shop::screen::s' || c_custkey AS src, 'acme/shop:' || path AS dst FROM shop JOIN met USING (url)
    UNION ALL SELECT DISTINCT 'moves', 'acme/shop::screen::s' || x.k, 'acme/shop::screen::s' || y.k FROM moves JOIN shop p ON p.c_custkey = a JOIN shop q ON q.c_custkey = b JOIN first x ON x.url = p.url JOIN first y ON y.url = q.url WHERE x.k <> y.k""")  # fmt: skip
def screen_edges(t: Tables) -> DataFrame:
    """Which file renders each screen, by its route, and navigation between screens, by the urls of both ends."""
    tail = F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'list' WHEN c_custkey % 3 = 1 THEN concat('a', c_nationkey) ELSE concat('fr/', c_nationkey) END")
    shop = t.raw("customer").select("c_custkey", F.concat(F.lit("https://shop.test/"), "c_mktsegment", F.lit("/"), tail).alias("url"))
    blank = F.lit("")
    screens = shop.select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("screenId"), "url", blank.alias("title"), blank.alias("label"), blank.alias("purpose"), F.col("c_custkey").alias("seq"))
    ends = t.raw("orders").select(F.col("o_custkey").alias("a"), F.expr("if(o_orderkey % 10 = 0, -1, o_orderkey % 100)").alias("b"))
    moves = ends.join(shop.select(F.col("c_custkey").alias("a"), F.col("url").alias("fromUrl")), "a").join(shop.select(F.col("c_custkey").alias("b"), F.col("url").alias("toUrl")), "b", "left")
    moves = moves.select("fromUrl", F.coalesce("toUrl", F.lit("https://shop.test/none")).alias("toUrl"))
    got = graph.screen_layer({"screens": screens, "transitions": moves}, "acme/shop", _files(t))
    return got["rendered_by"].select(F.lit("rendered").alias("kind"), "src", "dst").unionByName(got["navigates_to"].select(F.lit("moves").alias("kind"), "src", "dst"))


@query("""WITH last AS (SELECT o_custkey AS k, max(o_orderkey) AS o FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), known AS (SELECT k, o FROM last), part_ids AS (SELECT p_partkey FROM part),
    cover AS (SELECT k FROM known WHERE o % 3 <> 1 AND k IN (SELECT p_partkey FROM part_ids))
    SELECT 'covered' AS kind, 'R' || k AS req, 's' || k AS target, 1.0::DOUBLE AS confidence FROM cover UNION ALL SELECT 'implemented', 'R' || k, 'lib/' || k || '.ts', 0.5 FROM known WHERE k % 2 = 0 AND k IN (SELECT p_partkey FROM part_ids)
    UNION ALL SELECT 'gap', 'R' || c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT k FROM cover)""")  # fmt: skip
def mappings_resolved(t: Tables) -> DataFrame:
    """Links proposed by the orders, the last of a customer counting, resolved against the parts as screens and files."""
    key = F.col("p_partkey").cast("string")
    screens = t.raw("part").select(F.concat(F.lit("s"), key).alias("screen_id"), F.col("p_partkey").alias("seq"), F.concat(F.lit("https://x.test/"), key).alias("url"), F.lit("").alias("title"), F.col("p_name").alias("label"))
    files = t.raw("part").where("p_partkey % 2 = 0").select(F.concat(F.lit("lib/"), key, F.lit(".ts")).alias("path"))
    names = F.expr("CASE o_orderkey % 3 WHEN 0 THEN ' https://x.test/' || o_custkey WHEN 1 THEN 'Totally unknown thing' ELSE 'Part (https://x.test/' || o_custkey || ') ' END")
    asked = F.array(F.struct(names.alias("name"), F.lit(1.7).alias("confidence")))
    paths = F.array(F.struct(F.expr("'lib/' || o_custkey || '.ts '").alias("path"), F.lit(None).cast("double").alias("confidence")))
    req = F.concat(F.lit("R"), F.col("o_custkey").cast("string"))
    proposals = t.raw("orders").select(req.alias("req_id"), F.col("o_orderkey").alias("ord"), asked.alias("screens"), paths.alias("files"))
    got = mappings.resolve_mappings(t.raw("customer").select(F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("req_id")), screens, proposals, files)
    none = F.lit(None).cast("string")
    rows = [("covered", got["covered_by"], F.col("screen_id"), F.col("confidence")), ("implemented", got["implemented_by"], F.col("path"), F.col("confidence")), ("gap", got["gaps"], none, none.cast("double"))]
    out = None
    for kind, df, target, confidence in rows:
        one = df.select(F.lit(kind).alias("kind"), F.col("req_id").alias("req"), target.alias("target"), confidence.alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'file' AS kind, 'acme/store:' || p_name AS key FROM part UNION ALL SELECT 'symbol', 'acme/store:' || p_name || '::' || p_partkey FROM part UNION ALL SELECT 'screen', 'acme/store::screen::' || left(sha1(url), 12) FROM pages
    UNION ALL SELECT 'req', 'acme/store::req::R' || c_custkey FROM customer UNION ALL SELECT 'gap', 'acme/store::req::R' || c_custkey || '::gap' FROM customer""")  # fmt: skip
def node_keys(t: Tables) -> DataFrame:
    ns, part, req = F.lit("acme/store"), t.raw("part"), t.raw("customer").select(F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("r"))
    rows = [("file", part, keys.file_key(ns, F.col("p_name"))), ("symbol", part, keys.symbol_key(ns, F.col("p_name"), F.col("p_partkey").cast("string"))), ("screen", t.raw("pages"), keys.screen_key(ns, X.screen_id(F.col("url")))),
            ("req", req, keys.requirement_key(ns, F.col("r"))), ("gap", req, keys.gap_key(ns, F.col("r")))]
    out = None
    for kind, df, key in rows:
        one = df.select(F.lit(kind).alias("kind"), key.alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


# --- urls, links, routes -----------------------------------------------------------------------

_NORM = r"""regexp_replace(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)), '^(http://.*):80$', '\1') ||
    CASE WHEN length(p) > 1 AND p LIKE '%/' THEN left(p, length(p) - 1) ELSE p END"""
_REST = r"SELECT page_id, url, CASE WHEN r = '' OR r LIKE '?%' THEN '/' || r ELSE r END AS p FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+', '') AS r FROM pages)"


@query(f"SELECT page_id, {_NORM} AS normal FROM ({_REST})")
def url_normalize(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", X.normalize_url(F.col("url")).alias("normal"))


@query(f"SELECT page_id, left(sha1({_NORM}), 12) AS screen FROM ({_REST})")
def screen_id(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", X.screen_id(X.normalize_url(F.col("url"))).alias("screen"))


@query("SELECT 'acme/store::screen::' || left(sha1(url), 12) AS key, page_id FROM pages")
def screen_keys(t: Tables) -> DataFrame:
    return t.raw("pages").select(F.concat(F.lit("acme/store::screen::"), X.screen_id(F.col("url"))).alias("key"), "page_id")


def _links(t: Tables) -> DataFrame:
    hrefs = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    return t.raw("pages").select("page_id", "url", hrefs.alias("href"))


@query(f"SELECT DISTINCT page_id, href FROM ({_HTML})")
def page_links(t: Tables) -> DataFrame:
    return _links(t).select("page_id", "href").distinct()


# Every other page also links to itself in capitals with the default port, and to another origin.
_LINKED = f"""SELECT page_id, url, href FROM ({_HTML}) UNION ALL SELECT page_id, url, 'HTTP://' || upper(regexp_extract(url, '://([^/?#]+)', 1)) || CASE WHEN url LIKE 'http:%' THEN ':80' ELSE '' END || '/self' FROM pages WHERE page_id % 2 = 0
    UNION ALL SELECT page_id, url, 'http://other.test/' FROM pages WHERE page_id % 2 = 0"""
_SAME = f"""SELECT DISTINCT page_id, CASE WHEN href LIKE '/%' THEN lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)) || href ELSE href END AS target FROM ({_LINKED})
    WHERE href LIKE '/%' OR regexp_replace(lower(regexp_extract(href, '^([A-Za-z]+://[^/?#]+)', 1)), '^(http://.*):80$', '\\1') = lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1))"""


def _targets(t: Tables) -> DataFrame:
    host = F.upper(F.regexp_extract("url", "://([^/?#]+)", 1))
    own = F.concat(F.lit("HTTP://"), host, F.when(F.col("url").startswith("http:"), ":80").otherwise(""), F.lit("/self"))
    more = t.raw("pages").where("page_id % 2 = 0").select("page_id", "url", F.explode(F.array(own, F.lit("http://other.test/"))).alias("href"))
    rows = _links(t).unionByName(more)
    full = F.when(F.col("href").startswith("/"), F.concat(X.origin(F.col("url")), "href")).otherwise(F.col("href"))
    return rows.where(X.origin(F.col("url")) == X.origin_of(F.col("url"), F.col("href"))).select("page_id", full.alias("target")).distinct()


@query(_SAME)
def same_origin_links(t: Tables) -> DataFrame:
    return _targets(t)


@query(f"SELECT DISTINCT target FROM ({_SAME}) WHERE target NOT IN (SELECT url FROM pages)")
def frontier(t: Tables) -> DataFrame:
    return _targets(t).select("target").distinct().join(t.raw("pages").select(F.col("url").alias("target")), "target", "left_anti")


@query(f"SELECT target FROM (SELECT DISTINCT target FROM ({_SAME}) WHERE target NOT IN (SELECT url FROM pages)) ORDER BY target LIMIT 20")
def frontier_top20(t: Tables) -> DataFrame:
    return frontier(t).orderBy("target").limit(20)


_FILES = "SELECT 'app/' || c_mktsegment || '/' || CASE c_nationkey % 4 WHEN 0 THEN '[id]' WHEN 1 THEN 'list' WHEN 2 THEN '[lang]/[id]' ELSE 'a' || c_nationkey END || '/page.tsx' AS path FROM customer GROUP BY 1"
_ROUTES = "SELECT path, '/' || regexp_extract(path, '^app/(.+)/page\\.(tsx|ts|js|jsx)$', 1) AS pattern FROM files"


def _files(t: Tables) -> DataFrame:
    tail = F.expr("CASE c_nationkey % 4 WHEN 0 THEN '[id]' WHEN 1 THEN 'list' WHEN 2 THEN '[lang]/[id]' ELSE concat('a', c_nationkey) END")
    return t.raw("customer").select(F.concat(F.lit("app/"), "c_mktsegment", F.lit("/"), tail, F.lit("/page.tsx")).alias("path")).distinct()


@query(f"WITH files AS ({_FILES}) SELECT path, pattern, length(pattern) - length(replace(pattern, '[', '')) AS n_dyn, length(pattern) AS len FROM ({_ROUTES})")
def route_table(t: Tables) -> DataFrame:
    return resolve.route_table(_files(t)).drop("segments")


@query(f"""WITH files AS ({_FILES}), routes AS (SELECT *, '^' || regexp_replace(pattern, '\\[[^/]*', '[^/]+', 'g') || '$' AS rx, length(pattern) - length(replace(pattern, '[', '')) AS d FROM ({_ROUTES})),
    asked AS (SELECT DISTINCT '/' || c_mktsegment || '/' || CASE WHEN c_custkey % 3 = 0 THEN 'list' WHEN c_custkey % 3 = 1 THEN 'a' || c_nationkey ELSE 'fr/' || c_nationkey END AS url_path FROM customer)
    SELECT url_path, min(struct_pack(d := d, l := -length(pattern), p := pattern, path := path)).path AS path FROM asked LEFT JOIN routes ON regexp_matches(url_path, rx) GROUP BY url_path""")  # fmt: skip
def route_resolve(t: Tables) -> DataFrame:
    ask = F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'list' WHEN c_custkey % 3 = 1 THEN concat('a', c_nationkey) ELSE concat('fr/', c_nationkey) END")
    asked = t.raw("customer").select(F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), ask).alias("url_path"))
    return resolve.resolve_routes(asked, resolve.route_table(_files(t)))


@query("""WITH a AS (SELECT DISTINCT 'The ' || p_name AS ask FROM part), b AS (SELECT DISTINCT p_name AS name FROM part),
    s AS (SELECT ask, name, len(list_intersect(wa, wb)) / greatest(len(wa), len(wb)) AS score FROM (SELECT ask, list_distinct(list_filter(string_split_regex(lower(ask), '[^a-z0-9]+'), lambda w: length(w) > 2)) AS wa FROM a),
      (SELECT name, list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: length(w) > 2)) AS wb FROM b))
    SELECT ask, name, round(score, 6) AS score FROM s WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY ask ORDER BY score DESC, name) = 1""")  # fmt: skip
def resolve_fuzzy(t: Tables) -> DataFrame:
    names = t.raw("part").select(F.col("p_name").alias("name")).distinct()
    return resolve.resolve_fuzzy(names.select(F.concat(F.lit("The "), "name").alias("ask")), names).withColumn("score", F.round("score", 6))


_KEYS = "SELECT DISTINCT unnest([regexp_replace(url, '[?#].*$', ''), regexp_extract(url, '^[a-z]+://[^/?#]+')]) AS name FROM pages"


@query(f"SELECT page_id, k.name FROM (SELECT page_id, 'from http://x.test see ' || url || ', then http' AS ask FROM pages) JOIN ({_KEYS}) k ON contains(ask, k.name) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(k.name) DESC, k.name) = 1")
def resolve_url_in_text(t: Tables) -> DataFrame:
    urls = t.raw("pages").select(F.explode(F.array(F.regexp_replace("url", r"[?#].*$", ""), F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0))).alias("name"))
    asked = t.raw("pages").select("page_id", F.concat(F.lit("from http://x.test see "), "url", F.lit(", then http")).alias("ask"))
    return asked.join(resolve.resolve_url_in_text(asked, urls), "ask").select("page_id", "name")


_ASK = "CASE p_partkey % 6 WHEN 0 THEN '  ' || p_name || ' ' WHEN 1 THEN 'Shown as (' || p_name || ')' WHEN 2 THEN p_name || ' (unknown)' WHEN 3 THEN 'visit ' || url || ' now' WHEN 4 THEN 'The ' || p_name ELSE 'nothing like it' END"


@query(f"""WITH known AS (SELECT p_name AS name, 'part' || max(p_partkey) AS id, min(p_partkey) AS pos FROM part GROUP BY 1 UNION ALL SELECT url, 'page' || page_id, 1000000000000 + page_id FROM pages),
    asked AS (SELECT p_partkey, {_ASK} AS ask FROM (SELECT coalesce(p_partkey, page_id) AS p_partkey, coalesce(p_name, 'page only') AS p_name, coalesce(url, 'no url') AS url
      FROM part FULL JOIN pages ON page_id = p_partkey)), a AS (SELECT *, trim(ask) AS x, trim(regexp_extract(ask, '\\(([^)]+)\\)\\s*$', 1)) AS paren, trim(regexp_replace(ask, '\\([^(]*$', '')) AS bare FROM asked),
    tok AS (SELECT name, id, pos, list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: length(w) > 2)) AS w FROM known WHERE name NOT LIKE 'http%'),
    ax AS (SELECT DISTINCT x, list_distinct(list_filter(string_split_regex(lower(x), '[^a-z0-9]+'), lambda w: length(w) > 2)) AS w FROM a),
    fuzzy AS (SELECT x, id FROM (SELECT x, id, pos, len(list_intersect(ax.w, tok.w)) / greatest(len(ax.w), len(tok.w)) AS score FROM ax, tok) WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY x ORDER BY score DESC, pos) = 1),
    urls AS (SELECT x, id FROM (SELECT DISTINCT x FROM a) JOIN known ON name LIKE 'http%' AND contains(x, name) QUALIFY row_number() OVER (PARTITION BY x ORDER BY length(name) DESC, name) = 1)
    SELECT p_partkey, CASE WHEN k1.id IS NOT NULL THEN 'exact' WHEN k2.id IS NOT NULL THEN 'paren' WHEN k3.id IS NOT NULL THEN 'bare' WHEN urls.id IS NOT NULL THEN 'url' WHEN fuzzy.id IS NOT NULL THEN 'fuzzy' END AS step,
      coalesce(k1.id, k2.id, k3.id, urls.id, fuzzy.id) AS id FROM a LEFT JOIN known k1 ON k1.name = x LEFT JOIN known k2 ON k2.name = paren LEFT JOIN known k3 ON k3.name = bare LEFT JOIN urls USING (x) LEFT JOIN fuzzy USING (x)""")  # fmt: skip
def resolve_cascade(t: Tables) -> DataFrame:
    part, pages = t.raw("part"), t.raw("pages")
    names = part.select(F.col("p_name").alias("name"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("ord"))
    names = names.union(pages.select("url", F.concat(F.lit("page"), F.col("page_id").cast("string")), F.col("page_id") + 1000000000000))
    both = part.join(pages, F.col("p_partkey") == F.col("page_id"), "full")  # every part asks, and every page's url is asked for
    asked = both.select(F.coalesce("p_partkey", "page_id").alias("p_partkey"), F.coalesce("p_name", F.lit("page only")).alias("p_name"), F.coalesce("url", F.lit("no url")).alias("url"))
    asked = asked.select("p_partkey", F.expr(_ASK).alias("ask"))
    return asked.join(resolve.resolve_cascade(asked, names), "ask").select("p_partkey", "step", "id")


# --- capture, transcripts, usage ------------------------------------------------------------------


@query("SELECT user_id, src, dst, event_id FROM (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst, event_id FROM events) WHERE src IS NOT NULL AND src <> dst")
def nav_transitions(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.raw("events").select("user_id", F.lag("event_type").over(w).alias("src"), F.col("event_type").alias("dst"), "event_id").where("src is not null and src <> dst")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 6")
def action_budget(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.raw("events").withColumn("r", F.row_number().over(w)).where("r <= 6").select("event_id")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 25")
def crawl_budget(t: Tables) -> DataFrame:
    return t.raw("events").orderBy("ts", "event_id").limit(25).select("event_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visited FROM events")
def visited_running(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.raw("events").select("event_id", F.count("*").over(w).alias("visited"))


@query("""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND left_over >= 2 AND length(text) > 300 AND NOT text LIKE '%… [compacted]' THEN regexp_replace(left(text, 300), '\\s+$', '') || '… [compacted]' ELSE text END AS text
    FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS left_over FROM conversations)""")  # fmt: skip
def compact_transcript(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id")
    rows = t.raw("conversations").withColumn("left_over", F.count("*").over(w) - F.row_number().over(w.orderBy("turn", "role", "text")))
    return rows.select("conv_id", "turn", "role", F.when(F.expr("role = 'assistant' and left_over >= 2"), X.compact(F.col("text"))).otherwise(F.col("text")).alias("text"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def element_dedupe(t: Tables) -> DataFrame:
    return t.raw("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")).select("event_id")


@query("SELECT 'R' || row_number() OVER (ORDER BY first) AS req_id, title FROM (SELECT left(lower(p_name), 60) AS title, min(p_partkey) AS first FROM part GROUP BY 1)")
def requirement_ids(t: Tables) -> DataFrame:
    firsts = t.raw("part").groupBy(F.left(F.lower("p_name"), F.lit(60)).alias("title")).agg(F.min("p_partkey").alias("first"))
    return numbered(firsts, ["first"]).select(F.concat(F.lit("R"), F.col("number").cast("string")).alias("req_id"), "title")


@query("SELECT CASE WHEN grouping(role) = 1 THEN 'total' ELSE role END AS tag, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS input, round(coalesce(100.0 * sum(CASE WHEN turn > 0 THEN length(text) ELSE 0 END) / nullif(sum(length(text)), 0), 0), 1) AS cached_percent FROM (SELECT CASE WHEN role = 'system' THEN NULL ELSE role END AS role, turn, text FROM conversations) GROUP BY ROLLUP (role)")
def usage_rollup(t: Tables) -> DataFrame:
    """By role, and in total; the system's rows count as without a role, which is a group of its own."""
    role = F.when(F.col("role") != "system", F.col("role"))
    rows = t.raw("conversations").select(role.alias("role"), F.length("text").alias("n"), F.when(F.col("turn") > 0, F.length("text")).otherwise(0).alias("c"))
    share = F.round(F.coalesce(100.0 * F.sum("c") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)), 1)
    return rows.rollup("role").agg(F.count("*").alias("calls"), F.sum("n").alias("input"), share.alias("cached_percent"), F.grouping("role").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("role")).alias("tag"), "calls", "input", "cached_percent")


@query("""SELECT tag, grouping(tag) = 1 AS is_total, count(*) AS calls, CAST(sum(n) AS BIGINT) AS input, CAST(sum(turn) AS BIGINT) AS output, CAST(sum(CASE WHEN turn > 0 THEN n ELSE 0 END) AS BIGINT) AS cache_read,
    CAST(sum(CASE WHEN turn = 0 THEN n ELSE 0 END) AS BIGINT) AS cache_write, CAST(sum(CAST(n * 0.000123 AS DECIMAL(28, 9))) AS DOUBLE) AS cost, round(coalesce(100.0 * sum(CASE WHEN turn > 0 THEN n ELSE 0 END) / nullif(sum(n), 0), 0), 1) AS cached_percent
    FROM (SELECT CASE WHEN role <> 'system' THEN role END AS tag, turn, length(text) AS n FROM conversations) GROUP BY ROLLUP (tag)""")  # fmt: skip
def usage_cost(t: Tables) -> DataFrame:
    """What the turns of all conversations took and cost, by role and in total; the first turn of each fills the cache."""
    n = F.length("text")
    rows = t.raw("conversations").select(F.when(F.col("role") != "system", F.col("role")).alias("tag"), F.lit("m").alias("model"), n.alias("input"), F.col("turn").alias("output"), F.when(F.col("turn") > 0, n).alias("cache_read"), F.when(F.col("turn") == 0, n).alias("cache_write"), (n * 0.000123).alias("cost"))
    return usage.summary(rows).withColumn("cost", F.col("cost").cast("double"))


# --- texts --------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(string_split(text, chr(10))) AS loc FROM documents")
def loc(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("loc"))


@query("SELECT event_id, regexp_extract(props, '(?s)\\{.*\\}') AS doc FROM (SELECT event_id, 'Here: ' || props || ' done' AS props FROM events)")
def extract_json(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", X.extract_json(F.concat(F.lit("Here: "), "props", F.lit(" done"))).alias("doc"))


@query("""WITH s AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body, source, lang FROM documents)
    SELECT doc_id, 0 AS ord, 'Document' AS heading, body FROM s WHERE doc_id % 2 = 1
    UNION ALL SELECT doc_id, 0, source, body FROM s WHERE doc_id % 2 = 0 AND body <> ''
    UNION ALL SELECT doc_id, CASE WHEN body = '' THEN 0 ELSE 1 END, 'Language', lang FROM s WHERE doc_id % 2 = 0""")  # fmt: skip
def split_sections(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("dropped\n# "), "source", F.lit("\n"), "text", F.lit("\n## Language\n"), "lang", F.lit("\n###### Empty\n"))
    texts = t.raw("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, marked).otherwise(F.col("text")).alias("text"))
    return texts.select("doc_id", F.posexplode(X.sections(F.col("text"))).alias("ord", "s")).select("doc_id", "ord", "s.heading", "s.body")


@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 3)) AS w FROM documents)
    SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS score FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")  # fmt: skip
def jaccard_docs(t: Tables) -> DataFrame:
    """Word sets of each document and of the one with the next id."""
    docs = t.raw("documents").select("doc_id", X.words(F.col("text"), 3).alias("w"))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return docs.join(following, "doc_id").select("doc_id", F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("score"))


@query("SELECT w AS word, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3))) AS w FROM documents) WHERE w NOT IN (SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3)) FROM benchmark) GROUP BY w")
def vocab_guard(t: Tables) -> DataFrame:
    known = t.raw("benchmark").select(F.explode(X.words(F.col("text"), 3)).alias("word")).distinct()
    found = t.raw("documents").select(F.explode(X.words(F.col("text"), 3)).alias("word"))
    per = found.groupBy("word").agg(F.count("*").alias("docs"))
    return per.join(known, "word", "left_anti")


@query("""WITH c AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS w FROM conversations)
    SELECT a.turn AS i, b.turn AS k, round(avg(CASE WHEN len(list_concat(a.w, b.w)) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END), 6) AS score FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1, 2""")  # fmt: skip
def pairwise_jaccard(t: Tables) -> DataFrame:
    c = t.raw("conversations").select("conv_id", "turn", X.words(F.col("text"), 3).alias("w"))
    pairs = c.select("conv_id", F.col("turn").alias("i"), F.col("w").alias("a")).join(c.select("conv_id", F.col("turn").alias("k"), F.col("w").alias("b")), "conv_id").where("i < k")
    return pairs.groupBy("i", "k").agg(F.round(F.avg(X.jaccard(F.col("a"), F.col("b"))), 6).alias("score"))


@query("SELECT c_mktsegment AS section, coalesce(nullif(string_agg('- ' || n, chr(10) ORDER BY n), ''), '_none_') AS body FROM (SELECT DISTINCT c_mktsegment, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1")
def report_sections(t: Tables) -> DataFrame:
    rows = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("section"), F.concat(F.lit("- "), "n_name").alias("line")).distinct()
    return rows.groupBy("section").agg(F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("")), F.lit("_none_")).alias("body"))


_BAND = "CASE WHEN a >= 0.75 THEN 'high' WHEN a >= 0.5 THEN 'medium' ELSE 'low' END"
_REPORT = {
    "Screens at risk": "SELECT 'order ' || screen AS line FROM risky",
    "User flows affected": "SELECT src || ' → ' || dst AS line FROM navigates WHERE src IN (SELECT screen FROM risky) AND dst IN (SELECT screen FROM risky)",
    "Requirements at risk": "SELECT '**' || req || '** — via ' || via AS line FROM at_risk",
    "Requirements losing coverage": "SELECT '**' || req || '**' AS line FROM covered GROUP BY req HAVING bool_and(screen IN (SELECT screen FROM risky))",
    "Pre-existing gaps": "SELECT '**' || c_custkey || '**' AS line FROM customer WHERE c_custkey NOT IN (SELECT req FROM covered)",
    "What changed in code": "SELECT 'part ' || node AS line FROM changed",
}
_AT_RISK = """at_risk AS (SELECT req, coalesce('file ' || min(node), 'screen ' || min(screen)) AS via FROM (SELECT req, node, NULL AS screen FROM implemented WHERE node IN (SELECT node FROM affected)
    UNION ALL SELECT req, NULL, screen FROM covered WHERE screen IN (SELECT screen FROM risky)) GROUP BY req)"""


@query(_with("").rstrip() + ", " + _AT_RISK + " " + " UNION ALL ".join(f"SELECT {report.TITLES.index(k)} AS section, '- ' || line AS line FROM ({v}) UNION ALL SELECT {report.TITLES.index(k)}, '_none_' WHERE NOT EXISTS ({v})" for k, v in _REPORT.items())
       + f" UNION ALL SELECT {report.TITLES.index('Confidence')}, 'average ' || CAST(round(a * 100) AS BIGINT) || '% across ' || n || ' cross-layer links (' || {_BAND} || ' band)' FROM (SELECT avg(confidence) AS a, count(*) AS n FROM covered)")
def impact_report(t: Tables) -> DataFrame:
    affected = checkpointed(_affected(t))
    screens = checkpointed(impact.screens_at_risk(affected, t.rendered_by()))
    risky, covered = screens.select("screen"), t.covered_by()
    bold = F.concat(F.lit("**"), F.col("req").cast("string"), F.lit("**"))
    parts = [
        report.bullets(risky, "Screens at risk", F.concat(F.lit("order "), F.col("screen").cast("string"))),
        report.bullets(impact.flows_inside(t.navigates(), risky), "User flows affected", F.concat(F.col("src").cast("string"), F.lit(" → "), F.col("dst").cast("string"))),
        report.bullets(impact.requirements_at_risk(covered, t.implemented_by(), screens, affected), "Requirements at risk", F.concat(bold, F.lit(" — via "), "via")),
        report.bullets(impact.losing_coverage(covered, risky), "Requirements losing coverage", bold),
        report.bullets(impact.coverage_gaps(t.requirements(), covered), "Pre-existing gaps", bold),
        report.bullets(t.changed(), "What changed in code", F.concat(F.lit("part "), F.col("node").cast("string"))),
        report.confidence_line(covered.agg(F.count("*").alias("n"), F.avg("confidence").alias("avg"))).select(F.lit(report.TITLES.index("Confidence")).alias("section"), "line"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- narratives, snapshots, a model's answers -------------------------------------------------------


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 3)) AS w FROM conversations WHERE role = 'assistant'),
    p AS (SELECT a.conv_id, count(*) AS pairs, avg(CASE WHEN len(list_concat(a.w, b.w)) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END) AS m FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1)
    SELECT conv_id, coalesce(pairs, 0) AS pairs, CAST(round(coalesce(m, 1) * 100) AS BIGINT) AS percent FROM (SELECT DISTINCT conv_id FROM w) LEFT JOIN p USING (conv_id)""")  # fmt: skip
def narrative_stability(t: Tables) -> DataFrame:
    """How much the assistant's turns of one conversation, as runs of one narrative, agree; 100 where there is one only."""
    runs = t.raw("conversations").where("role = 'assistant'").select("conv_id", F.col("turn").alias("run"), "text")
    return evaluate.stability(runs, ["conv_id"])


@query("""SELECT doc_id, ord, 'Heading: ' || heading || chr(10) || chr(10) || left(body, 6000) AS prompt FROM (""" + ORACLE_SQL["split_sections"] + ")")
def prompt_sections(t: Tables) -> DataFrame:
    """A prompt for each section of each document."""
    return split_sections(t).select("doc_id", "ord", prompts.section(F.col("heading"), F.col("body")).alias("prompt"))


@query("""SELECT o_orderstatus, o_orderpriority, left(string_agg(line, '; ' ORDER BY o_orderdate, line), 3000) AS text
    FROM (SELECT *, 'O' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_orderpriority ELSE '' END AS line FROM orders) GROUP BY 1, 2""")
def prompt_lists(t: Tables) -> DataFrame:
    """Orders of each status and priority as one list for a prompt, the first 3000 characters by date."""
    line = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise(""))
    return prompts.joined(t.raw("orders").withColumn("line", line), ["o_orderstatus", "o_orderpriority"], ["o_orderdate"], "; ", most_chars=prompts.LIST)


@query("""WITH r AS (SELECT 'R' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS req_id, c_name, c_mktsegment AS act, CASE WHEN c_custkey % 4 > 0 THEN 'seen' ELSE '' END AS seen FROM customer),
    n AS (SELECT '- ' || req_id || ': ' || c_name || ' | user: ' || act || ' -> ' || seen AS line, row_number() OVER (ORDER BY req_id) AS n FROM r),
    s AS (SELECT coalesce(left(string_agg('- ' || url || ' (' || url || ')', chr(10) ORDER BY url), 60000), 'none') AS s FROM pages WHERE url <> ''),
    f AS (SELECT string_agg(p, chr(10) ORDER BY p) AS f FROM (SELECT DISTINCT p_name AS p FROM part ORDER BY 1 LIMIT 300))
    SELECT CAST((n - 1) // 200 AS BIGINT) AS batch, 'Requirements:' || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10) || chr(10) || 'Screens:' || chr(10) || any_value(s) || chr(10) || chr(10) || 'Files:' || chr(10) || any_value(f) AS prompt
    FROM n, s, f GROUP BY 1""")  # fmt: skip
def prompt_mappings(t: Tables) -> DataFrame:
    """What a model is asked for links of customers to pages and parts, 200 customers a prompt."""
    outcome = F.when(F.col("c_custkey") % 4 > 0, "seen")
    asked = t.raw("customer").select(F.concat(F.lit("R"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("req_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("user_action"), outcome.alias("expected_outcome"))
    none = F.lit(None).cast("string")
    return prompts.mappings(asked, t.raw("pages").select("url", none.alias("title"), none.alias("label")), t.raw("part").select(F.col("p_name").alias("path")))


_SHOWN = "array_to_string(list_transform(range(1, len(h) + 1), lambda i: 'link [ref=e' || i || CASE WHEN i % 3 = 0 THEN ']' ELSE ', url=' || h[i] || ']' END), ' ')"


@query(f"""WITH known AS (SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS w FROM benchmark UNION SELECT unnest({evaluate.COMMON!r})),
    words AS (SELECT doc_id, unnest(l) AS word, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS l FROM documents)),
    c AS (SELECT *, lower(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')) AS bare FROM words WHERE NOT regexp_matches(word, '^[a-z]') AND word <> upper(word)),
    f AS (SELECT doc_id, bare, min(pos) AS pos, arg_min(word, pos) AS word FROM c WHERE length(bare) >= 5 AND bare NOT IN (SELECT w FROM known) GROUP BY 1, 2)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, word, count(*) OVER (PARTITION BY doc_id) AS mentions FROM f QUALIFY place <= 15""")  # fmt: skip
def guard_words(t: Tables) -> DataFrame:
    """Words of each document that may be names and that neither the benchmark nor the common words know."""
    told = t.raw("benchmark").select(F.explode(X.words(F.col("text"), 3)).alias("word"))
    known = evaluate.vocabulary([told, t.spark.createDataFrame([(w,) for w in evaluate.COMMON], "word string")])
    return evaluate.suspicious(t.raw("documents").select("doc_id", "text"), ["doc_id"], known)


@query(f"""WITH p AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages), s AS (SELECT page_id, {_SHOWN} AS text FROM p),
    m AS (SELECT page_id, regexp_extract_all(text, '\\[ref=(\\w+)(?:, url=([^\\],\\s]+))?\\]', 1) AS r, regexp_extract_all(text, '\\[ref=(\\w+)(?:, url=([^\\],\\s]+))?\\]', 2) AS u FROM s)
    SELECT page_id, unnest(r) AS ref, nullif(unnest(u), '') AS url FROM m""")  # fmt: skip
def snapshot_refs(t: Tables) -> DataFrame:
    """Marks of elements in a snapshot's text; a third of them have no url."""
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    one = lambda h, i: F.concat(F.lit("link [ref=e"), (i + 1).cast("string"), F.when((i + 1) % 3 == 0, "]").otherwise(F.concat(F.lit(", url="), h, F.lit("]"))))
    shown = t.raw("pages").select("page_id", F.array_join(F.transform(hrefs, one), " ").alias("text"))
    return shown.select("page_id", F.explode(X.snapshot_refs(F.col("text"))).alias("m")).select("page_id", "m.ref", "m.url")


@query("""SELECT user_id AS url, event_type AS role, 'v' || CAST(floor(value) AS BIGINT) AS name, 'e' || coalesce(min(event_id) FILTER (event_id % 2 = 0), min(event_id)) AS ref FROM events GROUP BY 1, 2, 3""")
def snapshot_merge(t: Tables) -> DataFrame:
    """Elements of each user's page after a second snapshot (odd events): the first one's stay, unseen ones join them."""
    rows = t.raw("events").select(F.col("user_id").alias("url"), F.col("event_type").alias("role"), F.concat(F.lit("v"), F.floor("value").cast("string")).alias("name"), "event_id")
    shown = rows.withColumn("ref", F.concat(F.lit("e"), F.col("event_id").cast("string")))
    first = rows.where("event_id % 2 = 0").groupBy("url", "role", "name").agg(F.min("event_id").alias("id")).withColumn("ref", F.concat(F.lit("e"), F.col("id").cast("string")))
    return artifacts.elements_again(first, shown.where("event_id % 2 = 1"))


@query(r"""WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS o, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text FROM pages),
    n AS (SELECT *, row_number() OVER () AS pos FROM l), f AS (SELECT page_id, CASE WHEN href LIKE '/%' THEN o || href ELSE href END AS href, text, pos FROM n)
    SELECT page_id, href, left(trim(regexp_replace(arg_min(text, pos), '\s+', ' ', 'g')), 120) AS text FROM f WHERE href LIKE 'http%' GROUP BY 1, 2""")  # fmt: skip
def page_link_texts(t: Tables) -> DataFrame:
    return artifacts.links(t.raw("pages"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'https://x.test/' || c_custkey END AS label FROM customer")
def screen_labels(t: Tables) -> DataFrame:
    given, title = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(""), F.when(F.col("c_custkey") % 3 != 2, F.col("c_mktsegment"))
    return t.raw("customer").select("c_custkey", X.label(given, title, F.concat(F.lit("https://x.test/"), F.col("c_custkey").cast("string"))).alias("label"))


@query("SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'press ' || p_name ELSE '' END AS user_action, CASE WHEN p_partkey % 3 = 0 THEN 'high' ELSE 'medium' END AS priority FROM part WHERE p_partkey % 5 <> 0")
def answered_requirements(t: Tables) -> DataFrame:
    """Requirements from a model's answers; a fifth of them have no title."""
    one = F.struct(F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise("").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("press "), "p_name")).alias("user_action"), F.when(F.col("p_partkey") % 3 == 0, "high").alias("priority"))
    answers = t.raw("part").select("p_partkey", F.concat(F.lit("Here: "), F.to_json(F.struct(F.array(one).alias("requirements"))), F.lit(" done.")).alias("answer"))
    return model_output.requirements(answers).select("p_partkey", "title", "user_action", "priority")


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE left(repeat(p_name, 20), 80) END AS label, least(8, p_size)::INT AS actions FROM part")
def answered_labels(t: Tables) -> DataFrame:
    """Labels of screens from a model's answers, cut to 80 characters and 8 actions; the title stands in for a seventh."""
    answer = F.to_json(F.struct(F.when(F.col("p_partkey") % 7 != 0, F.repeat("p_name", F.lit(20))).alias("label"), F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: i.cast("string")).alias("primary_actions")))
    got = model_output.labels(t.raw("part").select("p_partkey", F.col("p_name").alias("title"), answer.alias("answer")))
    return got.select("p_partkey", "label", F.size("primary_actions").alias("actions"))


@query("SELECT p_partkey, p_name AS path FROM part WHERE p_partkey % 4 <> 3")
def changed_paths(t: Tables) -> DataFrame:
    """Paths that the lines of a report name as changed."""
    line = F.expr("CASE p_partkey % 4 WHEN 0 THEN '- ' || p_name || ' (modified, +1/-2)' WHEN 1 THEN '- ' || p_name || ' (added, +1/-0)' WHEN 2 THEN '- ' || p_name || ' (renamed' ELSE '- ' || p_name || ' (seen)' END")
    return t.raw("part").select("p_partkey", X.changed_path(line).alias("path")).where("path is not null")


# --- streams ----------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS day, event_type AS tag, count(*) AS calls, round(sum(value), 4) AS input FROM events GROUP BY 1, 2")
def stream_usage(t: Tables) -> DataFrame:
    got = live.run_to_table(live.usage(live.read(t.spark, t.folder, "events"), "ts", "event_type", "value"), "update", ["day", "tag"])
    return got.select("day", "tag", "calls", F.round("input", 4).alias("input"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(t: Tables) -> DataFrame:
    rows = live.read(t.spark, t.folder, "events").select("user_id", "event_type")
    return live.run_to_table(rows.dropDuplicates(["user_id", "event_type"]), "append", None)


@query("SELECT user_id, least(count(*), 6) AS admitted, count(*) AS asked FROM events GROUP BY user_id")
def stream_action_budget(t: Tables) -> DataFrame:
    rows = live.read(t.spark, t.folder, "events").select("user_id")
    return live.run_to_table(live.budgeted(rows, "user_id", 6), "update", ["user_id"])


# --- stored graphs ------------------------------------------------------------------------------

_FILE = "'lib/f' || {k} // 4 || '.ts'"


@query(f"""WITH {", ".join(f"{k} AS ({v})" for k, v in _SQL.items() if k in ("changed", "depends"))}, again AS (SELECT DISTINCT {_FILE.format(k='node')} AS path FROM changed),
    s AS (SELECT p_partkey, {_FILE.format(k='p_partkey')} AS path, {_FILE.format(k='p_partkey')} IN (SELECT path FROM again) AS seen FROM part), symbols AS (SELECT * FROM s WHERE NOT seen OR p_partkey % 5 <> 0),
    e AS (SELECT src, dst, seen FROM depends JOIN s ON p_partkey = src WHERE NOT seen OR dst % 3 <> 0)
    SELECT 'symbols' AS part, p_partkey::VARCHAR AS src, path AS dst FROM symbols UNION ALL SELECT CASE WHEN dst % 2 = 1 THEN 'renders' ELSE 'calls' END, src::VARCHAR, dst::VARCHAR FROM e WHERE src IN (SELECT p_partkey FROM symbols) AND dst IN (SELECT p_partkey FROM symbols)
    UNION ALL SELECT 'imports', a, b FROM (SELECT DISTINCT {_FILE.format(k='src')} AS a, {_FILE.format(k='dst')} AS b FROM depends) WHERE a <> b AND (a NOT IN (SELECT path FROM again) OR length(b) % 2 = 0)""")
def graph_merge(t: Tables) -> DataFrame:
    """A stored graph after the files of the changed items were read again: a fifth of their symbols and some of their edges
    are gone. The merge is saved to the folder that it was read from."""
    folder = f"{checkpoint_folder(t.spark)}/graph-{uuid.uuid4().hex}"
    old = graph_of(t)
    first = store.save(old, folder, "shop")
    stored = store.load(t.spark, folder, "shop")
    again = t.changed().select(F.concat(F.lit("lib/f"), F.expr("node div 4").cast("string"), F.lit(".ts")).alias("path")).distinct()
    ours = lambda name: stored[name].join(again, "path", "left_semi")
    run = {"files": ours("files"), "symbols": ours("symbols").where("CAST(key AS BIGINT) % 5 <> 0"), "imports": stored["imports"].where("length(dst) % 2 = 0").join(again.withColumnRenamed("path", "src"), "src", "left_semi")}
    held = ours("symbols").select(F.col("key").alias("src"))
    run |= {name: stored[name].where("CAST(dst AS BIGINT) % 3 <> 0").join(held, "src", "left_semi") for name in ("renders", "calls")}
    store.save(store.merge(stored, run), folder, "shop", based_on=first)
    now = store.load(t.spark, folder, "shop")
    out = now["symbols"].select(F.lit("symbols").alias("part"), F.col("key").alias("src"), F.col("path").alias("dst"))
    for name in ("renders", "calls", "imports"):
        out = out.unionByName(now[name].select(F.lit(name).alias("part"), "src", "dst"))
    return out


@query("""WITH e AS (SELECT user_id, event_id, 'p' || CAST(floor(value) AS BIGINT) % 40 AS url, CASE event_type WHEN 'view' THEN 'visit' WHEN 'click' THEN 'visit' WHEN 'error' THEN 'act' ELSE 'link' END AS kind FROM events),
    v AS (SELECT user_id, url, min(event_id) AS pos FROM e WHERE kind = 'visit' GROUP BY 1, 2), l AS (SELECT user_id, url, min(event_id) AS pos FROM e WHERE kind = 'link' GROUP BY 1, 2),
    f AS (SELECT user_id, string_agg(url, ' ' ORDER BY pos) AS frontier FROM l WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.user_id = l.user_id AND v.url = l.url) GROUP BY 1),
    a AS (SELECT user_id, sum(least(n, 2)) AS admitted, sum(greatest(n - 2, 0)) AS refused FROM (SELECT user_id, url, count(*) AS n FROM e WHERE kind = 'act' GROUP BY 1, 2) GROUP BY 1)
    SELECT user_id, (SELECT string_agg(url, ' ' ORDER BY pos) FROM v WHERE v.user_id = u.user_id) AS visited, frontier, CAST(coalesce(admitted, 0) AS BIGINT) AS admitted, CAST(coalesce(refused, 0) AS BIGINT) AS refused FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN f USING (user_id) LEFT JOIN a USING (user_id)""")
def crawl_sessions(t: Tables) -> DataFrame:
    """Visited pages, waiting links and actions of each user, kept as one keyed state over a stream of events."""
    kind = F.when(F.col("event_type").isin("view", "click"), "visit").when(F.col("event_type") == "error", "act").otherwise("link")
    rows = live.read(t.spark, t.folder, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("p"), (F.floor("value") % 40).cast("string")).alias("url"))
    got = live.run_to_table(live.sessions(rows, "user_id", actions=2), "update", ["user_id"])
    pages = lambda c: F.nullif(F.array_join(c, " "), F.lit("")).alias(c)
    return got.select("user_id", pages("visited"), pages("frontier"), "admitted", "refused")


@query("""SELECT user_id AS url, event_type AS role, 'v' || CAST(floor(value) AS BIGINT) AS name, 'e' || min(event_id) AS ref FROM events GROUP BY 1, 2, 3""")
def element_stream(t: Tables) -> DataFrame:
    """Each role and name of a page once, as a stream of snapshots shows them."""
    rows = live.read(t.spark, t.folder, "events").select(F.col("user_id").alias("url"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("ref"), F.col("event_type").alias("role"), F.concat(F.lit("v"), F.floor("value").cast("string")).alias("name"))
    return live.run_to_table(live.elements(rows), "append", None)


@query("""SELECT label, c_custkey, row_number() OVER (ORDER BY lower(label), translate(label, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')) AS place
    FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) ELSE left(c_mktsegment, 1) || lower(substring(c_mktsegment, 2)) END || c_custkey // 3 AS label FROM customer)""")
def collated_labels(t: Tables) -> DataFrame:
    """Labels in collated order: equal letters side by side, small before capital."""
    segment = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.lower("c_mktsegment")).otherwise(F.initcap("c_mktsegment"))
    return collated(t.raw("customer").select(F.concat(segment, F.expr("c_custkey div 3").cast("string")).alias("label"), "c_custkey"), "label")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'http://shop.test' WHEN 1 THEN 'https://shop.test' WHEN 2 THEN 'https://shop.test:8443' END AS origin,
    CASE c_custkey % 4 WHEN 0 THEN '/' || c_mktsegment || '/x%20' || c_custkey || '[1]/' WHEN 1 THEN '/caf%C3%A9/' || c_custkey WHEN 2 THEN '/' END AS path,
    CASE c_custkey % 4 WHEN 0 THEN 'http://me@shop.test/' || c_mktsegment || '/x%20' || c_custkey || '[1]' WHEN 1 THEN 'https://shop.test/caf%C3%A9/' || c_custkey || '?q=a%20b' WHEN 2 THEN 'https://shop.test:8443/' END AS normal FROM customer""")
def url_standard(t: Tables) -> DataFrame:
    """Urls with dot segments, spaces, users, backslashes and ports, and malformed ones."""
    forms = ["'HTTP://me@Shop.Test:80/a/../' || c_mktsegment || '/./x ' || c_custkey || '[1]/#top'", "'https:\\\\\\\\SHOP.test\\\\café/' || c_custkey || '?q=a b#x'", "' https://shop.test:8443/' || c_custkey || '/%2E%2e '", "'https://shop.test:' || (70000 + c_custkey) || '/'"]
    url = F.expr(f"CASE c_custkey % 4 WHEN 0 THEN {forms[0]} WHEN 1 THEN {forms[1]} WHEN 2 THEN {forms[2]} ELSE {forms[3]} END")
    rows = t.raw("customer").select("c_custkey", url.alias("url")).select("c_custkey", X.url_parts(F.col("url")).alias("u"), X.normalize_url(F.col("url")).alias("normal"))
    return rows.select("c_custkey", "u.origin", "u.path", "normal")


@query("""WITH c AS (SELECT c_custkey AS req FROM customer), cov AS (SELECT DISTINCT o_custkey AS req FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'), n AS (SELECT count(*) AS reqs, count(cov.req) AS covered, count(*) - count(cov.req) AS gaps FROM c LEFT JOIN cov USING (req)),
    w AS (SELECT DISTINCT c_mktsegment AS field, c_custkey % 3 AS run, 'nation' || c_nationkey AS w FROM customer), s AS (SELECT field, run, count(*) AS n FROM w GROUP BY 1, 2),
    b AS (SELECT x.field AS field, x.run AS i, y.run AS k, count(*) AS n FROM w x JOIN w y ON x.field = y.field AND x.w = y.w AND x.run < y.run GROUP BY 1, 2, 3),
    j AS (SELECT x.field AS field, avg(coalesce(b.n, 0) / (x.n + y.n - coalesce(b.n, 0))) AS j FROM s x JOIN s y ON x.field = y.field AND x.run < y.run LEFT JOIN b ON b.field = x.field AND b.i = x.run AND b.k = y.run GROUP BY 1)
    SELECT 0 AS place, 'requirements' AS check, reqs::VARCHAR AS value, CASE WHEN reqs > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM n UNION ALL SELECT 1, 'covered', covered::VARCHAR, NULL FROM n UNION ALL SELECT 2, 'gaps', gaps::VARCHAR, NULL FROM n
    UNION ALL SELECT 3, 'covered + gaps = requirements', (covered + gaps) || ' = ' || reqs, 'PASS' FROM n UNION ALL SELECT 4, 'dangling edges', '0/0/0', 'PASS' UNION ALL SELECT 5, 'stability: ' || field, CAST(round(100 * j) AS BIGINT) || '%', NULL FROM j
    UNION ALL SELECT 6, 'suspicious mentions', count(*) || ': ' || (SELECT string_agg(w, ', ' ORDER BY w) FROM (SELECT DISTINCT w FROM w ORDER BY w LIMIT 15)), NULL FROM (SELECT DISTINCT w FROM w) UNION ALL SELECT 7, 'verdict', NULL, 'PASS'""")
def evaluation(t: Tables) -> DataFrame:
    """One evaluation of the graph and of three runs' narratives about each segment."""
    told = t.raw("customer").groupBy(F.col("c_mktsegment").alias("field"), (F.col("c_custkey") % 3).alias("run")).agg(F.array_join(F.collect_set(F.concat(F.lit("Nation"), F.col("c_nationkey").cast("string"))), " ").alias("text"))
    graph = graph_of(t)
    return evaluate.evaluation(graph, told, evaluate.vocabulary([graph["symbols"].select(F.lower("name").alias("word"))]))
