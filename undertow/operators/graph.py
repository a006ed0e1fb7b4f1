"""The graph of a run: its documents as node and edge tables with keys in one namespace.

Nodes: files, symbols, requirements, screens, gaps. Edges: imports, renders, calls, navigates_to, rendered_by,
covered_by, implemented_by. An edge exists only where both of its ends do, once; a node's last row wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.functions import keys
from undertow.functions.text import path as url_path
from undertow.operators import impact, mappings, resolve
from undertow.operators.store import TABLES, load, reset, save  # noqa: F401  where graphs are kept

Graph = dict[str, DataFrame]


def _ends(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) whose ends are keys of a and of b."""
    return edges.join(a.select(F.col("key").alias("src")), "src", "left_semi").join(b.select(F.col("key").alias("dst")), "dst", "left_semi")


def code_layer(run: Graph, namespace: str) -> Graph:
    """Files, symbols, imports, renders and calls. A use's from end is the symbol that holds it (fromSymbol or
    fromComponent); ends that no file defines go."""
    ns = F.lit(namespace)
    files = run["files"].select(keys.file_key(ns, F.col("path")).alias("key"), "path", "language", "loc").dropDuplicates(["key"])
    symbols = run["symbols"].select(keys.symbol_key(ns, F.col("filePath"), F.col("name")).alias("key"), keys.file_key(ns, F.col("filePath")).alias("file"), F.col("filePath").alias("path"), "name", "kind", "line", "exported")
    symbols = impact.upsert_nodes(symbols.join(files.select(F.col("key").alias("file")), "file", "left_semi"), "key", ["line", "kind"])
    imports = run["imports"].select(keys.file_key(ns, F.col("fromFile")).alias("src"), keys.file_key(ns, F.col("toFile")).alias("dst"), F.col("importedName").alias("name"))

    def uses(name: str, part: str) -> DataFrame:
        a, b = (keys.symbol_key(ns, F.col(f"{end}File"), F.col(f"{end}{part}")) for end in ("from", "to"))
        return _ends(run[name].select(a.alias("src"), b.alias("dst")), symbols, symbols).distinct()

    return {"files": files, "symbols": symbols, "imports": _ends(imports, files, files).distinct(), "renders": uses("renders", "Component"), "calls": uses("calls", "Symbol")}


def screen_layer(run: Graph, namespace: str, files: DataFrame) -> Graph:
    """Screens with their route, navigation between different known screens by url, and the file that renders each
    screen whose path a route fits."""
    ns = F.lit(namespace)
    routes = resolve.route_table(files)
    shown = run["screens"].where("screenId is not null").select("screenId", "url", "title", "label", "purpose", "seq", url_path(F.col("url")).alias("url_path"))
    fit = resolve.resolve_routes(shown, routes).join(routes.select("path", F.col("pattern").alias("route")), "path", "left")
    rows = shown.join(fit, "url_path", "left").select(keys.screen_key(ns, F.col("screenId")).alias("key"), F.col("screenId").alias("screen_id"), "url", "title", "label", "purpose", "route", "path", "seq")
    screens = impact.upsert_nodes(rows, "key", ["seq"])
    first = screens.groupBy("url").agg(F.min_by("key", "seq").alias("key"))
    moves = run["transitions"].select("fromUrl", "toUrl").distinct()
    for end, name in (("fromUrl", "src"), ("toUrl", "dst")):
        moves = moves.join(first.select(F.col("url").alias(end), F.col("key").alias(name)), end)
    rendered = screens.where("route is not null").select(F.col("key").alias("src"), keys.file_key(ns, F.col("path")).alias("dst"))
    return {"screens": screens.drop("path"), "navigates_to": moves.where("src <> dst").select("src", "dst").distinct(), "rendered_by": rendered}


def requirement_layer(run: Graph, namespace: str) -> DataFrame:
    rows = run["requirements"].where("reqId <> ''").select(
        keys.requirement_key(F.lit(namespace), F.col("reqId")).alias("key"), F.col("reqId").alias("req_id"), "title", F.col("userAction").alias("user_action"),
        F.col("expectedOutcome").alias("expected_outcome"), "priority", F.col("sourceAnchor").alias("source_anchor"), "seq",
    )
    return impact.upsert_nodes(rows, "key", ["seq"])


def connect(graph: Graph, proposals: DataFrame, namespace: str) -> Graph:
    """covered_by, implemented_by and gaps from proposals (see mappings)."""
    ns = F.lit(namespace)
    got = mappings.resolve_mappings(graph["requirements"], graph["screens"], proposals, graph["files"])
    req = keys.requirement_key(ns, F.col("req_id")).alias("src")
    covered = got["covered_by"].select(req, keys.screen_key(ns, F.col("screen_id")).alias("dst"), "confidence")
    implemented = got["implemented_by"].select(req, keys.file_key(ns, F.col("path")).alias("dst"), "confidence")
    gaps = got["gaps"].select(keys.gap_key(ns, F.col("req_id")).alias("key"), req, F.lit(mappings.GAP).alias("reason"))
    return {"covered_by": covered, "implemented_by": implemented, "gaps": gaps}


def build(run: Graph, namespace: str, proposals: DataFrame | None = None) -> Graph:
    """The whole graph of a run's tables (see sources.artifacts.load_run). Without proposals every requirement is a gap.
    Nothing runs yet: save the graph and load it again before many questions are put to it."""
    out = code_layer(run, namespace)
    out |= screen_layer(run, namespace, out["files"])
    out["requirements"] = requirement_layer(run, namespace)
    if proposals is None:
        proposals = out["files"].sparkSession.createDataFrame([], "req_id string, ord int, screens array<struct<name:string,confidence:double>>, files array<struct<path:string,confidence:double>>")
    return out | connect(out, proposals, namespace)


def layer_stats(graph: Graph) -> DataFrame:
    """One row: the sizes of all layers, and how many requirements are covered, implemented and gaps."""
    counts = {"files": "files", "symbols": "symbols", "requirements": "requirements", "screens": "screens", "transitions": "navigates_to", "render_edges": "renders", "call_edges": "calls", "import_edges": "imports", "uncovered": "gaps"}
    parts = [(name, graph[table], F.count("*")) for name, table in counts.items()]
    parts += [("covered_by_ui", graph["covered_by"], F.count_distinct("src")), ("implemented_in_code", graph["implemented_by"], F.count_distinct("src"))]
    out = None
    for name, df, what in parts:
        one = df.agg(what.alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
