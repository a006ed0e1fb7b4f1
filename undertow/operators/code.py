"""Code facts from source texts, and their resolution into import, render and call edges.

Sources are (path, source). Facts come from two automata over tokens (see lexer), not from a syntax tree: they tell code from
comments, strings, templates, regular expressions and JSX text, and which definition holds what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.operators import lexer
from undertow.plans.closure import checkpointed
from undertow.plans.numbering import collated

# Endings of import candidates in order of preference; calls that are never resolved; code files.
SUFFIXES = ["", ".tsx", ".ts", ".jsx", ".js", ".mjs", ".cjs", ".css", "/index.tsx", "/index.ts", "/index.js"]
BUILTINS = ["fetch", "console", "require"]
CODE_FILE = r"\.(ts|tsx|js|jsx|mjs|cjs)$"

_IMPORT = r"""(?m)^\s*import\s+(?:type\s+)?(?:([^'";]*?)\s*from\s*)?['"]([^'"]+)['"]"""


def facts(sources: DataFrame) -> DataFrame:
    """(file, places, imports): each text read once by the automata of `lexer`, its definitions and uses in order, and the
    import statements as (names, module). Written down, as several tables are made of it. A core reads some 100 KB of source a
    second, far less than a scan delivers, so texts are dealt out to four tasks a core first."""
    sources = sources.select("path", "source").repartition(4 * sources.sparkSession.sparkContext.defaultParallelism)
    tags = ~F.coalesce(language(F.col("path")) == "typescript", F.lit(False))
    read = sources.select(F.col("path").alias("file"), lexer.lexed(F.coalesce("source", F.lit("")), tags).alias("read"))
    both = F.arrays_zip(F.regexp_extract_all("read.full", F.lit(_IMPORT), F.lit(1)).alias("names"), F.regexp_extract_all("read.full", F.lit(_IMPORT), F.lit(2)).alias("module"))
    return checkpointed(read.select("file", lexer.structure(F.col("read.code")).alias("places"), both.alias("imports")))


def _facts(sources: DataFrame) -> DataFrame:
    return sources if "places" in sources.columns else facts(sources)


def symbols(sources: DataFrame) -> DataFrame:
    """(file, name, kind, line, exported) of sources or of their facts; of several on one line the last. Only what is
    exported at the top level counts as exported."""
    rows = _facts(sources).select("file", F.posexplode("places").alias("at", "p")).where("p.kind in ('class', 'function', 'method')")
    last = rows.groupBy("file", F.col("p.line").alias("line")).agg(F.max_by("p", "at").alias("p"))
    return last.select("file", "p.name", "p.kind", "line", "p.exported")


def imports(sources: DataFrame) -> DataFrame:
    """(from_file, module, names, ord): default, named (by their local name) and namespace imports."""
    rows = _facts(sources).select(F.col("file").alias("from_file"), F.posexplode("imports").alias("ord", "i"))
    names = F.transform(F.split(F.translate("i.names", "{}", "  "), ","), lambda n: F.trim(F.regexp_replace(n, r"(?s)^.*\bas\s+|^\s*type\s+(?=\w)|[\s*]+", "")))
    return rows.select("from_file", "i.module", F.filter(names, lambda n: n != "").alias("names"), "ord")


def uses(sources: DataFrame) -> DataFrame:
    """(file, kind, name, line, holder): components rendered (kind render) and bare names called (kind call), once a line
    and holder. The holder is the innermost symbol that a use stands in, null outside of all."""
    rows = _facts(sources).select("file", F.explode("places").alias("p")).where("p.kind in ('render', 'call')")
    return rows.select("file", "p.kind", "p.name", "p.line", "p.holder").distinct()


def normal_path(path: Column) -> Column:
    """Without empty and . segments; .. takes away the segment before it, if there is one."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def step(kept: Column, s: Column) -> Column:
        up = (s == "..") & F.coalesce(F.try_element_at(kept, F.lit(-1)) != "..", F.lit(False))
        return F.when(up, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(s)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def candidates(from_file: Column, module: Column) -> Column:
    """Paths that an import may mean, best first."""
    folder = F.regexp_extract(from_file, r"^(.*)/[^/]*$", 1)
    near = F.when(folder == "", module).otherwise(F.concat(folder, F.lit("/"), module))
    base = F.when(module.rlike(r"^\.\.?/"), near).when(module.startswith("/"), F.substring(module, 2, 1 << 30)).otherwise(module)
    return F.array_distinct(F.transform(F.filter(F.array(*[F.concat(base, F.lit(s)) for s in SUFFIXES]), lambda p: ~p.startswith("/")), normal_path))


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """(from_file, module, names, ord, to_file): each import with its first candidate among the files; others go."""
    tried = found.select("*", F.posexplode(candidates(F.col("from_file"), F.col("module"))).alias("place", "path"))
    met = tried.join(files.select("path").distinct(), "path")
    return met.groupBy("from_file", "module", "names", "ord").agg(F.min_by("path", "place").alias("to_file"))


def import_edges(resolved: DataFrame) -> DataFrame:
    """(from_file, to_file, imported_name), once each; names joined by commas, * where there are none."""
    names = F.coalesce(F.nullif(F.array_join("names", ","), F.lit("")), F.lit("*"))
    return resolved.select("from_file", "to_file", names.alias("imported_name")).distinct()


def use_edges(used: DataFrame, defined: DataFrame, resolved: DataFrame) -> DataFrame:
    """(kind, name, from_file, to_file): a name means the file's own symbol, else the file it is imported from (the
    last import wins). A call counts only where the target defines the name."""
    own = defined.select("file", "name").distinct().withColumn("own", F.lit(True))
    target = resolved.select(F.col("from_file").alias("file"), F.explode("names").alias("name"), "ord", "to_file").groupBy("file", "name").agg(F.max_by("to_file", "ord").alias("target"))
    asked = used.select("file", "kind", "name").distinct().where(~((F.col("kind") == "call") & F.col("name").isin(BUILTINS)))
    met = asked.join(own, ["file", "name"], "left").join(target, ["file", "name"], "left")
    met = met.select("kind", "name", F.col("file").alias("from_file"), F.when(F.col("own"), F.col("file")).otherwise(F.col("target")).alias("to_file")).where("to_file is not null")
    there = defined.select(F.col("file").alias("to_file"), "name").distinct()
    return met.where("kind = 'render'").unionByName(met.where("kind = 'call'").join(there, ["to_file", "name"], "left_semi"))


def symbol_edges(used: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, from_file, from_symbol, to_file, to_symbol), once each: the edges with the symbols that hold the uses. Uses
    outside of every symbol, and a symbol's uses of itself, give none."""
    held = used.where("holder is not null").select(F.col("file").alias("from_file"), "kind", "name", "holder").distinct()
    rows = held.join(edges, ["from_file", "kind", "name"]).select("kind", "from_file", F.col("holder").alias("from_symbol"), "to_file", F.col("name").alias("to_symbol"))
    return rows.where("from_file <> to_file or from_symbol <> to_symbol").distinct()


def language(path) -> Column:
    """typescript, tsx or javascript by the file's ending; null for others."""
    end = F.regexp_extract(path, CODE_FILE, 1)
    return F.when(end == "ts", "typescript").when(end == "tsx", "tsx").when(end != "", "javascript")


def code_model(sources: DataFrame) -> dict[str, DataFrame]:
    """Files with their place in the collated order of paths, symbols, import edges, use edges by file and by symbol of the
    code files."""
    code = sources.where(F.col("path").rlike(CODE_FILE))
    read = facts(code)
    defined, resolved, used = symbols(read), resolve_imports(imports(read), code), uses(read)
    files = code.select("path", language(F.col("path")).alias("language"), F.size(F.split("source", "\n", -1)).alias("loc"))
    files = collated(files, "path")
    edges = use_edges(used, defined, resolved)
    return {"files": files, "symbols": defined, "imports": import_edges(resolved), "edges": edges, "symbol_edges": symbol_edges(used, edges)}


def as_run(model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The model's tables with the names of a run's documents (see sources.artifacts.load_run)."""
    kinds = {"renders": ("render", "Component"), "calls": ("call", "Symbol")}
    out = {
        "files": model["files"].drop("place"),
        "symbols": model["symbols"].withColumnRenamed("file", "filePath"),
        "imports": model["imports"].select(F.col("from_file").alias("fromFile"), F.col("to_file").alias("toFile"), F.col("imported_name").alias("importedName")),
    }
    for name, (kind, part) in kinds.items():
        rows = model["symbol_edges"].where(F.col("kind") == kind)
        out[name] = rows.select(F.col("from_symbol").alias(f"from{part}"), F.col("to_symbol").alias(f"to{part}"), F.col("from_file").alias("fromFile"), F.col("to_file").alias("toFile"))
    return out
