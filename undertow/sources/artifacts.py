"""Readers and writers of a run's JSON documents, and of source trees."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.functions.text import origin
from undertow.plans.numbering import numbered

ELEMENT = "struct<ref:string,role:string,name:string,href:string,inputType:string,placeholder:string>"
SCREEN = f"struct<screenId:string,url:string,title:string,label:string,purpose:string,primaryActions:array<string>,keyComponents:array<string>,elements:array<{ELEMENT}>,screenshotPath:string,snapshotPath:string,visited:boolean>"
TRANSITION = "struct<fromUrl:string,toUrl:string,action:string,elementText:string,elementRef:string>"
REQUIREMENT = "struct<reqId:string,title:string,description:string,userAction:string,expectedOutcome:string,sourceAnchor:string,priority:string>"
SYMBOL = "struct<name:string,kind:string,filePath:string,line:int,exported:boolean>"
EDGES = {
    "imports": "struct<fromFile:string,toFile:string,importedName:string>",
    "renders": "struct<fromComponent:string,toComponent:string,fromFile:string,toFile:string>",
    "calls": "struct<fromSymbol:string,toSymbol:string,fromFile:string,toFile:string>",
}
MANIFEST = f"baseUrl string, screens array<{SCREEN}>, transitions array<{TRANSITION}>, generatedAt string, log array<string>"
REQUIREMENTS = f"source string, requirements array<{REQUIREMENT}>, overview string"
CODE = f"fullName string, ref string, files array<struct<path:string,language:string,loc:int,symbols:array<{SYMBOL}>,imports:array<string>>>, " + ", ".join(f"{k} array<{v}>" for k, v in EDGES.items())
SNAPSHOT = "url string, title string, text string, refs map<string,struct<name:string,role:string,url:string>>"
PULL = "number int, title string, body string, state string, merged_at string, base struct<ref:string>, head struct<ref:string,sha:string>"
PULL_FILE = "filename string, status string, additions int, deletions int, patch string"


#: Folders whose files are no sources.
PRUNED = r"/(\.git|node_modules)/"


def _one(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, or the parts of one that save_run has put in a folder of that name, a line each."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    parts = "*" not in path and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    return spark.read.schema(f"{schema}, _first long" if parts else schema).option("multiLine", not parts).json(path)


def _items(doc: DataFrame, column: str) -> DataFrame:
    """Rows of an array of structs, with their place in it as seq."""
    first = F.coalesce("_first", F.lit(0)) if "_first" in doc.columns else F.lit(0)
    return doc.select(first.alias("first"), F.posexplode(column).alias("at", "x")).select((F.col("first") + F.col("at")).cast("int").alias("seq"), "x.*")


def load_run(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Screens, transitions, requirements, files, symbols, imports, renders and calls of a run's three documents."""
    crawl = _one(spark, f"{folder}/crawl/manifest.json", MANIFEST)
    code = _one(spark, f"{folder}/code.json", CODE)
    out = {name: _items(crawl, name) for name in ("screens", "transitions")}
    out["requirements"] = _items(_one(spark, f"{folder}/requirements.json", REQUIREMENTS), "requirements")
    out |= {name: _items(code, name) for name in ("files", *EDGES)}
    out["symbols"] = out["files"].select(F.explode("symbols").alias("s")).select("s.*")
    return out


#: The documents of a run, with the tables that each holds as arrays.
DOCUMENTS = {"crawl/manifest.json": (MANIFEST, ("screens", "transitions")), "requirements.json": (REQUIREMENTS, ("requirements",)), "code.json": (CODE, ("files", *EDGES))}


def document_parts(df: DataFrame, field: str, kept: list[str], rows: int) -> DataFrame:
    """(value): JSON objects with up to `rows` rows of the table each, as an array in `field`, and the place of the first.
    The rows' order is that of seq, if there is such a column."""
    placed = numbered(df, ["seq"], "_n") if "seq" in df.columns else numbered(df.withColumn("seq", F.monotonically_increasing_id()), ["seq"], "_n")
    part = F.expr(f"(_n - 1) div {rows}")
    items = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*kept).alias("x")))), lambda i: i["x"])
    return placed.groupBy(part.alias("_part")).agg(items.alias(field)).select(F.to_json(F.struct((F.col("_part") * rows).alias("_first"), field)).alias("value"))


def save_run(run: dict[str, DataFrame], folder: str, heads: dict[str, dict] | None = None, rows: int = 10_000) -> None:
    """Writes the documents that load_run reads. A document is a folder of parts, each a JSON object on a line of its own:
    one with the values of `heads` (by document), and for each table objects with up to `rows` of its rows in the order
    of seq and the place of the first. So many tasks write one document, and none holds more than a part of it. Tables
    that `run` lacks are left out; symbols lie in their files."""
    spark = next(iter(run.values())).sparkSession
    for name, (schema, tables) in DOCUMENTS.items():
        head = spark.createDataFrame([(json.dumps((heads or {}).get(name, {})),)], "value string")
        for table in tables:
            if table not in run:
                continue
            df = run[table]
            kept = [f.name for f in T._parse_datatype_string(schema)[table].dataType.elementType if f.name in df.columns]
            docs = document_parts(df, table, kept, rows)
            head = head.unionByName(docs)
        head.write.mode("overwrite").text(f"{folder}/{name}")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(url, title, text, refs), one row for each snapshot document."""
    return _one(spark, f"{folder}/*.snapshot.json", SNAPSHOT)


def elements(snaps: DataFrame) -> DataFrame:
    """(url, ref, role, name), the first of each role and name of a page by its ref; those without a name go."""
    rows = snaps.select("url", F.explode("refs").alias("ref", "r")).select("url", "ref", "r.role", "r.name")
    return _once(rows)


def _once(rows: DataFrame) -> DataFrame:
    """(url, ref, role, name): names trimmed and cut to 120 characters, blank ones gone, and of each role and name of a page
    the first ref. Refs count up as e1, e2, ..., so the shorter one comes first."""
    rows = rows.select("url", "ref", "role", F.left(F.trim("name"), F.lit(120)).alias("name")).where("name <> ''")
    return rows.groupBy("url", "role", "name").agg(F.min_by("ref", F.struct(F.length("ref"), "ref")).alias("ref")).select("url", "ref", "role", "name")


def pull_request(spark: SparkSession, path: str) -> DataFrame:
    rows = _one(spark, path, PULL)
    return rows.select("number", "title", F.coalesce("body", F.lit("")).alias("body"), "state", "merged_at", F.col("base.ref").alias("base_ref"), F.col("head.ref").alias("head_ref"), F.col("head.sha").alias("head_sha"))


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, status, additions, deletions, patch) of a pull request, however many files it has."""
    return _one(spark, path, PULL_FILE).select(F.col("filename").alias("path"), "status", "additions", "deletions", F.coalesce("patch", F.lit("")).alias("patch"))


def source_tree(spark: SparkSession, folder: str, most_bytes: int = 2_000_000) -> DataFrame:
    """(path, source) of the code files below a folder, without .git, node_modules and files beyond most_bytes. Spark's reader
    passes over empty files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ts,tsx,js,jsx,mjs,cjs}").load(folder)
    near = F.regexp_replace("path", "^[a-z]+:/+", "/")
    kept = rows.where(F.col("length") <= most_bytes).where(~near.rlike(PRUNED))
    return kept.select(F.substring(near, len(folder.rstrip("/")) + 2, 1 << 30).alias("path"), F.col("content").cast("string").alias("source"))


def readme(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def links(pages: DataFrame, most_text: int = 120) -> DataFrame:
    """(page_id, href, text) of pages (page_id, url, html): links that lead to http addresses, the first text of each
    href with white space as single blanks. A path means an address on the page's own origin."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*?\shref="([^"]*)"[^>]*>(.*?)</a>'), F.lit(0))
    rows = pages.select("page_id", "url", F.posexplode(F.transform(found, lambda x: F.struct(F.regexp_extract(x, r'(?is)\shref="([^"]*)"', 1).alias("href"), F.regexp_replace(x, r"(?is)<[^>]*>", " ").alias("text")))).alias("at", "a"))
    href = F.when(F.col("a.href").rlike("^/(?!/)"), F.concat(origin(F.col("url")), F.col("a.href"))).otherwise(F.col("a.href"))
    text = F.left(F.trim(F.regexp_replace("a.text", r"\s+", " ")), F.lit(most_text))
    rows = rows.select("page_id", href.alias("href"), text.alias("text"), "at").where(F.col("href").rlike("(?i)^https?:"))
    return rows.groupBy("page_id", "href").agg(F.min_by("text", "at").alias("text"))


def elements_again(known: DataFrame, again: DataFrame) -> DataFrame:
    """(url, ref, role, name) of a page's elements after a second snapshot: those known, and of the others each role and
    name once (see elements)."""
    same = ["url", "role", "name"]
    new = _once(again).join(known.select(*[F.col(c).alias(f"_{c}") for c in same]).distinct(), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same], "left_anti")
    return known.select("url", "ref", "role", "name").unionByName(new)


def save(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Writes each table below the folder, as Parquet or as JSON lines."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).save(f"{folder}/{name}")
