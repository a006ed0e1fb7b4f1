"""Stored graphs: versions with an atomic switch, and the merge of a new run into one.

A save writes its tables to a folder of their own and then one small file, `versions/<n>`, that lists where each table lies.
Readers take the largest n, so they see a version whole or not at all; a save that was killed leaves the version before it.
The file is put in place by a rename that fails where the name is taken, so of two writers one is told. Tables that a save
does not bring keep their place. Nothing is overwritten, so a graph may be derived from the folder it is saved to.
"""

from __future__ import annotations

import json
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.operators import mappings

Graph = dict[str, DataFrame]
TABLES = ["files", "symbols", "imports", "renders", "calls", "screens", "navigates_to", "rendered_by", "requirements", "covered_by", "implemented_by", "gaps"]
#: The node tables at the ends of each edge table.
ENDS = {
    "imports": ("files", "files"), "renders": ("symbols", "symbols"), "calls": ("symbols", "symbols"), "navigates_to": ("screens", "screens"), "rendered_by": ("screens", "files"),
    "covered_by": ("requirements", "screens"), "implemented_by": ("requirements", "files"),
}


class StaleVersion(RuntimeError):
    """Another save came first."""


# --- versions -----------------------------------------------------------------------------------


class _Folder:
    """A namespace's folder, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str, namespace: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.base = f"{folder}/full_name={namespace.replace('%', '%25').replace('/', '%2F').replace(':', '%3A')}"
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Makes a file whole, or says that there is one."""
        draft = self.path(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = SparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.path(name)), how)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self.fs.delete(draft, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def versions(spark: SparkSession, folder: str, namespace: str) -> list[int]:
    """Numbers of the saved versions, oldest first."""
    return sorted(int(n) for n in _Folder(spark, folder, namespace).names("versions") if n.isdigit())


def save(graph: Graph, folder: str, namespace: str, based_on: int | None = None) -> int:
    """Saves tables as a new version and returns its number; the other tables stay as they were. With `based_on`, the
    version that the graph was derived from, it raises StaleVersion where another one came since."""
    spark = next(iter(graph.values())).sparkSession
    at, name = _Folder(spark, folder, namespace), uuid.uuid4().hex
    for table, df in graph.items():
        df.write.parquet(f"{at.base}/data/{name}/{table}")
    while True:
        done = versions(spark, folder, namespace)
        last = done[-1] if done else 0
        if based_on is not None and last != based_on:
            raise StaleVersion(f"{namespace} is at version {last}, not {based_on}")
        places = (json.loads(at.read(f"versions/{last}")) if last else {}) | {table: f"data/{name}/{table}" for table in graph}
        if at.put(f"versions/{last + 1}", json.dumps(places)):
            return last + 1


def load(spark: SparkSession, folder: str, namespace: str, version: int | None = None) -> Graph:
    """The tables of the last version, or of another one."""
    at, done = _Folder(spark, folder, namespace), versions(spark, folder, namespace)
    if not done or version is not None and version not in done:
        raise FileNotFoundError(f"no version {version or ''} of {namespace} in {folder}")
    places = json.loads(at.read(f"versions/{version or done[-1]}"))
    return {table: spark.read.parquet(f"{at.base}/{place}") for table, place in places.items()}


def reset(spark: SparkSession, folder: str, namespace: str) -> int:
    """A version of empty tables; other namespaces stay."""
    return save({name: spark.createDataFrame([], df.schema) for name, df in load(spark, folder, namespace).items()}, folder, namespace)


def clean(spark: SparkSession, folder: str, namespace: str, keep: int = 2) -> list[int]:
    """Deletes all but the last `keep` versions, and data that those do not use; data of saves that have not ended too, so
    no save may run meanwhile. Returns what is left."""
    at, done = _Folder(spark, folder, namespace), versions(spark, folder, namespace)
    left = done[-keep:]
    used = {place.split("/")[1] for n in left for place in json.loads(at.read(f"versions/{n}")).values()}
    for n in done[:-keep]:
        at.delete(f"versions/{n}")
    for name in set(at.names("data")) - used:
        at.delete(f"data/{name}")
    at.delete("drafts")
    return left


# --- merging ------------------------------------------------------------------------------------


def _without(rows: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def _both(new: DataFrame | None, old: DataFrame) -> DataFrame:
    return old if new is None else new.unionByName(old, allowMissingColumns=True)


def merge(old: Graph, new: Graph, deleted: DataFrame | None = None) -> Graph:
    """A stored graph after a run over a part of the world, `new`, with any of its tables.

    Nodes of the run replace those of their key; so do files of their path, with all their symbols. An edge of the stored graph
    whose from end the run has seen again (its file, screen or requirement) stays only if the run has it too. Files of
    `deleted` (path) go with their symbols. Edges stay only where both of their ends do, once; requirements without a
    screen are gaps, others are not.
    """
    seen = {"files": [], "screens": [], "requirements": []}
    if "files" in new:
        seen["files"].append(new["files"].select("path"))
    if deleted is not None:
        seen["files"].append(deleted.select("path"))
    out = dict(old)
    again: dict[str, DataFrame] = {}  # keys of stored nodes that are replaced or gone
    if seen["files"]:
        paths = seen["files"][0] if len(seen["files"]) == 1 else seen["files"][0].union(seen["files"][1])
        for name in ("files", "symbols"):
            again[name] = old[name].join(paths.distinct(), "path", "left_semi").select("key")
            out[name] = _both(new.get(name), _without(old[name], "path", paths, "path"))
    for name in ("screens", "requirements"):
        if name in new:
            again[name] = new[name].select("key")
            out[name] = _both(new[name], _without(old[name], "key", new[name], "key"))
    for name, (a, b) in ENDS.items():
        kept = _without(old[name], "src", again[a], "key") if a in again else old[name]
        edges = _both(new.get(name), kept)
        for end, table in (("src", a), ("dst", b)):
            edges = edges.join(out[table].select(F.col("key").alias(end)).distinct(), end, "left_semi")
        columns = [c for c in old[name].columns if c != "confidence"]
        out[name] = edges.groupBy(*columns).agg(F.max("confidence").alias("confidence")).select(old[name].columns) if "confidence" in old[name].columns else edges.select(columns).distinct()
    bare = _without(out["requirements"].select(F.col("key").alias("src")), "src", out["covered_by"], "src").distinct()
    made = {"src": F.col("src"), "key": F.concat("src", F.lit("::gap")), "reason": F.lit(mappings.GAP)}
    out["gaps"] = bare.select(*[made[c].alias(c) for c in old["gaps"].columns])
    return out
