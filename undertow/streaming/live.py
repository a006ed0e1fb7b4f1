"""Structured Streaming forms: usage by day, first captures, an action budget, whole crawl sessions and the elements of pages,
each kept as state for each key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from undertow.plans.closure import checkpoint_folder


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over the files of one table, each taken once. The glob lets the table be one file or a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def usage(events: DataFrame, at: str, tag: str, amount: str, late: str = "1 day") -> DataFrame:
    """(day, tag, calls, input): daily totals; state older than the watermark is dropped."""
    zone = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    day = F.window(at, "1 day")
    return zone.groupBy(day, F.col(tag).alias("tag")).agg(F.count("*").alias("calls"), F.sum(amount).alias("input")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "tag", "calls", "input")


def budgeted(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, admitted, asked): how many actions each key has asked for so far, and how many its budget admits."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((asked,))
        yield pd.DataFrame({key: [group[0]], "admitted": [min(asked, budget)], "asked": [asked]})

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, admitted long, asked long"
    return rows.groupBy(key).applyInPandasWithState(step, schema, "asked long", "update", GroupStateTimeout.NoTimeout)


class _Session(StatefulProcessor):
    """visited: map of page to its place; frontier: list of waiting pages, first in first out; actions: map of page to count;
    totals: how many pages were visited and linked, and actions admitted and refused."""

    def __init__(self, key: str, screens: int | None, actions: int):
        self.key, self.screens, self.budget = key, screens, actions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.visited = handle.getMapState("visited", "url string", "place long")
        self.actions = handle.getMapState("actions", "url string", "n long")
        self.frontier = handle.getListState("frontier", "url string")
        self.totals = handle.getValueState("totals", "visited long, admitted long, refused long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen, admitted, refused = self.totals.get() if self.totals.exists() else (0, 0, 0)
        waiting = dict.fromkeys(r[0] for r in self.frontier.get()) if self.frontier.exists() else {}
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if r.url is None or r.kind is None:
                continue
            if r.kind == "act":
                n = self.actions.getValue((r.url,))[0] if self.actions.containsKey((r.url,)) else 0
                if n < self.budget:
                    self.actions.updateValue((r.url,), (n + 1,))
                    admitted += 1
                else:
                    refused += 1
            elif not self.visited.containsKey((r.url,)):
                if r.kind == "link":
                    waiting.setdefault(r.url)
                elif r.kind == "visit" and (self.screens is None or seen < self.screens):
                    seen += 1
                    self.visited.updateValue((r.url,), (seen,))
                    waiting.pop(r.url, None)
        if waiting:
            self.frontier.put([(url,) for url in waiting])
        else:
            self.frontier.clear()
        self.totals.update((seen, admitted, refused))
        pages = sorted(((v[0], k[0]) for k, v in self.visited.iterator())) if seen else []
        yield pd.DataFrame({self.key: [key[0]], "visited": [[url for _, url in pages]], "frontier": [list(waiting)], "admitted": [admitted], "refused": [refused]})

    def close(self) -> None:
        pass


class _Elements(StatefulProcessor):
    """known: map of a page's roles and names to the ref that showed each first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "role string, name string", "ref string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        shown = pd.concat(list(rows))
        for r in shown.iloc[shown["ref"].map(lambda x: (len(x or ""), x or "")).argsort(kind="stable")].itertuples():
            name = (r.name or "").strip(" ")[:120]
            at = (r.role or "", name)
            if name and not self.known.containsKey(at):
                self.known.updateValue(at, (r.ref or "",))
                new.append((key[0], r.ref, r.role, name))
        if new:
            yield pd.DataFrame(new, columns=["url", "ref", "role", "name"])

    def close(self) -> None:
        pass


_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    """States of several kinds need the RocksDB store, which also keeps them out of memory."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, mode, "None")


def sessions(rows: DataFrame, key: str, screens: int | None = None, actions: int = 6) -> DataFrame:
    """(key, visited, frontier, admitted, refused) of each session that a batch touches, from rows (key, seq, kind, url).

    A `visit` captures a page once, while the session has captured fewer than `screens`; a `link` makes a page wait, in the
    order of discovery, unless it waits or was visited; an `act` uses the page's budget of `actions`. Pages and links that
    come again change nothing. Rows of a batch count in the order of seq, batches as they come. Rows without kind or
    url are passed over.
    """
    kind = rows.schema[key].dataType.simpleString()
    return _keyed(rows.select(key, "seq", "kind", "url"), key, _Session(key, screens, actions), f"{key} {kind}, visited array<string>, frontier array<string>, admitted long, refused long", "Update")


def elements(rows: DataFrame) -> DataFrame:
    """(url, ref, role, name): each role and name of a page when it is shown first, from rows of the same columns. Names are
    trimmed and cut to 120 characters, blank ones go; of a batch the first ref counts."""
    kind = rows.schema["url"].dataType.simpleString()
    return _keyed(rows.select("url", "ref", "role", "name"), "url", _Elements(), f"url {kind}, ref string, role string, name string", "Append")


def run_to_table(stream: DataFrame, mode: str, key: list[str] | None) -> DataFrame:
    """Runs over what is there now and returns the result as a table; of updates, the newest of each key.

    Each batch goes to its own folder, overwritten when the batch is repeated after a failure.
    """
    spark = stream.sparkSession
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(save).start()
    run.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    rows = spark.read.schema(schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    if not key:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, *[F.col(f"r.{c}") for c in rest])
