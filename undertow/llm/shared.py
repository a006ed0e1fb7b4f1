"""Helpers that several operators share: shared storage, text kernels, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- storage that all executors share -------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for local sessions without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage is cut and executors may be lost. The shuffle files
    of this one execution go when it ends, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/undertow-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = path
    weakref.finalize(out, _written.pop, id(out), None)
    for block in _open.get()[-1:]:
        block.tables.append(out)
    return out


_written: dict[int, str] = {}


class scratch:  # noqa: N801
    """A block whose materialised tables are deleted at its end, but for those given to `keep`: they belong to the block
    around this one, if there is one. Each thread has blocks of its own."""

    def __enter__(self) -> scratch:
        self.tables: list[DataFrame] = []
        self.around = _open.get()
        self.token = _open.set((*self.around, self))
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        mine = len(self.tables)
        self.tables = [t for t in self.tables if t is not df]
        if self.around and len(self.tables) < mine:
            self.around[-1].tables.append(df)
        return df

    def __exit__(self, *failure) -> None:
        _open.reset(self.token)
        discard(*self.tables)


_open: ContextVar[tuple[scratch, ...]] = ContextVar("open", default=())


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast where it has at most `most`, counted first; beyond that Spark
    joins it as it does any other."""
    return F.broadcast(df) if df.count() <= most else df


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise wrote for these tables; no later plan may read them."""
    for df in tables:
        if path := _written.pop(id(df), None):
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(df: DataFrame) -> DataFrame:
    """The same table. Texts are long rows, so the session's Arrow batches are cut at a MB and 2000 rows: a Python worker
    holds a few MB of texts at a time, or one longer text. The cut is the same for all operators, as it is read when a plan
    runs and not when it is made; smaller numbers that the user chose stay."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20)):
        now = conf.get(name).removesuffix("b")
        if not now.lstrip("-").isdigit():
            continue  # in a unit, so the user's
        if not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


_trim = None


def give_back() -> None:
    """Returns a Python worker's free memory to the system, as workers are kept for later stages: that of Arrow's pool, and
    that of the C library where it can (glibc)."""
    global _trim
    pa.default_memory_pool().release_unused()
    if _trim is None:
        _trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)
    _trim(0)


def spare_name(df: DataFrame, name: str) -> str:
    """A column name like this one that the table does not have (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small tables in loops; Spark's cleaner removes it when it is no longer used."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


# --- text kernels: whole batches of UTF-8 text as NumPy arrays -------------------------

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_STEP = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) applied element by element."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random 64-bit number for each byte, the same for A-Z and a-z.
_BYTE = mix(_LOWER.astype(_U) * _MULT + _U(12345))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers.get("up", ())):
        for name, base in (("up", _STEP), ("down", _BACK)):
            x = np.full(max(n, 1 << 18), base, _U)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"], _powers["down"]


def text_blocks(column: pa.Array, most: int = 1 << 17):
    """Yields (first row, bytes, offsets) for runs of rows of about `most` bytes, without cutting a text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and for each row its first word."""
    return word_places(data, offsets, gaps)[:2]


def word_places(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of bytes outside `gaps`, each row's first word, and the words' first and last bytes."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~gaps[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _power(len(data))
    total = np.cumsum(_BYTE[data] * up[: len(data)], dtype=_U)
    hashes = total[ends] - np.where(starts > 0, total[starts - 1], _U(0))
    return mix(hashes * down[starts]), np.searchsorted(starts, offsets).astype(np.int64), starts, ends


# --- connected components ---------------------------------------------------------------


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node that has an edge: (node, component), component < node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until nothing changes. Each step
    aggregates before it shuffles, and hot nodes are only ever joined, which AQE can split.
    """
    e = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x <> y").distinct()
    e, before = cut(e), None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if not mark.n or (mark.n, mark.h) == before:
            return e.select(F.col("x").alias("node"), F.col("y").alias("component"))
        before = (mark.n, mark.h)
        both = e.union(e.select("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x and y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(least)
        e = cut(small.distinct())
