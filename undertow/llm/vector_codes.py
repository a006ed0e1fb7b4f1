"""Vector code compression: product codes in whole numbers.

Each component x becomes floor(scale * x). Vectors are cut into equal consecutive parts, and each part is replaced by
the place of the nearest entry of that part's codebook (squared distance, ties to the lower place). Parts and entries
are padded with zeros to a power of two and carried over by the integer Walsh-Hadamard transform, which scales squared
distances by exactly that power. The squared differences are summed in sequency order (most of a part's weight comes
first), and an entry leaves as soon as its partial sum passes the whole sum of a first guess. No floating point is
involved after the floor, so the nearest entry is exact.

Codebooks start as the parts of the vectors of the least ids; every round assigns all vectors and replaces each entry by
the floor of its parts' mean. A round sums inside each task and sends one row a component of the codebooks on, so no
vector is shuffled; the driver holds the codebooks alone, `entries` times the length of a vector.

Rows whose vector is null or has a null or non-finite component are dropped, and so are components of 2**45 and more (at
scale 256), whose squares leave 128 bits. Vectors of different lengths share one space: shorter ones are padded with
zeros, and so is a length that `parts` does not divide. Null and repeated ids keep their rows; null ids are last in the
order of ids, equal ids go by their vectors. An error beyond 64 bits is null. An empty table gives an empty result.
Other columns than the id, the vector and the label are not carried, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from undertow.llm.shared import few, materialise

#: Components are below this after scaling, so that sums of squares of any vector stay within 38 digits.
MOST = 1 << 53
#: Values (rows times components) that a task works on at a time.
BLOCK = 1 << 18


def sequency(n: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix of size n in order of their sign changes."""
    h = np.ones((1, 1), np.int8)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, padded with zeros to a power of two, in sequency order."""
    rows, width = x.shape
    n = 1 << max(0, width - 1).bit_length()
    out = np.zeros((rows, n), x.dtype)
    out[:, :width] = x
    step = 1
    while step < n:
        pairs = out.reshape(rows, n // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return out[:, sequency(n)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the place of its nearest row of entries, ties to the lower, and their squared distance."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    a, e = transform(x), transform(entries)
    n = a.shape[1]
    first = (a[:, :1] - e[:, 0]) ** 2
    guess = first.argmin(1)
    bound = ((a - e[guess]) ** 2).sum(1)
    row, place = np.nonzero(first <= bound[:, None])
    total = first[row, place]
    for k in range(1, n):
        total = total + (a[row, k] - e[place, k]) ** 2
        stays = total <= bound[row]
        row, place, total = row[stays], place[stays], total[stays]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(total, starts) if len(starts) else total
    hits = np.flatnonzero(total == least[row])  # rows are in order, and places within a row
    hits = hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]
    return place[hits], least // n


def _limit(width: int) -> int:
    """Components below this keep all sums of a part within 62 bits."""
    n = 1 << max(0, width - 1).bit_length()
    return int((2**60 // max(1, n * width)) ** 0.5)


class Codebooks:
    """Entries by part, entry and position, as whole numbers."""

    def __init__(self, entries: np.ndarray, length: int, scale: int):
        self.entries, self.length, self.scale = entries, length, scale
        self.parts, self.size, self.width = entries.shape
        self.largest = max([abs(int(v)) for v in entries.reshape(-1)], default=0)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.entries.reshape(-1)).encode()).hexdigest()

    def blocks(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Runs of vectors as (row, part, position); Python's integers where 64 bits could overflow."""
        step = max(1, BLOCK // max(1, self.length))
        for at in range(0, len(column), step):
            x = whole(column.slice(at, step), self.parts * self.width, self.scale)
            yield x.reshape(len(x), self.parts, self.width)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entries = self.entries
        if max(self.largest, int(np.abs(x).max(initial=0))) >= _limit(self.width):
            x, entries = x.astype(object), entries.astype(object)
        else:
            entries = entries.astype(np.int64)
        found = [nearest(x[:, p], entries[p]) for p in range(self.parts)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def whole(column: pa.Array, length: int, scale: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows of `length` whole numbers, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    out = np.zeros((len(column), length), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _decimals(values: np.ndarray) -> pa.Array:
    if values.dtype == object:
        return pa.array([int(v) for v in values], pa.decimal128(38, 0))
    return pa.array(values).cast(pa.decimal128(38, 0))


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"))
    return v.where(F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: F.abs(x) < MOST / scale), F.lit(False)))


def first_books(kept: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    length = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-length // parts)
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    x = whole(pa.array([r.v for r in rows], pa.list_(pa.float64())), parts * width, scale)
    return Codebooks(x.reshape(len(x), parts, width).transpose(1, 0, 2), length, scale)


def improve(kept: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts; those without any stay."""
    size, width = books.size, books.width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(books.parts * size, np.int64), np.zeros((books.parts * size, width), object)
        for batch in batches:
            for x in books.blocks(batch.column(0)):
                place = (books.assign(x)[0] + np.arange(books.parts) * size).reshape(-1)
                flat, order = x.reshape(place.size, width), np.argsort(place, kind="stable")
                starts = np.flatnonzero(np.diff(place[order], prepend=-1))
                if len(starts) and width:  # a block has at most 2**18 values of 53 bits
                    parts = flat[order].astype(object) if np.abs(flat).max(initial=0) >= 1 << 40 else flat[order]
                    total[place[order][starts]] += np.add.reduceat(parts, starts, axis=0).astype(object)
                n += np.bincount(place, minlength=len(n))
        used = np.flatnonzero(n)
        if len(used) and width:
            slots = (used[:, None] * width + np.arange(width)).reshape(-1)
            yield pa.record_batch([pa.array(slots), pa.array(np.repeat(n[used], width)), _decimals(total[used].reshape(-1))], ["slot", "n", "total"])

    rows = kept.select("v").mapInArrow(sums, "slot long, n long, total decimal(38,0)").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    flat = books.entries.reshape(-1).copy()
    for r in rows:
        flat[r.slot] = int(r.total) // r.n
    return Codebooks(flat.reshape(books.entries.shape), books.length, books.scale)


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    kept = _kept(vectors, id_col, vector_col, None, scale)
    books = first_books(kept, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = improve(kept, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """Columns (id, label, code, error) for every kept vector: the code has two hex digits a part, error is the sum of the
    parts' squared distances."""
    if books.size > 256:
        raise ValueError("two hex digits hold at most 256 entries")

    @arrow_udf(T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.DecimalType(38, 0))]))
    def codes(v: pa.Array) -> pa.Array:
        texts, errors = [], []
        for x in books.blocks(v):
            place, error = books.assign(x)
            texts += [bytes(row).hex() for row in place.astype(np.uint8)]
            errors.append(_decimals(error.sum(1)))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.concat_arrays(errors) if errors else pa.array([], pa.decimal128(38, 0))], ["code", "error"])

    coded = _kept(vectors, id_col, vector_col, label_col, books.scale).withColumn("c", codes("v"))
    return coded.select("id", "label", "c.code", "c.error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """Columns (id, label, code, error, label_error), and the codebooks. label_error sums the error over the rows of equal
    labels, nulls together; sums meet the rows by a join, as one label may hold most rows."""
    books = train(vectors, id_col, vector_col, parts, entries, rounds, scale)
    coded = materialise(encode(vectors, books, id_col, vector_col, label_col))
    sums = coded.groupBy("label").agg(F.sum("error").alias("total"))
    sums = few(materialise(sums.select(F.col("label").alias("of"), "total")))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("id", "label", "code", F.expr("try_cast(error AS bigint)").alias("error"), F.expr("try_cast(total AS bigint)").alias("label_error")), books
