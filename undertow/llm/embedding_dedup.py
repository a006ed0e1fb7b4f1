"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. After a fixed rotation the dimensions are cut into
blocks, and each block gets a share of that budget in proportion to its dimensions. The blocks' distances add up,
so a linked pair keeps to the budget in some block. Each block is range-joined by itself: a grid on its first
coordinates, with cells as wide as the block's radius, puts a pair within reach into the same or neighbouring
cells. Cells are dealt into tiles of bounded size, and a task compares one tile with another as matrices. A pair
that passes in several blocks counts in the first of them, and is then verified with the exact cosine in doubles,
in the same order of additions for any pair.

Tasks return sums, not pairs: for each vector its links in the tile pair, and links that span the tile pair's own
components. Equal vectors share one row, weighted by their number. So a group of any size gives output and
shuffles in proportion to its tiles, while each of its pairs is still compared.

Vectors of each length are a space of their own, compared among themselves. Before anything else a vector is scaled
by a power of two, so that no finite component over- or underflows.

Vectors that are null, empty, zero, or with null or non-finite components link with nothing. Null ids give a null
component. Repeated rows are separate vectors in n_links; different vectors under one id are so too, and each takes
its own component. Other columns, whatever their names, are ignored.

In a block the distances of random vectors lie close together, so on isotropic vectors cells prune little: the pairs
that share neighbouring cells are then most of all pairs, and the work grows with their square (figures in the README).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.llm.shared import connected_components, materialise

TILE = 16_384
STRIPE, WIDE = 512, 4096  # rows and columns of one product, so that it stays in a core's cache
_SALTS = 32
_SLACK = 1e-9


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(20).standard_normal((dims, dims)))[0]


def _blocks(dims: int, blocks: int) -> list[tuple[int, int]]:
    at = np.linspace(0, dims, min(blocks, dims) + 1).round().astype(int)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the least node reachable over the edges i-j."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in doubles; the scale by a power of two is exact."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _placer(blocks: int, budget: float, grid: int):
    turns: dict[int, np.ndarray] = {}

    def place(batches):
        for pdf in batches:
            rows = [pd.DataFrame({"node": [], "dims": [], "block": [], "cell": []})]
            for dims, part in pdf.groupby(pdf["v"].map(len)):
                if dims not in turns:
                    turns[dims] = rotation(dims)
                r = _unit(np.stack(part["v"].to_numpy())) @ turns[dims]
                for b, (lo, hi) in enumerate(_blocks(dims, blocks)):
                    width = np.sqrt(budget * (hi - lo) / dims + _SLACK) + _SLACK
                    cell = np.floor(r[:, lo : lo + min(grid, hi - lo)] / width).astype(int)
                    rows.append(pd.DataFrame({"node": part["node"], "dims": dims, "block": b, "cell": [",".join(map(str, c)) for c in cell.tolist()]}))
            yield pd.concat(rows[1:] or rows)

    return place


def _packer(kind: str):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        v = np.stack(pdf["v"].to_numpy()).astype(kind)
        return pd.DataFrame({"dims": pdf["dims"].iloc[:1], "block": pdf["block"].iloc[:1], "cell": pdf["cell"].iloc[:1], "tile": pdf["tile"].iloc[:1], "nodes": [pdf["node"].to_numpy(np.int64).tobytes()], "weights": [pdf["w"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()]})

    return pack


def _comparer(blocks: int, budget: float, cosine: float, kind: str):
    turns: dict[int, np.ndarray] = {}

    def near(p: np.ndarray, q: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs within the block's share of the budget: 2ab - aa - bb >= -budget, as products of stripes. Single
        precision, with a slack far above its error; the exact test follows."""
        one = lambda x: np.ones((len(x), 1))
        a = np.hstack([2 * p, -(p * p).sum(1, keepdims=True), one(p)]).astype(np.float32)
        b = np.hstack([q, one(q), -(q * q).sum(1, keepdims=True)]).astype(np.float32).T.copy()
        least, i, j = np.float32(-share - 1e-4), [np.zeros(0, int)], [np.zeros(0, int)]
        for c in range(0, b.shape[1], WIDE):
            some = np.ascontiguousarray(b[:, c : c + WIDE])
            for k in range(0, len(a), STRIPE):
                got = a[k : k + STRIPE] @ some
                if got.max() >= least:
                    x, y = np.nonzero(got >= least)
                    i.append(x + k), j.append(y + c)
        return np.concatenate(i), np.concatenate(j)

    def counted(x, y, p, q, i, j, block):
        """Of pairs, those that link and belong to this block: the first in whose reach they are."""
        dims = x.shape[1]
        for b, (lo, hi) in enumerate(_blocks(dims, blocks)[: block + 1]):
            inside = ((p[i, lo:hi] - q[j, lo:hi]) ** 2).sum(1) <= budget * (hi - lo) / dims + _SLACK
            keep = inside if b == block else ~inside
            i, j = i[keep], j[keep]
        keep = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
        return i[keep], j[keep]

    def compare(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                n1, n2 = np.frombuffer(row.nodes, np.int64), np.frombuffer(row.nodes2, np.int64)
                w1, w2 = np.frombuffer(row.weights, np.int64), np.frombuffer(row.weights2, np.int64)
                x, y = (_unit(np.frombuffer(raw, kind).reshape(-1, row.dims)) for raw in (row.vectors, row.vectors2))
                if row.dims not in turns:
                    turns[row.dims] = rotation(row.dims)
                p, q = x @ turns[row.dims], y @ turns[row.dims]
                lo, hi = _blocks(row.dims, blocks)[row.block]
                i, j = near(p[:, lo:hi], q[:, lo:hi], budget * (hi - lo) / row.dims)
                if row.same:
                    i, j = i[i < j], j[i < j]
                good = []
                for k in range(0, len(i), 100_000):
                    good.append(counted(x, y, p, q, i[k : k + 100_000], j[k : k + 100_000], row.block))
                i, j = (np.concatenate([v[n] for v in good]) if good else np.zeros(0, int) for n in (0, 1))
                if not len(i):
                    continue
                nodes = np.append(n1, n2)
                links = np.bincount(i, w2[j], len(nodes)) + np.bincount(j + len(n1), w1[i], len(nodes))
                order = np.argsort(nodes, kind="stable")
                back = np.empty_like(order)
                back[order] = np.arange(len(order))
                label = _components(len(nodes), back[i], back[j + len(n1)])
                some = np.flatnonzero(links)
                out.append(pd.DataFrame({"node": nodes[some], "links": links[some].astype(np.int64), "to": nodes[order][label[back[some]]]}))
            yield pd.concat(out) if out else pd.DataFrame({"node": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})

    return compare


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", blocks: int = 4, grid: int = 1, tile: int = TILE) -> DataFrame:
    """Returns each row's id, n_links, component_id and kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    node = F.when(fine, F.xxhash64("v"))  # a class of equal vectors; two that share a hash would be taken for equal
    marked = rows.select("id", node.alias("node"), F.pmod(F.xxhash64("id"), F.lit(_SALTS)).alias("salt"), "v")
    parts = materialise(marked.where("node is not null").groupBy("node", "salt").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")))
    classes = materialise(parts.groupBy("node").agg(F.min("least").alias("rep"), F.sum("n").alias("w"), F.first("v").alias("v")))
    budget = 2 - 2 * cosine
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"  # what holds the components exactly
    homes = materialise(classes.select("node", "v").mapInPandas(_placer(blocks, budget, grid), "node long, dims int, block int, cell string"))
    where = ["dims", "block", "cell"]
    sizes = homes.groupBy(*where).agg(F.count("*").alias("n")).select(*where, F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = homes.join(sizes, where).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    packed = dealt.join(classes.select("node", "w", "v"), "node").groupBy(*where, "tile").applyInPandas(_packer(kind), "dims int, block int, cell string, tile int, nodes binary, weights binary, vectors binary")
    packed = materialise(packed)
    place = F.transform(F.split("cell", ","), lambda x: x.cast("int"))
    shifts = [s for s in np.stack(np.meshgrid(*[[-1, 0, 1]] * grid, indexing="ij"), -1).reshape(-1, grid).tolist() if s >= [0] * grid]  # half of the neighbours
    beside = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in shifts]))
    moved = F.zip_with(place, F.slice("shift", F.lit(1), F.size(place)), lambda a, b: (a + b).cast("string"))
    keys = packed.select(*where, "tile", beside.alias("shift")).select(*where, "tile", F.array_join(moved, ",").alias("cell2")).distinct()
    other = packed.select("dims", "block", F.col("cell").alias("cell2"), F.col("tile").alias("tile2"))
    meets = keys.join(other, ["dims", "block", "cell2"]).where("cell <> cell2 or tile <= tile2")
    work = meets.join(packed, [*where, "tile"])
    second = packed.select("dims", "block", F.col("cell").alias("cell2"), F.col("tile").alias("tile2"), F.col("nodes").alias("nodes2"), F.col("weights").alias("weights2"), F.col("vectors").alias("vectors2"))
    work = work.join(second, ["dims", "block", "cell2", "tile2"]).withColumn("same", F.expr("cell = cell2 and tile = tile2"))
    work = work.select("dims", "block", "same", "nodes", "weights", "vectors", "nodes2", "weights2", "vectors2")
    found = materialise(work.mapInPandas(_comparer(blocks, budget, cosine, kind), "node long, links long, to long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reps = [classes.select(F.col("node").alias(x), F.struct("rep", "node").alias(f"s{x}")) for x in ("node", "to")]
    comps = connected_components(found.select("node", "to").distinct().join(reps[0], "node").join(reps[1], "to"), "snode", "sto")
    comps = comps.select(F.col("node.node").alias("node"), F.col("component.rep").alias("component"))
    per = classes.select("node", "rep", "w").join(links, "node", "left").join(comps, "node", "left")
    per = per.select("node", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    per = parts.select("node", "salt").join(per, "node")  # a hot vector's rows meet it by salt
    out = marked.drop("v").join(per, ["node", "salt"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
