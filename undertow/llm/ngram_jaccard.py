"""N-gram Jaccard join by vertical partitioning.

All shingles (of 3 words unless told otherwise) have one global order, that of their 64-bit hashes, and every set is
cut into fragments of that order. Three things happen by fragment:

1. Candidates. Documents of like size form a class, and each class cuts the order into k fragments. Two linked sets of
   a class differ in at most d shingles, so with k = d + 1 + e fragments they agree on at least e + 1 whole ones. A set
   with m <= e empty ones leaves out half of e - m, its smallest: of the agreed ones, both sets keep the largest, so
   they share at least 1 + (e - m + 1) // 2. A set with more empty ones also gives each e + 1 of them. Agreement on
   one fragment (its content's hash) therefore finds every link, and needs no shingle frequencies.
2. Bounds. The order is cut into 128 fragments, the same for all sets; the sum of the smaller sizes bounds the overlap.
   In large sets such fragments are of like size by chance, so what is left of their pairs is compared by counts in as
   many fragments as half their shingles; only then are sets themselves moved.
3. Overlaps. The order is cut into 8 fragments, the same for all sets; the overlap of a pair is counted in each of
   them apart and summed per pair.

Sets are told apart by 64-bit hashes of their shingles and of themselves; equal hashes of different ones are the only
approximation (about 1e-3 expected wrong shingles in 1e8 different ones).

Groups do not become pairs. Copies with equal sets are one node. A bucket (the sets that agree on a fragment) of up to
8 nodes lists its pairs. What is linked and shares no such bucket shares all its agreed fragments in larger ones, so
only nodes with as many of these as step 1 promises stay there. Each is compared with one pivot of its buckets; where
a bucket still holds several components, its nodes are compared by how they differ from one set, which sets apart the
members of a large group of near copies; neighbouring buckets take the same set, so a node is taken apart once or a few
times, however many buckets it is in.

Nulls and empty texts have no shingles and link with nothing. Rows without an id keep a null component. Repeated
rows are one node, and each gets its row of the result; different texts under one id are different nodes, each with
its own component. Very long texts are sets like any other. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from undertow.llm.shared import connected_components, discard, few, give_back, materialise, mix, small_batches, text_blocks, word_hashes

_U = np.uint64
#: Fragments in which overlaps are counted, and the finer ones whose sizes bound an overlap (powers of two).
FRAGMENTS, FINE = 8, 128
#: Pairs of more shingles than this in both sets together are also compared by sketches: in smaller ones a fine fragment
#: holds four at most.
WIDE = 8 * FINE
#: The largest bucket that lists its pairs.
SMALL = 8
#: The least percentage: below it sets of one class may differ in so much that no fragment need be whole.
LEAST_PERCENT = 62
_SALTS = 32
#: Steps from bucket to bucket within which they agree on one set to compare with.
ROUNDS = 3


def size_class(n: int, percent: int) -> tuple[int, int, int]:
    """(lower bound, first size beyond, number) of the class of sets of size n. Bounds grow by a quarter."""
    low, number = -(-100 // (100 - percent)), 0
    while True:
        high = max(low + 1, low * 5 // 4)
        if n < high:
            return low, high, number
        low, number = high, number + 1


def spare_fragments(least: int, differ: int) -> int:
    """Spare fragments, so that sets of `least` shingles rarely leave more of them empty: as few as that takes. Where that
    takes fragments of less than one and a half shingles, the least spare number stays if a set then gives few combinations
    of its empty ones; else fragments get as fine as they must."""
    few, sigmas = (1 if differ < 24 else 2), (3 if differ < 100 else 6)

    def empty(e: int) -> float:
        k = differ + 1 + e
        mean = k * (1 - 1 / k) ** least
        return mean + sigmas * max(0.0, mean + k * (k - 1) * (1 - 2 / k) ** least - mean**2) ** 0.5

    for e in range(few, least):
        if 3 * (differ + 1 + e) > 2 * least:
            break
        if empty(e) <= e:
            return e
    if comb(ceil(empty(few)), few + 1) <= 64 + 2 * least:
        return few
    e = few
    while empty(e) > e:
        if e > 64 * least:
            raise ValueError(f"sets of {least} shingles that differ in {differ} have no whole fragments in common")
        e += 1 + e // 50
    return e


def plan(n: int, percent: int) -> list[tuple[int, int, int, int]]:
    """For a set of size n, its classes: (class bound, fragments, spare empty ones, number of the class)."""
    out, size, most = [], max(n, -(-100 // (100 - percent))), 100 * n // percent
    while size <= most:
        low, high, number = size_class(size, percent)
        differ = 2 * (high - 1) * (100 - percent) // (100 + percent)
        spare = spare_fragments(-(-low * percent // 100), differ)
        out.append((low, differ + 1 + spare, spare, number))
        size = high
    return out


def shingle_sets(column: pa.Array, width: int = 3):
    """Yields each row's sorted, distinct shingle hashes."""
    for _, data, offsets in text_blocks(column):
        words, at = word_hashes(data, offsets)
        s = np.zeros(0, _U)
        if len(words) >= width:
            s = words[: len(words) - width + 1] * _U(2 * width + 1)
            for i in range(1, width):
                s = mix(s) + words[i : len(words) - width + 1 + i] * _U(2 * width + 1 + 2 * i)
            s = mix(s)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if j - i >= width:
                x = np.sort(s[i : j - width + 1])
                yield x[np.append(True, x[1:] != x[:-1])]
            elif j > i:
                h = np.full(1, _U(j - i))
                for w in range(i, j):
                    h = mix(h * _U(31) + words[w])
                yield h
            else:
                yield s[:0]


def _sums(x: np.ndarray) -> tuple[int, int, int]:
    """Size and two sums that identify a set."""
    m = mix(x + _U(1))
    return len(x), int(m.sum(dtype=_U)), int(mix(m).sum(dtype=_U))


def _node(sums: list[tuple[int, int, int]]) -> np.ndarray:
    """The 64-bit hashes of sets with these sums."""
    s = np.array(sums, _U).reshape(-1, 3)
    return mix(mix(mix(s[:, 0]) + s[:, 1]) + s[:, 2]).view(np.int64)


_CLASSES = 8  # a set's classes follow each other; those whose numbers agree modulo this only weaken the promise


def _cuts(x: np.ndarray, k: int) -> np.ndarray:
    """Where the k fragments of a sorted set begin and end."""
    return np.searchsorted(((x >> _U(32)) * _U(k)) >> _U(32), np.arange(k + 1, dtype=_U))


def promises(x: np.ndarray, percent: int, plans: dict) -> list[int]:
    """By the number of the class modulo _CLASSES: how many signatures the set shares at least with a linked one."""
    if (p := plans.get(len(x))) is None:
        p = plans[len(x)] = plan(len(x), percent)
    out: dict[int, int] = {}
    for _, k, spare, number in p if len(x) else []:
        at = _cuts(x, k)
        share = 1 + (max(0, spare - int((at[1:] == at[:-1]).sum())) + 1) // 2
        out[number % _CLASSES] = min(share, out.get(number % _CLASSES, share))
    return [out.get(c, 1) for c in range(_CLASSES)]


def signatures(x: np.ndarray, percent: int, plans: dict) -> np.ndarray:
    """Fragment signatures of a sorted set; the low three bits are the number of the class."""
    if (p := plans.get(len(x))) is None:
        p = plans[len(x)] = plan(len(x), percent)
    parts, total = [], np.append(_U(0), np.cumsum(mix(x + _U(1)), dtype=_U))
    for low, k, spare, number in p:
        at = _cuts(x, k)
        of = np.arange(1, k + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(low)
        sig, some = mix(mix(total[at[1:]] - total[at[:-1]]) + of), at[1:] > at[:-1]
        empty = np.flatnonzero(~some)
        more = [mix(of[list(c)]).sum(dtype=_U) for c in combinations(empty.tolist(), spare + 1)]
        size, sig = np.diff(at)[some], sig[some]
        sig = np.append(sig[np.lexsort((sig, size))[max(0, spare - len(empty)) // 2 :]], mix(np.array(more, _U)))
        parts.append((sig & ~_U(_CLASSES - 1)) | _U(number % _CLASSES))
    return np.concatenate(parts) if parts else x[:0]


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(kind)))


def _profile(percent: int, width: int):
    @arrow_udf("n long, node long, sizes array<int>, shares array<int>")
    def profile(text: pa.Array) -> pa.Array:
        sums, sizes, shares, plans = [], [], [], {}
        for x in shingle_sets(text, width):
            sums.append(_sums(x))
            shares.append(np.array(promises(x, percent, plans), np.int32))
            sizes.append(np.bincount((x >> _U(64 - FINE.bit_length() + 1)).astype(np.int64), minlength=FINE).astype(np.int32))
        give_back()
        return pa.StructArray.from_arrays([pa.array([s[0] for s in sums], pa.int64()), pa.array(_node(sums)), _lists(sizes, np.int32), _lists(shares, np.int32)], ["n", "node", "sizes", "shares"])

    return profile


def _signer(percent: int, width: int, part: int, parts: int):
    """(sig, node) of each set, of the signatures those of one part; copies within a task give theirs once."""

    def sign(batches):
        plans, seen = {}, set()
        for b in batches:
            sigs, nodes, held = [], [], 0
            for x in shingle_sets(b.column(0), width):
                node = _node([_sums(x)])
                if not len(x) or node[0] in seen:
                    continue
                seen.add(node[0])
                s = signatures(x, percent, plans)
                sigs.append(s[(s >> _U(3)) % _U(parts) == _U(part)])
                nodes.append(np.repeat(node, len(sigs[-1])))
                held += len(sigs[-1])
                if held > 200_000:
                    yield _batch(sigs, nodes)
                    sigs, nodes, held = [], [], 0
            yield _batch(sigs, nodes)
        give_back()

    return sign


def _batch(sigs: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
    empty = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *(s.view(np.int64) for s in sigs)])), pa.array(np.concatenate([empty, *nodes]))], ["sig", "node"])


def _fragments(width: int):
    """(node, v, part): the sets cut into FRAGMENTS parts of the order; copies within a task come once."""
    edges = np.arange(FRAGMENTS + 1, dtype=_U)

    def cut_up(batches):
        seen = set()
        for b in batches:
            nodes, parts = [], []
            for x in shingle_sets(b.column(0), width):
                node = int(_node([_sums(x)])[0])
                if not len(x) or node in seen:
                    continue
                seen.add(node)
                at = np.searchsorted(x >> _U(64 - FRAGMENTS.bit_length() + 1), edges)
                nodes.append(node)
                parts.extend(x[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            v = np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(nodes, np.int64), FRAGMENTS)), pa.array(v), _lists(parts, np.int64)], ["node", "v", "part"])
        give_back()

    return cut_up


def sketch(x: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each of a power of two of equal ranges, two to four on average, 255 at most."""
    bits = max(0, (len(x) // 2).bit_length() - 1)
    return np.minimum(np.bincount((x >> _U(63 - bits) >> _U(1)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound, from two sketches, of how many shingles are in one of the sets only. Cut counts only lower it."""
    k = min(len(x), len(y))
    x, y = (s.reshape(k, -1).sum(1, dtype=np.int64) for s in (x, y))
    return int(np.abs(x - y).sum())


def _sketches(width: int):
    """(node, sketch) of each set; copies within a task come once."""

    def draw(batches):
        seen = set()
        for b in batches:
            nodes, made = [], []
            for x in shingle_sets(b.column(0), width):
                node = int(_node([_sums(x)])[0])
                if len(x) and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    made.append(sketch(x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(made, pa.binary())], ["node", "sketch"])
        give_back()

    return draw


def _least_differences():
    @arrow_udf("long")
    def differences(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left, right, strict=True)
        return pa.array([least_difference(*(np.frombuffer(s.as_buffer(), np.uint8) for s in p)) for p in pairs], pa.int64())

    return differences


def _repeated(batches):
    """Of rows sorted by signature and node, each once, those whose signature comes with another node; also the first
    and last run of a partition, which may go on in the next one."""
    held, known = None, True  # the last row so far, and whether its run is to be kept; a first run always is
    for b in batches:
        sig, node = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(sig):
            continue
        if held is not None:
            sig, node = np.append(held[0], sig), np.append(held[1], node)
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
        sig, node = sig[fresh], node[fresh]
        run = np.cumsum(np.append(False, sig[1:] != sig[:-1]))
        keep = np.bincount(run)[run] > 1
        keep[run == 0] |= known
        held, known = (sig[-1:], node[-1:]), bool(keep[-1])
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(node[keep])], ["sig", "node"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["sig", "node"])


def link(docs: DataFrame, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", width: int = 3, passes: int = 1) -> tuple[DataFrame, DataFrame]:
    """Joins documents whose sets of `width`-word shingles have 100 * |intersection| >= percent * |union|. The percentage is
    62 to 99; the lower, the finer the fragments: a set of n shingles is expected to give up to 1.5 n signatures at 75, 4 n at 62.

    Returns (members, links). members: every row's id, n_shingles, representative (smallest id with an equal set)
    and component_id (smallest id reachable by links). links: verified pairs of nodes that span the components, as
    the smallest ids with these sets (a, b, overlap); pairs within one component beyond those are not listed.

    The signatures are by far the widest shuffle. With `passes` they are made and grouped in so many parts, one after the
    other, each of which reads the texts again: less disk for more time, the same result.
    """
    if not LEAST_PERCENT <= percent < 100:
        raise ValueError(f"percent is {LEAST_PERCENT} to 99")
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    base = materialise(rows.select("doc", _profile(percent, width)("text").alias("p")).select("doc", "p.*"))
    salted = base.select("doc", "n", "node", F.pmod(F.xxhash64("doc"), F.lit(_SALTS)).alias("salt"))
    parts = salted.where("n > 0 and doc is not null").groupBy("node", "salt").agg(F.min("doc").alias("least"))  # a hot set has many rows: by salt first
    reps = materialise(parts.groupBy("node").agg(F.min("least").alias("rep")))
    kinds = materialise(base.where("n > 0 and doc is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("sizes").alias("sizes"), F.first("shares").alias("shares")))  # copies once

    ranges = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the widest shuffle; small sorts
    found = None
    for part in range(passes):
        signed = rows.where("doc is not null and text is not null").select("text").mapInArrow(_signer(percent, width, part, passes), "sig long, node long")
        some = materialise(signed.repartitionByRange(ranges, "sig", "node").sortWithinPartitions("sig", "node").mapInArrow(_repeated, "sig long, node long"))
        found = some if found is None else found.union(some)
    buckets = found.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
    grouped = materialise(found.join(buckets, "sig"))
    discard(found)  # (of several passes they stay until the caller's block ends)
    large = grouped.where(f"size > {SMALL}").withColumn("c", F.expr(f"cast(sig & {_CLASSES - 1} as int)"))
    held = large.groupBy("node", "c").agg(F.count("*").alias("held"))
    promised = kinds.join(held, "node").where(F.col("held") >= F.get("shares", F.col("c"))).select("node", "c").distinct()
    large = materialise(large.join(promised, ["node", "c"]).drop("c"))

    small = grouped.where(f"size <= {SMALL}").select("sig", "node")
    listed = small.join(small.select("sig", F.col("node").alias("b")), "sig").where("node < b").select(F.col("node").alias("a"), "b")
    pairs = materialise(listed.union(_with_pivots(large)).distinct())
    discard(grouped)
    ends = _ends(pairs).union(large.select("node")).distinct()
    known = materialise(kinds.join(ends, "node", "left_semi").select("node", "n", "sizes"))
    pairs = materialise(_possible(pairs, known, percent))

    def texts_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        need = materialise(reps.join(nodes.distinct(), "node", "left_semi").select(F.col("rep").alias("doc"), "node"))
        return need, rows.join(few(need.select("doc").distinct()), "doc", "left_semi").select("text")

    wide = pairs.where(F.col("size") > WIDE)
    if not wide.isEmpty():
        _, texts = texts_of(_ends(wide))
        sketches = materialise(texts.mapInArrow(_sketches(width), "node long, sketch binary"))
        pairs = materialise(pairs.where(F.col("size") <= WIDE).union(_close(wide, sketches, percent)))
        discard(sketches)

    need, texts = texts_of(_ends(pairs).union(large.select("node")))
    sets = texts.mapInArrow(_fragments(width), "node long, v int, part array<long>")
    if not base.join(need, ["doc", "node"], "left_semi").groupBy("doc", "node").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["node", "v"])  # only rows that repeat an id and its text can give a set twice
    sets = materialise(sets)

    links = materialise(_overlaps(pairs, sets, percent))
    comp = _components(links, reps)
    more = _beside_pivot(_mixed(large, comp), sets, known, percent)
    if more is not None:
        late = materialise(_overlaps(materialise(_possible(more, known, percent)), sets, percent))
        links = links.union(late)
        comp = _components(comp.where("node <> component.node").select(F.col("node").alias("a"), F.col("component.node").alias("b")).union(late.select("a", "b")), reps)
    discard(sets, known)
    label = parts.select("node", "salt").join(reps, "node").join(comp, "node", "left")
    label = label.select("node", "salt", "rep", F.coalesce("component.rep", "rep").alias("component_id"))
    out = salted.join(label, ["node", "salt"], "left")
    mine = [F.when(F.col("doc").isNotNull(), F.coalesce(c, "doc")).alias(name) for c, name in (("rep", "representative"), ("component_id", "component_id"))]
    named = links.join(reps.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), *mine), named.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "overlap")


def _components(links: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, component) of each node with links; nodes are ordered by their smallest id, so a component's least one names it."""
    named = [reps.select(F.col("node").alias(x), F.struct("rep", "node").alias(f"s{x}")) for x in ("a", "b")]
    comp = connected_components(links.select("a", "b").join(named[0], "a").join(named[1], "b"), "sa", "sb")
    comp = comp.select(F.col("node.node").alias("node"), "component")
    return materialise(comp.union(comp.select("component.node", "component")).distinct())


def _with_pivots(grouped: DataFrame) -> DataFrame:
    """Each node with one pivot (a, b): a bucket's pivot is its member with most company over all its buckets, and of
    its buckets' pivots a node takes the one that it shares most buckets with."""
    company = grouped.groupBy("node").agg(F.sum("size").alias("company"))
    pivots = _bucket_pivots(grouped)
    pairs = grouped.join(pivots, "sig").where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    pairs = pairs.join(company.withColumnRenamed("node", "a"), "a")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "company", "a")).alias("a"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _bucket_pivots(grouped: DataFrame) -> DataFrame:
    company = grouped.groupBy("node").agg(F.sum("size").alias("company"))
    return grouped.join(company, "node").groupBy("sig").agg(F.max(F.struct("company", "node")).alias("m")).select("sig", F.col("m.node").alias("a"))


def _possible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sizes allow a link: as a whole, and summed over the fine fragments."""
    for x in ("a", "b"):
        pairs = pairs.join(known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sizes").alias(f"s{x}")), x)
    bound = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    size = F.col("na") + F.col("nb")
    fit = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).where((100 + percent) * bound >= percent * size)
    return fit.select("a", "b", size.alias("size"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, size), those whose sketches allow a link."""
    for x in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}")), x)
    apart = pairs.select("a", "b", "size", _least_differences()("sa", "sb").alias("apart"))
    return apart.where((100 + percent) * (F.col("size") - F.col("apart")) >= 2 * percent * F.col("size")).select("a", "b", "size").distinct()


def _side_by_side(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs' sets by fragment: pa and pb. The pairs are a written table; where they have few ends, other sets stay where
    they are."""

    def of(x: str) -> DataFrame:
        ends = pairs.select(F.col(x).alias("node")).distinct()
        mine = sets.join(F.broadcast(ends), "node", "left_semi") if ends.count() <= 1_000_000 else sets
        return mine.select(F.col("node").alias(x), "v", F.col("part").alias(f"p{x}"))

    return pairs.join(of("b"), "b").join(of("a"), ["a", "v"])


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, size), those that link: the overlap is counted in each fragment and summed."""
    partial = _side_by_side(pairs, sets).select("a", "b", "size", F.size(F.array_intersect("pa", "pb")).cast("long").alias("o"))
    total = partial.groupBy("a", "b", "size").agg(F.sum("o").alias("overlap"))
    return total.where(f"100 * overlap >= {int(percent)} * (size - overlap)").select("a", "b", "overlap")


def _mixed(large: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b, c) for the buckets that still hold several components: a set to compare with, each member of a bucket and the
    member's component; the set itself comes with b = a. Any set tells two others apart (see below), so neighbouring
    buckets take the same one: that with most company within ROUNDS steps. A node of many buckets then has few of them."""
    lab = large.join(comp.select("node", F.col("component.node").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
    mixed = lab.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("sig")
    lab = materialise(lab.join(mixed, "sig", "left_semi").select("sig", "node", "c"))
    best = large.groupBy("node").agg(F.sum("size").alias("company")).select("node", F.struct("company", "node").alias("m"))
    for _ in range(ROUNDS):
        chosen = lab.join(best, "node").groupBy("sig").agg(F.max("m").alias("m"))
        best = materialise(lab.join(chosen, "sig").groupBy("node").agg(F.max("m").alias("m")))
    chosen = lab.join(best, "node").groupBy("sig").agg(F.max("m").alias("m")).select("sig", F.col("m.node").alias("a"))
    members = lab.join(chosen, "sig").select("a", F.col("node").alias("b"), "c")
    own = lab.select(F.col("node").alias("a"), "c").distinct().join(chosen.select("a").distinct(), "a", "left_semi").select("a", F.col("a").alias("b"), "c")
    return members.union(own).distinct()


def _beside_pivot(members: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame | None:
    """Candidates (a, b) of different components among the members (a, b, c) that are compared with a, their pivot.

    With X and Y the symmetric differences of two sets from the pivot, the sets differ in exactly |X ^ Y| shingles.
    So a link needs X and Y to have much in common, although most sets are close to the pivot: for |X| <= |Y|, r =
    (100 - percent) / (100 + percent) and set sizes n, 2 |X & Y| > |X| (1 - r), |X & Y| >= |X| - (n_X + n_Y) r / 2 and
    |X & Y| >= |Y| - (n_X + n_Y) r. Prefixes of X and Y, rarest shingles first, that these bounds leave must meet.
    """
    members = materialise(members)
    if members.isEmpty():
        return None
    r, t = (100 - percent) / (100 + percent), percent / 100
    own = members.where("a = b").select("a", F.col("c").alias("ca"))
    direct = members.where("a <> b").join(own, "a").where("c <> ca").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    group = members.where("a <> b").join(known.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    apart = _side_by_side(members.where("a <> b"), sets).select("a", "b", "c", F.explode(F.concat(F.array_except("pa", "pb"), F.array_except("pb", "pa"))).alias("e"))
    apart = materialise(apart)
    # shingles that only one document of the pivot has are first in the order; who has as many as a prefix holds meets nobody
    alone = apart.groupBy("a", "e").agg(F.count("*").alias("f"), F.min("b").alias("b")).where("f = 1").groupBy("a", "b").agg(F.count("*").alias("own"))
    held = apart.groupBy("a", "b").agg(F.count("*").alias("size")).join(group, ["a", "b"]).join(alone, ["a", "b"], "left").fillna(0, "own")
    need = F.greatest(F.floor(F.col("size") * ((1 - r) / 2) - 1e-9) + 1, F.ceil(F.col("size") - F.col("nb") * ((1 + 1 / t) * r / 2) - 1e-9), F.lit(1))
    short = F.col("size") - need + 1 - F.col("own")
    long = F.col("size") - F.greatest(F.ceil(F.col("size") - F.col("nb") * ((1 + 1 / t) * r) - 1e-9), F.lit(1)) + 1 - F.col("own")
    held = materialise(held.where(long > 0).drop("own"))
    # of the others, so are shingles that only one component of the pivot has: no candidates share them
    left = apart.join(few(held.select("a", "b")), ["a", "b"], "left_semi")
    counts = left.groupBy("a", "e").agg(F.count("*").alias("f"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("a", "e", "f")
    common = left.select("a", "b", "e").join(counts, ["a", "e"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("list"))
    lists = materialise(held.join(common, ["a", "b"]).withColumn("own", F.col("size") - F.size("list")))
    discard(apart)

    def prefix(n, name: str) -> DataFrame:
        part = lists.where(n > 0).select("a", "b", "c", "size", "nb", F.size("list").alias("m"), F.posexplode(F.slice("list", F.lit(1), n.cast("int"))).alias("at", "x"))
        named = {"b": name, "c": f"c{name}", "size": f"s{name}", "nb": f"n{name}"}
        return part.select("a", F.col("x.e").alias("e"), *[F.col(k).alias(v) for k, v in named.items()], (F.col("m") - F.col("at")).alias(f"r{name}"))

    # at the first shingle that both have, no more than what is left of either list can be common to both
    enough = (2 * F.least("rx", "ry") >= F.col("sx") + F.col("sy") - r * (F.col("nx") + F.col("ny")) - 1e-6) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    met = prefix(short, "x").join(prefix(long, "y"), ["a", "e"]).where("(sx < sy or sx = sy and x < y) and cx <> cy").where(enough)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(direct).distinct()
