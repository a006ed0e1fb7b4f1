"""BPE encoding and decoding with a public tokenizer file; long texts by tree concatenation.

Texts of up to `leaf` characters are encoded as they are. Longer ones are cut into leaves that become rows of their
own, dealt over all tasks and encoded in parallel. The leaves of a text then meet, and neighbours are joined two by
two up a tree: a window around the cut is encoded afresh and grows until it agrees with the left half on two
tokens in a row before the cut and with the right half on two tokens in a row after it. The left half up to its
agreement, the window between, and the right half from its agreement are the encoding of the whole: a sequence of
BPE tokens is the encoding of its text when each neighbouring pair is, and every pair lies within one of the three.
A window that has grown to both halves is itself the answer, so the tree always ends with an exact result.

The file is read on the executors from a path that they all have. Null texts are empty. Rows stay one to one, with
their columns (repeated rows too); columns named like the outputs are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from undertow.llm.shared import give_back, materialise, small_batches

LEAF, WINDOW = 32_768, 48
_loaded: dict = {}


def load(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


# --- one text: leaves and their joins ---------------------------------------------------


def encode_part(tokenizer, text: str, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, starts and ends of the tokens, in characters of the whole text."""
    e = tokenizer.encode(text, add_special_tokens=False)
    where = np.array(e.offsets, np.int64).reshape(-1, 2) + at
    return np.array(e.ids, np.uint32), where[:, 0], where[:, 1]


def _agreement(a, b, last: bool) -> tuple[int, int] | None:
    """Places of the first (or last) two tokens in a row that both sequences have at the same characters; the place
    of the second (or first) of the two. Only where no character is split between tokens."""
    places = {(int(s), int(e), int(i)): k for k, (i, s, e) in enumerate(zip(*a, strict=True))}
    get = [places.get((int(s), int(e), int(i)), -1) for i, s, e in zip(*b, strict=True)]
    whole = lambda x, k: k + 1 >= len(x[0]) or x[1][k + 1] >= x[2][k]
    pairs = range(1, len(get) - 2)  # the outermost tokens of the window are shaped by its edge
    for j in reversed(pairs) if last else pairs:
        if get[j] >= 0 and get[j + 1] == get[j] + 1:
            i = get[j]
            if last and (j == 0 or (whole(b, j - 1) and (i == 0 or whole(a, i - 1)))):
                return i, j
            if not last and whole(b, j + 1) and whole(a, i + 1):
                return i + 1, j + 1
    return None


def _part(x, i, j):
    return tuple(v[i:j] for v in x)


def join_parts(tokenizer, text: str, left, right, begin: int, cut: int, end: int, window: int = WINDOW):
    """The encoding of text[begin:end] from those of text[begin:cut] and text[cut:end]."""
    while True:
        b, e = max(begin, cut - window), min(end, cut + window)
        mid = encode_part(tokenizer, text[b:e], b)
        if b == begin and e == end:
            return mid
        if b == begin:  # the window starts as the left half does
            x = (0, 0)
        else:
            k = int(np.searchsorted(left[1], b))
            x = _agreement(_part(left, k, None), _part(mid, 0, int(np.searchsorted(mid[2], cut, "right"))), False)
            x = x and (x[0] + k + 1, x[1] + 1)
        if e == end:
            y = (len(right[0]), len(mid[0]))
        else:
            k, f = int(np.searchsorted(right[2], e, "right")), int(np.searchsorted(mid[1], cut))
            y = _agreement(_part(right, 0, k), _part(mid, f, None), True)
            y = y and (y[0], y[1] + f)
        if x and y and x[1] <= y[1]:
            return tuple(np.concatenate([p[: x[0]], m[x[1] : y[1]], q[y[0] :]]) for p, m, q in zip(left, mid, right, strict=True))
        window *= 2


def join_tree(tokenizer, text: str, parts: list, cuts: list[int]):
    """parts[i] encodes text[cuts[i]:cuts[i + 1]]."""
    while len(parts) > 1:
        joined, bounds = [], [cuts[0]]
        for i in range(0, len(parts), 2):
            if i + 1 < len(parts):
                joined.append(join_parts(tokenizer, text, parts[i], parts[i + 1], cuts[i], cuts[i + 1], cuts[i + 2]))
                bounds.append(cuts[i + 2])
            else:
                joined.append(parts[i])
                bounds.append(cuts[i + 1])
        parts, cuts = joined, bounds
    return parts[0]


# --- tables -----------------------------------------------------------------------------

_RESULT_DDL = "ids binary, n_tokens long, decoded string"
_CACHE = 100_000  # words that a task keeps; beyond that it starts afresh with those met last
_APART, _MANY = "0", 256  # what stands between words that are encoded as one text, and how many are
_known: dict[str, dict[bytes, bytes]] = {}
_tokens: dict[str, np.ndarray] = {}


def encode_apart(tokenizer, words: list[str]) -> list[bytes]:
    """Packed ids of each word, as a text of its own gives them, for a tokenizer that drops white space. Words are encoded
    many to a text, with one known token between them, and cut there; words that may hold that token go one by one."""
    out, apart = [b""] * len(words), tokenizer.encode(_APART, add_special_tokens=False).ids
    joined = [i for i, w in enumerate(words) if _APART not in w] if len(apart) == 1 else []
    for at in range(0, len(joined), _MANY * 16):
        groups = [joined[k : k + _MANY] for k in range(at, min(at + _MANY * 16, len(joined)), _MANY)]
        texts = [f" {_APART} ".join([words[i] for i in g]) for g in groups]
        for g, e in zip(groups, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = [*(np.flatnonzero(ids == apart[0]) * 4).tolist(), len(ids) * 4]
            if len(ends) != len(g):
                continue  # a word gave that token after all
            packed, begin = ids.tobytes(), 0
            for i, end in zip(g, ends, strict=True):
                out[i], begin = packed[begin:end], end + 4
    single = [i for i, x in enumerate(out) if not x]
    for at in range(0, len(single), 4096):
        part = single[at : at + 4096]
        for i, e in zip(part, tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
    return out


def encode_words(path: str, texts: list[str]) -> list[bytes]:
    """Packed ids of texts for a tokenizer that drops white space: those of the words, each different one encoded
    once. Only ASCII white space cuts here; the tokenizer sees to the rest."""
    tokenizer, known = load(path), _known.setdefault(path, {})
    cut = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    met = set().union(*cut)
    new = list(met.difference(known))
    known.update(zip(new, encode_apart(tokenizer, [w.decode("utf-8", "surrogatepass") for w in new]), strict=True))
    out = [b"".join(map(known.__getitem__, words)) for words in cut]
    if len(known) > _CACHE:
        _known[path] = {w: known[w] for w in met} if len(met) <= _CACHE else {}
    return out


def decode(path: str, ids: bytes) -> str:
    """The library's decode of packed ids, special tokens included; without a decoder that is a join of the tokens."""
    tokenizer, ids = load(path), np.frombuffer(ids, "<u4")
    if tokenizer.decoder is not None:
        return tokenizer.decode(ids.tolist(), skip_special_tokens=False)
    if path not in _tokens:
        _tokens[path] = np.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())], object)
    return " ".join(_tokens[path][ids].tolist())


def _result(path: str, ids: list[bytes]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([decode(path, i) for i in ids], pa.string())], ["ids", "n_tokens", "decoded"])


_batches = 0


def _breathe(every: int = 8) -> None:
    global _batches
    _batches += 1
    if _batches % every == 0:
        give_back()


def _functions(path: str, leaf_size: int, by_words: bool):
    place = "<u2" if leaf_size < 1 << 16 else "<u4"  # of a character within its leaf

    @arrow_udf(_RESULT_DDL)
    def whole(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = load(path)
        for text in texts:
            out = [_result(path, [])]
            for at in range(0, len(text), 512):
                some = text.slice(at, 512).to_pylist()
                ids = encode_words(path, some) if by_words else [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(some, add_special_tokens=False)]
                out.append(_result(path, ids))
                del some, ids
            yield pa.concat_arrays(out)
            _breathe()
        _known.clear()  # the worker stays for other tasks and stages
        give_back()

    @arrow_udf("ids binary, starts binary, ends binary")
    def leaf(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            parts = [[v.astype(k).tobytes() for v, k in zip(encode_part(load(path), x.as_py()), ("<u4", place, place), strict=True)] for x in text]
            yield pa.StructArray.from_arrays([pa.array([p[i] for p in parts], pa.binary()) for i in range(3)], ["ids", "starts", "ends"])
            del parts, text
            give_back()  # few batches, each of long texts

    @arrow_udf(_RESULT_DDL)
    def tree(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for leaves in batches:
            yield _result(path, [joined(row.as_py()) for row in leaves])
            del leaves
            give_back()

    def joined(row: list[dict]) -> bytes:
        text = "".join(x["piece"] for x in row)
        cuts = [0, *np.cumsum([len(x["piece"]) for x in row]).tolist()]
        parts = [(np.frombuffer(x["ids"], "<u4"), np.frombuffer(x["starts"], place).astype(np.int64) + a, np.frombuffer(x["ends"], place).astype(np.int64) + a) for x, a in zip(row, cuts[:-1], strict=True)]
        return join_tree(load(path), text, parts, cuts)[0].astype("<u4").tobytes()

    return whole, leaf, tree


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", leaf: int = LEAF, by_words: bool = False) -> DataFrame:
    """Adds ids (little-endian unsigned 32-bit), n_tokens and decoded. by_words: the tokenizer drops white space and
    never joins what stands on either side of it, so texts of one leaf are encoded by their different words."""
    whole, each, tree = _functions(tokenizer_path, leaf, by_words)
    rows = small_batches(docs).drop("ids", "n_tokens", "decoded")
    cols = rows.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_text = F.length(text) > leaf
    keep = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    back = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(cols)]
    short = rows.where(~long_text).select(keep.alias("row"), text.alias("t")).select("row", whole("t").alias("r"))
    # written down, so that a text keeps its number when an executor is lost and its input is read again
    rest = F.struct(*[F.lit(None).cast(rows.schema[c].dataType).alias(f"c{i}") if c == text_col else F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    tall = materialise(rows.where(long_text).select(F.monotonically_increasing_id().alias("uid"), rest.alias("row"), text.alias("t")))
    cuts = F.sequence(F.lit(0), F.length("t") - 1, F.lit(leaf))
    leaves = tall.select("uid", "row", "t", F.explode(cuts).alias("at"))
    leaves = leaves.select("uid", "at", F.when(F.col("at") == 0, F.col("row")).alias("row"), F.substring(F.col("t"), F.col("at") + 1, F.lit(leaf)).alias("piece"))
    leaves = leaves.repartition("uid", "at").withColumn("e", each("piece"))
    met = leaves.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "e.ids", "e.starts", "e.ends"))).alias("leaves"), F.first("row", ignorenulls=True).alias("row"))
    if text_col in cols:
        whole_text = F.array_join(F.transform("leaves", lambda x: x["piece"]), "")
        met = met.withColumn("row", F.struct(*[(whole_text if c == text_col else F.col(f"row.c{i}")).alias(f"c{i}") for i, c in enumerate(cols)]))
    out = short.union(met.select("row", tree("leaves").alias("r")))
    return out.select(*back, "r.ids", "r.n_tokens", "r.decoded")
