"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regex is reduced to a Boolean query over trigrams: an OR of ANDs of the trigrams that every match must
hold (letters lower-cased). The index has postings (trigram, text key) for the trigrams that occur in any query, found
by one pass over each text; a clause's postings are intersected by key. Only the texts so found are verified, each
with the regexes of the rules that found it. A rule without mandatory trigrams scans all texts in place.

A text's key is a hash of its content, so that copies share postings; an equal key of another text only adds a
candidate, which verification removes. The candidates, 20 bytes or so each, are written down; Spark sends them to the
texts where they are at most 200,000, counted first, and shuffles both sides by key beyond it.

There may be any number of rules and of trigrams in a clause. Null texts are empty, empty ones hold nothing, and long
ones are scanned whole; a text's spans are put together in time quadratic in their number. Rows stay one to one,
repeated ones too, with all their columns; a column named like the output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.functions.fold import running
from undertow.llm.shared import few, materialise, spare_name


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and without overlap, whose group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs are maximal, so a lower bound in the pattern and one on the match are the same.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
)


# --- Boolean trigram queries -------------------------------------------------------------

_MOST = 128  # alternatives of a rule; beyond that a part counts as unknown, which only weakens the query


def _runs(items, before: set) -> set:
    """Alternatives (finished literal runs, open run) after the parsed items."""
    for op, arg in items:
        stop = {(done | {tail}, "") for done, tail in before}
        if op is C.LITERAL:
            after = {(done, tail + chr(arg).lower()) for done, tail in before}
        elif op is C.SUBPATTERN:
            after = _runs(arg[3], before)
        elif op is C.BRANCH:
            after = set().union(*(_runs(x, before) for x in arg[1]))
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            after = {(done, tail + chr(c).lower()) for done, tail in before for _, c in arg}
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == 0:
            after = before | _runs(arg[2], before) if arg[1] == 1 else stop
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            after = _runs(arg[2], before)
            after = after if arg[1] == 1 else {(done | {tail}, "") for done, tail in after}
        else:
            after = stop
        before = after if len(after) <= _MOST else stop
    return before


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of trigrams of which every match of the pattern holds one whole set; None: nothing is mandatory."""
    clauses = set()
    for done, tail in _runs(parser.parse(pattern), {(frozenset(), "")}):
        clauses.add(frozenset(r[i : i + 3] for r in done | {tail} for i in range(len(r) - 2)))
    if frozenset() in clauses:
        return None
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


# --- index, search, verification --------------------------------------------------------


def _alternatives(trigrams: list[str]) -> str:
    """A regex for any of these trigrams, as a tree by their first characters."""
    tree: dict[str, dict[str, list[str]]] = {}
    for t in trigrams:
        tree.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    one = lambda c: c if c.isalnum() else f"\\x{{{ord(c):x}}}"
    return "|".join(one(a) + "(?:" + "|".join(one(b) + "[" + "".join(map(one, cs)) + "]" for b, cs in sorted(bs.items())) + ")" for a, bs in sorted(tree.items()))


def postings(docs: DataFrame, text: Column, vocabulary: list[str]) -> DataFrame:
    """The inverted index (trigram, key) of the vocabulary over lower-cased texts."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=({_alternatives(vocabulary)}))"), F.lit(1))
    return docs.select(F.xxhash64(text).alias("key"), F.explode(F.array_distinct(found)).alias("trigram"))


_WORD = 62  # trigrams of a clause whose marks share one long


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(key, rules): the rules of which some clause's postings all hold the key."""
    spark = index.sparkSession
    rows = []
    for n, (r, c) in enumerate((r, c) for r, q in queries.items() for c in q):
        for w in range(0, len(c), _WORD):
            part = sorted(c)[w : w + _WORD]
            rows += [(t, n, r, w // _WORD, 1 << i, (1 << len(part)) - 1, -(-len(c) // _WORD)) for i, t in enumerate(part)]
    table = spark.createDataFrame(rows, "trigram string, clause int, rule int, word int, bit long, whole long, words int")
    hits = index.join(F.broadcast(table), "trigram")  # as large as the rules, which are literals
    met = hits.groupBy("key", "clause", "rule", "word", "whole", "words").agg(F.bit_or("bit").alias("bits")).where("bits = whole")
    met = met.groupBy("key", "clause", "rule", "words").agg(F.count("*").alias("n")).where("n = words")
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rx: Column, group: Column, least: Column, order: Column) -> Column:
    """Array of (start, order, end) of a rule's matches in code points."""
    whole = F.regexp_extract_all(text, rx, F.lit(0))
    between = F.split(text, rx, F.lit(-1))
    each = F.arrays_zip(F.transform(F.slice(between, F.lit(1), F.size(whole)), F.length).alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(F.regexp_extract_all(text, rx, group), F.length).alias("of"))
    kind = "struct<s:int,k:int,e:int,fits:boolean>"
    ends = lambda at, x: at + x["gap"] + x["len"]
    one = lambda at, x: F.struct((at + x["gap"]).alias("s"), order.alias("k"), ends(at, x).alias("e"), (x["of"] >= least).alias("fits"))
    found = F.filter(running(each, F.lit(0), ends, one, kind), lambda x: x["fits"])
    return F.when(F.rlike(text, rx), F.transform(found, lambda x: x.dropFields("fits"))).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<s:int,k:int,e:int>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """Adds out_col: array of (s, k, e), start and end in code points and the rule's place in `rules`, sorted."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    rows = docs if out_col == text_col else docs.drop(out_col)
    parts = [_spans(text, F.lit(r.pattern), F.lit(r.group), F.lit(r.least), F.lit(i)) for i, r in enumerate(rules) if i not in queries]
    spare = []
    if queries:
        key, found = spare = [spare_name(rows, "_key"), spare_name(rows, "_found")]
        spark = docs.sparkSession
        vocabulary = sorted({t for q in queries.values() for c in q for t in c})
        met = materialise(candidates(postings(docs, text, vocabulary), queries))
        listed = spark.createDataFrame([(i, rules[i].pattern, rules[i].group, rules[i].least) for i in queries], "rule int, rx string, of int, least int")
        met = met.select("key", F.explode("rules").alias("rule")).join(F.broadcast(listed), "rule")  # the rules again
        met = materialise(met.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("rx", "of", "least", "rule")).alias(found)))
        rows = rows.withColumn(key, F.xxhash64(text)).join(few(met, 200_000), key, "left")
        each = F.transform(F.col(found), lambda r: _spans(text, r["rx"], r["of"], r["least"], r["rule"]))
        parts.append(F.coalesce(F.flatten(each), F.array().cast(SPANS)))
    return rows.withColumn(out_col, F.array_sort(F.concat(*parts))).drop(*spare)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span (overlapping ones as one) by the mark; other columns stay, and texts without spans too."""
    spans = spare_name(docs, "_spans")
    rows, text = scan(docs, rules, text_col, spans), F.col(text_col)

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.col(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(spans).select(docs.columns)
