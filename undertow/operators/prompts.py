"""Texts that go to a language model, each part with a cap, made where the rows are.

A list of any length is cut before it is gathered: of its lines only as many as the cap on characters can hold reach the
task that joins them, whatever the size of the group. Null and empty lines are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertow.functions.text import label
from undertow.operators.engine import Impact
from undertow.operators.narrative import evidence
from undertow.plans.numbering import numbered

# The most characters of each text, and the most lines of the list of files.
SECTION = 6000
SNAPSHOT = 3500
SHOWN = 4000
DESCRIPTION = 1500
LIST = 3000
FILES = 300

_SALTS = 64


def section(heading: Column, body: Column) -> Column:
    """A section of a requirements document."""
    return F.concat(F.lit("Heading: "), F.coalesce(heading, F.lit("")), F.lit("\n\n"), F.left(F.coalesce(body, F.lit("")), F.lit(SECTION)))


def screen(url: Column, title: Column, snapshot: Column) -> Column:
    """A captured screen that is to be labelled."""
    return F.concat(F.lit("URL: "), F.coalesce(url, F.lit("")), F.lit("\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.left(F.coalesce(snapshot, F.lit("")), F.lit(SNAPSHOT)))


def shown(title: Column, snapshot: Column) -> Column:
    """What a crawling agent sees of a page."""
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\n"), F.left(F.coalesce(snapshot, F.lit("")), F.lit(SHOWN)))


def joined(rows: DataFrame, by: list[str], order: list[str], separator: str, most_chars: int | None = None, most_lines: int | None = None) -> DataFrame:
    """(by..., text): the lines of rows (by..., order..., line) of each group joined in order (then by line), cut to
    `most_lines` lines and `most_chars` characters; one of the two must be given. Every line has a character at least, so a
    cap on characters is one on lines. A group is cut in 64 shares first and then as a whole: the last task of a group has
    64 times the lines that it may keep at most."""
    bounds = [most_lines] if most_lines else []
    if most_chars:
        bounds.append(-(-(most_chars + len(separator)) // (1 + len(separator))))
    if not bounds:
        raise ValueError("a list needs a cap on its lines or its characters")
    most = min(bounds)
    line = F.left("line", F.lit(most_chars)) if most_chars else F.col("line")
    some = rows.where("line <> ''").select(*by, *order, line.alias("line"))
    some = some.withColumn("_salt", F.pmod(F.xxhash64(*order, "line"), F.lit(_SALTS)))
    for keys in ([*by, "_salt"], by):
        some = some.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "line"))).where(F.col("_at") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_at", "line"))), lambda x: x["line"])
    text = F.array_join(lines, separator)
    return some.groupBy(*by).agg((F.left(text, F.lit(most_chars)) if most_chars else text).alias("text"))


def _one(rows: DataFrame, order: list[str], separator: str, **most: int) -> DataFrame:
    """(text) of one list as one row, 'none' without lines."""
    one = joined(rows.withColumn("_all", F.lit(1)), ["_all"], order, separator, **most)
    return one.agg(F.coalesce(F.max("text"), F.lit("none")).alias("text"))


def mappings(requirements: DataFrame, screens: DataFrame, files: DataFrame, batch: int = 200, most_chars: int = 20 * LIST) -> DataFrame:
    """(batch, prompt): what a model is asked for links of requirements (req_id, title, user_action, expected_outcome) to
    screens (url, title, label) and files (path). Each prompt holds `batch` requirements in the order of req_id, the first
    300 paths, and as many screens as `most_chars` characters hold; so there are as many prompts as the requirements need
    and none grows with the graph."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    ask = F.concat(F.lit("- "), "req_id", F.lit(": "), empty("title"), F.lit(" | user: "), empty("user_action"), F.lit(" -> "), empty("expected_outcome"))
    placed = numbered(requirements.where("req_id is not null").select("req_id", F.left(ask, F.lit(DESCRIPTION)).alias("line")), ["req_id", "line"], "_n")
    asked = joined(placed.withColumn("batch", F.expr(f"(_n - 1) div {batch}")), ["batch"], ["_n"], "\n", most_lines=batch)
    named = F.concat(F.lit("- "), label(F.col("label"), F.col("title"), F.col("url")), F.lit(" ("), "url", F.lit(")"))
    seen = _one(screens.select("url", named.alias("line")), ["url"], "\n", most_chars=most_chars)
    paths = _one(files.select(F.col("path").alias("line")).distinct(), [], "\n", most_chars=FILES * DESCRIPTION, most_lines=FILES)
    known = seen.withColumnRenamed("text", "seen").crossJoin(paths.withColumnRenamed("text", "paths"))  # one row each
    return asked.crossJoin(F.broadcast(known)).select("batch", F.concat(F.lit("Requirements:\n"), "text", F.lit("\n\nScreens:\n"), "seen", F.lit("\n\nFiles:\n"), "paths").alias("prompt"))


# Kinds of evidence and what a prompt calls them, in order.
KINDS = {
    "file": "affected files",
    "symbol": "changed symbols",
    "upstream": "symbols that depend on them",
    "screen": "screens at risk",
    "flow": "flows touched",
    "at_risk": "requirements at risk",
    "losing": "requirements losing coverage",
    "uncovered": "requirements without coverage before",
}


def narrative(pull: DataFrame, files: DataFrame, impact: Impact) -> DataFrame:
    """(prompt): one row for each pull request (title, body) of the table: the evidence that its prose has to keep to. files:
    (path, additions, deletions). Every list takes 3000 characters at most, the description 1500."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    changed = F.concat("path", F.lit(" (+"), text("additions"), F.lit("/-"), text("deletions"), F.lit(")"))
    given = _one(files.select("path", changed.alias("line")), ["path"], ", ", most_chars=LIST).withColumnRenamed("text", "changed")
    lists = joined(evidence(impact), ["kind"], [], "; ", most_chars=LIST)
    told = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("text"))), F.lit("none")).alias(f"_{k}") for k in KINDS]
    rows = pull.select(F.coalesce("title", F.lit("")).alias("title"), F.left(F.coalesce("body", F.lit("")), F.lit(DESCRIPTION)).alias("body"))
    parts = [F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Description: "), "body"), F.concat(F.lit("Changed files: "), "changed")]
    parts += [F.concat(F.lit(f"- {name}: "), F.col(f"_{k}")) for k, name in KINDS.items()]
    one = given.crossJoin(lists.agg(*told))  # one row each
    return rows.crossJoin(F.broadcast(one)).select(F.concat_ws("\n", *parts).alias("prompt"))
