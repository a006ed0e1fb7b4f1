"""Evaluation of a run: invariants of the graph, stability of several narratives, words that stand for nothing known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from undertow.functions import text as X
from undertow.operators import impact

# Words that any narrative may use.
COMMON = """product page pages json ld xss ui qa pr flow flows screen screens requirement requirements test tests testing
search cart acme store verify confirm ensure validate check checking navigation pre existing related description details
detail image images title titles data render rendering script block blocks fix fixes change changes vulnerability
vulnerable malicious injection escaped escape escaping unescaped component components template templates code function
functions jsonld scripts admin customer customers user users browser browsers attacker field fields content values value
model models system systems""".split()


def invariants(graph: dict[str, DataFrame]) -> DataFrame:
    """One row: requirements, covered, gaps, links and the screens and files they lead to, dangling ends of the three
    cross-layer edges, and whether covered and gaps add up and nothing dangles."""
    covered, implemented = graph["covered_by"], graph["implemented_by"]
    parts = [
        graph["requirements"].agg(F.count_distinct("key").alias("requirements")),
        covered.agg(F.count_distinct("src").alias("covered"), F.count("*").alias("cover_edges"), F.count_distinct("dst").alias("cover_screens")),
        graph["gaps"].agg(F.count_distinct("src").alias("gaps")),
        implemented.agg(F.count("*").alias("impl_edges"), F.count_distinct("dst").alias("impl_files")),
    ]
    for name, edges, nodes in (("dangling_cover", covered, "screens"), ("dangling_impl", implemented, "files"), ("dangling_render", graph["rendered_by"], "files")):
        parts.append(impact.dangling(edges, "dst", graph[nodes], "key").agg(F.count("*").alias(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("ok", F.expr("requirements > 0 and covered + gaps = requirements and dangling_cover + dangling_impl + dangling_render = 0"))


def stability(narratives: DataFrame, by: list[str]) -> DataFrame:
    """(by..., pairs, percent) of narratives (by..., run, text): the mean Jaccard of the word sets of each two runs i < k;
    100 where there is only one run. The groups are the runs of one question, so pairs stay few."""
    rows = narratives.select(*by, "run", X.words(F.col("text"), 3).alias("w"))
    pairs = rows.select(*by, F.col("run").alias("i"), F.col("w").alias("a")).join(rows.select(*by, F.col("run").alias("k"), F.col("w").alias("b")), by).where("i < k")
    mean = pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(X.jaccard(F.col("a"), F.col("b"))).alias("mean"))
    asked = narratives.select(*by).distinct().join(mean, by, "left")
    return asked.select(*by, F.coalesce("pairs", F.lit(0)).alias("pairs"), F.round(F.coalesce("mean", F.lit(1.0)) * 100, 0).cast("long").alias("percent"))


def vocabulary(parts: list[DataFrame]) -> DataFrame:
    """(word): the different ones of several word tables."""
    out = parts[0].select("word")
    for p in parts[1:]:
        out = out.union(p.select("word"))
    return out.where("word <> ''").distinct()


def known_words(graph: dict[str, DataFrame]) -> DataFrame:
    """(word): what a narrative may name: words of screens, requirements and paths, symbols, and common words."""
    spark = graph["screens"].sparkSession

    def told(df: DataFrame, *cols: str) -> DataFrame:
        return df.select(F.explode(X.words(F.concat_ws(" ", *cols), 3)).alias("word"))

    paths = graph["files"].select(F.explode(X.vocabulary(F.col("path"))).alias("word"))
    names = graph["symbols"].select(F.lower("name").alias("word"))
    return vocabulary([told(graph["screens"], "label", "url", "title"), told(graph["requirements"], "req_id", "title", "user_action", "expected_outcome"), paths, names, spark.createDataFrame([(w,) for w in COMMON], "word string")])


def candidate(word: Column) -> Column:
    """The bare form of a word that may be a name: of five characters at least, without a small letter in front, not in
    capitals as a whole; null for other words."""
    bare = F.lower(F.regexp_replace(word, "[^A-Za-z0-9]", ""))
    return F.when((F.length(bare) >= 5) & ~word.rlike("^[a-z]") & (word != F.upper(word)), bare)


def suspicious(texts: DataFrame, by: list[str], known: DataFrame, most: int = 15) -> DataFrame:
    """(by..., place, word, mentions): of the words of texts (by..., text) that may be names and are unknown, each once as
    it first stands, the first `most` of each group; mentions is the number of all different ones."""
    split = F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+")
    words = texts.select(*by, F.posexplode(split).alias("at", "word")).withColumn("bare", candidate(F.col("word"))).where("bare is not null")
    first = words.join(known.select(F.col("word").alias("bare")), "bare", "left_anti").groupBy(*by, "bare").agg(F.min_by("word", "at").alias("word"), F.min("at").alias("at"))
    group = Window.partitionBy(*by)
    rows = first.withColumns({"place": F.row_number().over(group.orderBy("at")), "mentions": F.count("*").over(group)})
    return rows.where(F.col("place") <= most).select(*by, "place", "word", "mentions")


def evaluation(graph: dict[str, DataFrame], narratives: DataFrame, known: DataFrame | None = None, most: int = 15) -> DataFrame:
    """(place, check, value, status): a whole evaluation as rows, the last one its verdict.

    Counts of the graph's invariants; how much the narratives (run, field, text) of one piece of evidence agree, for each
    field; and the words of all runs that stand for nothing known, `most` of them by name. Only what must hold has a
    status, PASS or FAIL; the verdict is PASS where all of it holds. `known` replaces known_words(graph).
    """
    one = invariants(graph)
    judged = lambda c: F.when(c, "PASS").otherwise("FAIL")
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    dangling = ["dangling_cover", "dangling_impl", "dangling_render"]
    checks = [
        ("requirements", text("requirements"), judged(F.col("requirements") > 0)), ("covered", text("covered"), none), ("gaps", text("gaps"), none),
        ("covered + gaps = requirements", F.concat((F.col("covered") + F.col("gaps")).cast("string"), F.lit(" = "), text("requirements")), judged(F.expr("covered + gaps = requirements"))),
        ("dangling edges", F.concat_ws("/", *map(text, dangling)), judged(F.expr(" + ".join(dangling) + " = 0"))),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("check"), value.alias("value"), status.alias("status")) for i, (name, value, status) in enumerate(checks)])
    verdict = F.array(F.struct(F.lit(len(checks) + 2).alias("place"), F.lit("verdict").alias("check"), none.alias("value"), judged(F.col("ok")).alias("status")))
    out = one.select(F.inline(F.concat(rows, verdict)))
    agree = stability(narratives, ["field"]).select(F.lit(len(checks)).alias("place"), F.concat(F.lit("stability: "), "field").alias("check"), F.concat(text("percent"), F.lit("%")).alias("value"), none.alias("status"))
    words = narratives.select(F.explode(F.split("text", r"\s+")).alias("word")).select(candidate(F.col("word")).alias("bare")).where("bare is not null").distinct()
    strange = words.join((known_words(graph) if known is None else known).select(F.col("word").alias("bare")), "bare", "left_anti")
    listed = strange.orderBy("bare").limit(most).agg(F.array_join(F.array_sort(F.collect_list("bare")), ", ").alias("names"))
    guard = strange.agg(F.count("*").alias("n")).crossJoin(listed)  # one row each
    guard = guard.select(F.lit(len(checks) + 1).alias("place"), F.lit("suspicious mentions").alias("check"), F.when(F.col("n") > 0, F.concat(text("n"), F.lit(": "), "names")).otherwise("none").alias("value"), none.alias("status"))
    return out.unionByName(agree).unionByName(guard)


def evaluation_lines(rows: DataFrame) -> DataFrame:
    """(place, line): the evaluation as the rows of a Markdown table, in order of place and check."""
    return rows.select("place", F.concat(F.lit("| "), "check", F.lit(" | "), F.coalesce("value", F.lit("")), F.lit(" | "), F.coalesce("status", F.lit("—")), F.lit(" |")).alias("line"))
