"""The impact report as rows (section, place, line), so that no section has to fit in one task or on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.functions.text import band, screen_line, titled
from undertow.operators.engine import Impact

# Titles of the report's sections, in order.
TITLES = ["Summary", "Screens at risk", "User flows affected", "Requirements at risk", "Requirements losing coverage", "Pre-existing gaps", "What to test", "Risk areas", "What changed in code", "Confidence"]


def bullets(rows: DataFrame, section: str, item: Column) -> DataFrame:
    """(section, line): one bullet for each row; `_none_` where there are no rows."""
    at = F.lit(TITLES.index(section))
    lines = rows.select(at.alias("section"), F.concat(F.lit("- "), item).alias("line"))
    none = rows.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(at.alias("section"), F.lit(NONE).alias("line"))
    return lines.unionByName(none)


# Phrases of the report.
NO_LINKS = "no cross-layer links for at-risk requirements"
NONE = "_none_"
NO_SUMMARY = "_(no narrative; deterministic evidence below)_"


def confidence_line(one: DataFrame) -> DataFrame:
    """One line from one row (n, avg): the mean confidence in percent, its band and the number of links."""
    some = F.concat(F.lit("average "), F.round(F.col("avg") * 100, 0).cast("long").cast("string"), F.lit("% across "), F.col("n").cast("string"), F.lit(" cross-layer links ("), band(F.col("avg")), F.lit(" band)"))
    return one.select(F.when(F.col("n") > 0, some).otherwise(NO_LINKS).alias("line"))


def full(pull: DataFrame, files: DataFrame, impact: Impact, confidence: DataFrame, narrative: DataFrame, layers: DataFrame) -> DataFrame:
    """(section, line) of the whole report; section -1 is the head.

    pull: one row (number, title, state, base_ref, head_ref, head_sha). files: (path, status, additions, deletions).
    confidence: see Engine.confidence. narrative: see operators.narrative. layers: one row (requirements, screens, files).
    """
    text = lambda c: F.col(c).cast("string")
    head = pull.select(F.lit(-1).alias("section"), F.concat(F.lit("PR #"), text("number"), F.lit(": **"), "title", F.lit("** ("), "state", F.lit("), base "), "base_ref", F.lit(", head "), "head_ref", F.lit(" @ "), F.left("head_sha", F.lit(7))).alias("line"))
    summary = narrative.select(F.lit(0).alias("section"), F.coalesce(F.nullif("summary", F.lit("")), F.lit(NO_SUMMARY)).alias("line"))
    lists = {"What to test": "what_to_test", "Risk areas": "risk_areas"}
    told = [bullets(narrative.select(F.explode(c).alias("x")), title, F.col("x")) for title, c in lists.items()]
    changed = F.concat("path", F.lit(" ("), "status", F.lit(", +"), text("additions"), F.lit("/−"), text("deletions"), F.lit(")"))
    flow = F.concat("from_label", F.lit(" → "), "to_label")
    end = TITLES.index("Confidence")
    mark = lambda c, name: F.concat(F.when(F.col(c) > 0, "✅ ").otherwise("⚪ "), F.lit(f"{name} ("), text(c), F.lit(")"))
    used = layers.select(F.lit(end).alias("section"), F.concat(F.lit("Layers used: "), F.concat_ws(" · ", mark("requirements", "Requirements"), mark("screens", "DOM/UI"), mark("files", "Code"))).alias("line"))
    notes = narrative.select(F.lit(end).alias("section"), F.concat(F.lit("Notes: "), F.coalesce(F.nullif(F.array_join("notes", " · "), F.lit("")), F.lit("none"))).alias("line"))
    parts = [
        head, summary,
        bullets(impact.screens, "Screens at risk", screen_line(F.col("label"), F.col("url"))),
        bullets(impact.flows_inside, "User flows affected", flow),
        bullets(impact.requirements, "Requirements at risk", F.concat(titled(F.col("req_id"), F.col("title")), F.lit(" — via "), "via")),
        bullets(impact.losing_coverage, "Requirements losing coverage", titled(F.col("req_id"), F.col("title"))),
        bullets(impact.uncovered, "Pre-existing gaps", titled(F.col("req_id"), F.col("title"))),
        *told,
        bullets(files, "What changed in code", changed),
        impact.files.select(F.lit(TITLES.index("What changed in code")).alias("section"), F.concat(F.lit("affected: "), "path").alias("line")),
        confidence_line(confidence).select(F.lit(end).alias("section"), F.concat(F.lit("Confidence on cross-layer links: "), "line").alias("line")),
        used, notes,
    ]
    return reduce(DataFrame.unionByName, parts)


def offline(pull: DataFrame, files: DataFrame, impact: Impact, layers: DataFrame) -> DataFrame:
    """The report without a graph's requirement layer and without prose: its sections say so."""
    missing = "_not computed in offline mode; requires the connect stage_"
    narrative = pull.limit(1).select(F.lit("Offline report: deterministic sections only.").alias("summary"), *[F.array().cast("array<string>").alias(c) for c in ("what_to_test", "risk_areas", "notes")])
    none = pull.limit(1).select(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("avg"))
    rows = full(pull, files, impact, none, narrative, layers)
    hidden = [TITLES.index(t) for t in ("Requirements at risk", "Requirements losing coverage", "Pre-existing gaps", "What to test")]
    rows = rows.where(~F.col("section").isin(hidden))
    for at in hidden[:3]:
        rows = rows.unionByName(pull.limit(1).select(F.lit(at).alias("section"), F.lit(missing).alias("line")))
    todo = F.concat(screen_line(F.col("label"), F.col("url")), F.lit(": exercise the screen end-to-end after the change."))
    return rows.unionByName(bullets(impact.screens, "What to test", todo))


def write(parts: list[DataFrame], path: str) -> None:
    """Writes the report as text: sections in order, each under its title, lines sorted."""
    spark = parts[0].sparkSession
    body = reduce(DataFrame.unionByName, parts).select("section", F.lit(1).alias("kind"), "line")
    heads = spark.createDataFrame([(-1, 0, "# Impact report"), *[(i, 0, f"## {t}") for i, t in enumerate(TITLES)]], "section int, kind int, line string")
    heads.unionByName(body).orderBy("section", "kind", "line").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
