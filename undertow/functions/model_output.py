"""Rows from a language model's JSON answers: names changed, texts trimmed and capped, defaults filled in.

An answer is read from its first { to its last }; one that is no such JSON gives no rows (or the defaults).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.functions.text import extract_json, strip

# The most entries of each list and the most characters of each text.
CAPS = {"what_to_test": 12, "risk_areas": 8, "notes": 6, "primary_actions": 8, "key_components": 10, "label": 80, "purpose": 400}

_REQUIREMENTS = "requirements array<struct<title:string,description:string,user_action:string,expected_outcome:string,priority:string>>"
_LABEL = "label string, purpose string, primary_actions array<string>, key_components array<string>"
_NARRATIVE = "summary string, whatToTest array<string>, riskAreas array<string>, notes array<string>"
_MAPPINGS = "mappings array<struct<reqId:string,screens:array<struct<name:string,confidence:double>>,files:array<struct<path:string,confidence:double>>>>"


def _read(answer: Column, schema: str) -> Column:
    return F.from_json(extract_json(answer), schema)


def _list(x: Column, most: int) -> Column:
    return F.slice(F.coalesce(x, F.array().cast("array<string>")), 1, most)


def _text(x: Column) -> Column:
    return F.coalesce(strip(x), F.lit(""))


def requirements(answers: DataFrame) -> DataFrame:
    """(..., seq, title, description, user_action, expected_outcome, priority) of rows with an `answer`; without a
    title there is no requirement."""
    keep = [c for c in answers.columns if c != "answer"]
    rows = answers.select(*keep, F.posexplode(_read(F.col("answer"), _REQUIREMENTS)["requirements"]).alias("seq", "r")).where("r.title <> ''")
    texts = [_text(F.col(f"r.{c}")).alias(c) for c in ("title", "description", "user_action", "expected_outcome")]
    return rows.select(*keep, "seq", *texts, F.coalesce("r.priority", F.lit("medium")).alias("priority"))


def labels(screens: DataFrame) -> DataFrame:
    """Adds label, purpose, primary_actions and key_components to screens with a title and an `answer`; without a
    label in the answer the title stands in."""
    a = _read(F.col("answer"), _LABEL)
    return screens.select(
        *[c for c in screens.columns if c != "answer"],
        F.left(F.coalesce(a["label"], F.col("title")), F.lit(CAPS["label"])).alias("label"),
        F.left(F.coalesce(a["purpose"], F.lit("")), F.lit(CAPS["purpose"])).alias("purpose"),
        _list(a["primary_actions"], CAPS["primary_actions"]).alias("primary_actions"),
        _list(a["key_components"], CAPS["key_components"]).alias("key_components"),
    )


def narratives(answers: DataFrame) -> DataFrame:
    """(..., summary, what_to_test, risk_areas, notes) of rows with an `answer`."""
    a = _read(F.col("answer"), _NARRATIVE)
    lists = [_list(a[old], CAPS[new]).alias(new) for old, new in (("whatToTest", "what_to_test"), ("riskAreas", "risk_areas"), ("notes", "notes"))]
    return answers.select(*[c for c in answers.columns if c != "answer"], _text(a["summary"]).alias("summary"), *lists)


def proposals(answers: DataFrame) -> DataFrame:
    """(req_id, ord, screens, files) of rows with `ord` and `answer`: proposed links; a failed answer gives none."""
    rows = answers.select("ord", F.posexplode(_read(F.col("answer"), _MAPPINGS)["mappings"]).alias("at", "m"))
    return rows.select(F.col("m.reqId").alias("req_id"), F.struct("ord", "at").alias("ord"), "m.screens", "m.files")
