"""Who writes the prose of a report. Evidence goes in as tables, and a one-row table (summary, what_to_test, risk_areas,
notes) comes out. The built-in writer has no model behind it and only says so; others implement the same method."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undertow.functions import model_output
from undertow.operators.engine import Impact

# Fixed value: what the report says where no prose was written.
FALLBACK = "Automated analysis could not be written ({reason}). The deterministic evidence below still stands."


class NarrativeWriter(Protocol):
    def write(self, spark: SparkSession, pull: DataFrame, impact: Impact) -> DataFrame: ...


class Degraded:
    """No model: a summary that says so, and empty lists."""

    def __init__(self, reason: str = "no language model"):
        self.reason = reason

    def write(self, spark: SparkSession, pull: DataFrame, impact: Impact) -> DataFrame:
        return spark.createDataFrame([(FALLBACK.format(reason=self.reason), [], [], [])], "summary string, what_to_test array<string>, risk_areas array<string>, notes array<string>")


class Answered:
    """An answer that a model gave elsewhere, as a one-row table (answer); an unreadable one leaves the summary empty."""

    def __init__(self, answer: DataFrame):
        self.answer = answer

    def write(self, spark: SparkSession, pull: DataFrame, impact: Impact) -> DataFrame:
        return model_output.narratives(self.answer.select("answer"))


def evidence(impact: Impact) -> DataFrame:
    """(kind, line): what a writer may restate, as rows."""
    flows = F.concat("from_label", F.lit(" -> "), "to_label")
    titled = F.concat("req_id", F.lit(" "), "title")
    parts = [
        ("file", impact.files, F.col("path")), ("symbol", impact.symbols, F.col("name")), ("upstream", impact.upstream_symbols, F.col("name")),
        ("screen", impact.screens, F.concat("label", F.lit(" ("), "url", F.lit(")"))), ("flow", impact.flows, flows),
        ("at_risk", impact.requirements, titled), ("losing", impact.losing_coverage, titled), ("uncovered", impact.uncovered, titled),
    ]
    out = None
    for kind, df, line in parts:
        one = df.select(F.lit(kind).alias("kind"), line.alias("line"))
        out = one if out is None else out.unionByName(one)
    return out
