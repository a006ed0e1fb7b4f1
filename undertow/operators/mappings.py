"""Proposed links from requirements to screens and files, resolved against what exists.

Proposals are (req_id, ord, screens, files): arrays of (name, confidence) and of (path, confidence). The last proposal
of a requirement by ord counts. Names that resolve to no screen and paths that are no file go; confidences are clamped
to 0..1, 0.5 where none is given. A requirement without a resolved screen has a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions.text import strip
from undertow.operators import resolve
from undertow.sources.bindings import clamp

GAP = "requirement should be testable but no captured screen exercises it"


def names_of(screens: DataFrame) -> DataFrame:
    """(name, id, ord): label, title and url of each screen, in the screens' order by seq."""
    each = F.posexplode(F.array("label", "title", "url"))
    return screens.select("screen_id", "seq", each.alias("place", "name")).select("name", F.col("screen_id").alias("id"), F.struct("seq", "place").alias("ord")).where("name <> ''")


def resolve_mappings(requirements: DataFrame, screens: DataFrame, proposals: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """covered_by (req_id, screen_id, confidence), implemented_by (req_id, path, confidence), gaps (req_id).

    requirements (req_id), screens (screen_id, seq, url, title, label), files (path). Of links between the same two
    the last proposed one gives the confidence.
    """
    last = proposals.groupBy("req_id").agg(F.max_by(F.struct("screens", "files"), "ord").alias("p"))
    known = requirements.select("req_id").distinct().join(last, "req_id")

    asked = known.select("req_id", F.posexplode("p.screens").alias("ord", "s")).select("req_id", "ord", F.col("s.name").alias("ask"), clamp(F.col("s.confidence")).alias("confidence"))
    found = resolve.resolve_cascade(asked, names_of(screens)).where("id is not null").select("ask", F.col("id").alias("screen_id"))
    covered = asked.join(found, "ask").groupBy("req_id", "screen_id").agg(F.max_by("confidence", "ord").alias("confidence"))

    wanted = known.select("req_id", F.posexplode("p.files").alias("ord", "f")).select("req_id", "ord", strip(F.col("f.path")).alias("path"), clamp(F.col("f.confidence")).alias("confidence"))
    implemented = wanted.join(files.select("path").distinct(), "path", "left_semi").groupBy("req_id", "path").agg(F.max_by("confidence", "ord").alias("confidence"))
    gaps = requirements.select("req_id").distinct().join(covered, "req_id", "left_anti")
    return {"covered_by": covered, "implemented_by": implemented, "gaps": gaps}
