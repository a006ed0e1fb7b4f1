"""Routes, and the resolution of proposed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertow.functions.text import strip, words
from undertow.sources.bindings import clamp


def route_table(files: DataFrame) -> DataFrame:
    """(path, pattern, n_dyn, len, segments) of the page files below app/."""
    pattern = F.nullif(F.regexp_extract("path", r"^app/(.+)/page\.(tsx|ts|js|jsx)$", 1), F.lit(""))
    routes = files.select("path", F.concat(F.lit("/"), pattern).alias("pattern")).where("pattern is not null")
    return routes.select("path", "pattern", F.regexp_count("pattern", F.lit(r"\[")).alias("n_dyn"), F.length("pattern").alias("len"), F.size(F.split("pattern", "/")).alias("segments"))


def _segments(path) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _wild(segment: Column) -> Column:
    return segment.startswith("[") & segment.endswith("]")


def resolve_routes(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """(url_path, path): the best matching route: one with as many segments, each equal or a wildcard.

    A route's key is its number of segments with its first literal segment and that one's place. A path gives one key
    for each of its segments (and one for routes of wildcards only), so it meets only routes that agree in one word.
    """
    none = F.struct(F.lit(-1).alias("at"), F.lit("").alias("word"))
    placed = lambda x: F.transform(x, lambda s, i: F.struct(i.alias("at"), s.alias("word")))
    asked = paths.select("url_path").distinct()
    mine = asked.select("url_path", _segments("url_path").alias("u")).select("url_path", "u", F.size("u").alias("n"), F.explode(F.concat(placed(F.col("u")), F.array(none))).alias("k"))
    listed = routes.select("path", "pattern", "n_dyn", "len", _segments("pattern").alias("p"))
    literal = F.filter(placed(F.col("p")), lambda x: ~_wild(x["word"]))
    listed = listed.withColumns({"n": F.size("p"), "k": F.coalesce(F.get(literal, F.lit(0)), none)})
    fits = F.forall(F.zip_with("p", "u", lambda p, u: _wild(p) | (p == u)), lambda ok: ok)
    met = mine.join(listed, ["n", "k"]).where(fits)
    best = met.groupBy("url_path").agg(F.min(F.struct("n_dyn", (-F.col("len")).alias("l"), "pattern", "path")).alias("b"))
    return asked.join(best, "url_path", "left").select("url_path", F.col("b.path").alias("path"))


def resolve_fuzzy(asked: DataFrame, names: DataFrame, least: float = 0.6, longer_than: int = 2, tie: str = "name") -> DataFrame:
    """(ask, name, score): the name with the largest share of common words; the smallest `tie` of equal ones.

    A share of `least` of the longer side means that both sides share one of their rarest n - least * n + 1 words, so
    only these meet in the join, and frequent words make no pairs. Candidates are then scored on all words.
    """
    a = asked.select("ask", words(F.col("ask"), longer_than).alias("wa")).distinct()
    b = names.select("name", F.col(tie).alias("tie"), words(F.col("name"), longer_than).alias("wb")).groupBy("name", "wb").agg(F.min("tie").alias("tie"))
    often = b.select(F.explode("wb").alias("w")).groupBy("w").agg(F.count("*").alias("often"))

    def rare(df: DataFrame, key: str, ws: str) -> DataFrame:
        ranked = df.select(key, F.explode(ws).alias("w")).join(often, "w").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("often", "w"))).alias("r"))
        # words of no name cannot meet; they are left out of the ranking but count in n, so the prefix only grows
        n = F.size(ws)
        few = (n - F.ceil(n * least - 1e-9) + 1).cast("int")
        return df.join(ranked, key).select(key, F.explode(F.slice("r", F.lit(1), few)).alias("r")).select(key, F.col("r.w").alias("w"))

    pairs = rare(a, "ask", "wa").join(rare(b, "name", "wb"), "w").select("ask", "name").distinct().join(a, "ask").join(b, "name")
    scored = pairs.withColumn("score", F.size(F.array_intersect("wa", "wb")) / F.greatest(F.size("wa"), F.size("wb"))).where(F.col("score") >= least)
    best = scored.groupBy("ask").agg(F.min(F.struct((-F.col("score")).alias("s"), "tie", "name")).alias("b"))
    return best.select("ask", "b.name", (-F.col("b.s")).alias("score"))


def resolve_url_in_text(asked: DataFrame, urls: DataFrame) -> DataFrame:
    """(ask, name): the longest url (beginning with http) that the text contains, the least of equally long ones.

    Every place where http begins gives one key for each length that occurs among the urls; keys meet urls in an
    equi-join. There are no more lengths than the longest url has characters.
    """
    known = urls.where("name like 'http%'").select("name").distinct()
    lengths = sorted(r[0] for r in known.select(F.length("name")).distinct().collect())
    if not lengths:
        return asked.select("ask", F.lit(None).cast("string").alias("name")).where("false")
    tails = F.regexp_extract_all("ask", F.lit(f"(?s)(?=(http.{{0,{lengths[-1] - 4}}}))"), F.lit(1))
    places = asked.select("ask").distinct().select("ask", F.explode(F.array_distinct(tails)).alias("tail"))
    keys = places.select("ask", F.explode(F.transform(F.filter(F.lit(lengths), lambda n: n <= F.length("tail")), lambda n: F.left(F.col("tail"), n))).alias("name"))
    met = keys.join(known, "name").groupBy("ask").agg(F.min(F.struct((-F.length("name")).alias("n"), "name")).alias("b"))
    return met.select("ask", "b.name")


def whitelist(names: DataFrame) -> DataFrame:
    """(name, id, pos) of names (name, id, ord): the last id of a name wins and keeps the name's first place."""
    rows = names.select(strip(F.col("name")).alias("name"), "id", "ord").where("name <> ''")
    return rows.groupBy("name").agg(F.max_by("id", "ord").alias("id"), F.min("ord").alias("pos"))


def resolve_cascade(asked: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """(ask, step, id) for each different ask; step and id are null where nothing matches.

    In order: the exact name; the name in closing parentheses; the name before them; the longest url inside the text;
    the best share of common words among names that are no urls.
    """
    known = whitelist(names)
    rows = asked.select("ask").distinct().withColumn("exact", strip(F.col("ask")))
    closed = F.col("exact").rlike(r"\([^)]+\)\s*$")
    rows = rows.withColumn("paren", F.when(closed, strip(F.regexp_extract("exact", r"\(([^)]+)\)\s*$", 1))))
    rows = rows.withColumn("bare", F.when(closed, strip(F.regexp_replace("exact", r"(?s)\([^(]*$", ""))))
    for step in ("exact", "paren", "bare"):
        rows = rows.join(known.select(F.col("name").alias(step), F.col("id").alias(f"{step}_id")), step, "left")
    left = rows.where("coalesce(exact_id, paren_id, bare_id) is null").select(F.col("exact").alias("ask")).distinct()
    url = resolve_url_in_text(left, known).join(known, "name").select(F.col("ask").alias("exact"), F.col("id").alias("url_id"))
    near = resolve_fuzzy(left, known.where("name not like 'http%'"), least, tie="pos").join(known, "name").select(F.col("ask").alias("exact"), F.col("id").alias("fuzzy_id"))
    rows = rows.join(url, "exact", "left").join(near, "exact", "left")
    ladder = ["exact", "paren", "bare", "url", "fuzzy"]
    step = F.coalesce(*[F.when(F.col(f"{s}_id").isNotNull(), F.lit(s)) for s in ladder])
    return rows.select("ask", step.alias("step"), F.coalesce(*[F.col(f"{s}_id") for s in ladder]).alias("id"))


def resolve_files(proposed: DataFrame, files: DataFrame) -> DataFrame:
    """(req, file, confidence) of proposals (req, path, confidence, ord): unknown paths go, the last proposal wins."""
    rows = proposed.select("req", strip(F.col("path")).alias("file"), clamp(F.col("confidence")).alias("confidence"), "ord")
    met = rows.join(files.select(F.col("path").alias("file")), "file", "left_semi")
    return met.groupBy("req", "file").agg(F.max_by("confidence", "ord").alias("confidence"))
