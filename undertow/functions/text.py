"""Column functions over urls and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from undertow.functions.fold import let


# Schemes whose urls always have a host, with their default ports.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}


def _encoded(text: Column, keep: str) -> Column:
    """With the characters outside of a class as the percent-encoded bytes of their UTF-8 form."""
    one = lambda c: F.when(c.rlike(f"^[{keep}]"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    every = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s)[{keep}]++|."), F.lit(0)), one), "")
    return F.when(text.rlike(f"(?s)^[{keep}]*+$"), text).otherwise(every)


def _folded(segments: Column) -> Column:
    """Of a path's segments, without . and with each .. taking away the one before it; at the end they leave a slash."""
    up, here, size = r"(?i)^(?:\.|%2e){2}$", r"(?i)^(?:\.|%2e)$", F.size(segments)
    placed = F.transform(segments, lambda s, i: F.struct(s.alias("s"), (i == size - 1).alias("last")))

    def step(kept: Column, x: Column) -> Column:
        end = F.when(x["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(x["s"].rlike(up), F.concat(shorter, end)).when(x["s"].rlike(here), F.concat(kept, end)).otherwise(F.concat(kept, F.array(x["s"])))

    return F.aggregate(placed, F.array().cast("array<string>"), step)


def url_parts(url: Column) -> Column:
    """struct<origin, href, path> by the URL standard; null where there is no host or it or the port is malformed.

    For http, https, ws, wss and ftp: white space around goes, and so do tabs and line ends; backslashes are slashes up to the
    query; scheme and host become lower case, default ports go; dot segments are folded; what the standard encodes in paths
    and queries is encoded (spaces, quotes, angle brackets, braces, letters beyond ASCII; square brackets are not).
    href has user and query and no fragment; origin has neither user nor path. Other schemes with a host keep their case and
    path. Not done: names beyond ASCII in hosts, and numbers that stand for addresses.
    """
    raw = F.regexp_replace(F.translate(url, "\t\n\r", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    scheme = F.lower(F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(raw, r"^[^:]*:", ""), r"(?s)#.*$", "")
    cut = F.struct(scheme.alias("scheme"), scheme.isin(*PORTS).alias("special"), F.regexp_extract(rest, r"^[^?]*", 0).alias("head"), F.regexp_extract(rest, r"(?s)\?.*$", 0).alias("query"))

    def split(c: Column) -> Column:
        body = F.when(c["special"], F.regexp_replace(F.translate(c["head"], "\\", "/"), "^/+", "")).when(c["head"].startswith("//"), F.substring(c["head"], 3, 1 << 30))
        return let(body, lambda x: F.struct(c.alias("c"), F.regexp_extract(x, "^[^/]*", 0).alias("who"), F.regexp_replace(x, "^[^/]*", "").alias("path")))

    def named(s: Column) -> Column:
        form = r"^(\[[0-9A-Fa-f:.]+\]|[^:]*)(?::0*(\d*))?$"
        at = F.regexp_replace(s["who"], "(?s)^.*@", "")
        host, port = F.regexp_extract(at, form, 1), F.regexp_extract(at, form, 2)
        user = F.regexp_replace(F.replace(F.regexp_extract(s["who"], "(?s)^(.*)@", 1), F.lit("@"), F.lit("%40")), ":$", "")
        fine = at.rlike(form) & (host != "") & ~host.rlike(r'^[^\[].*[\x00-\x20"#%/<>?@\\^`{|}\[\]]|^[\x00-\x20"%<>^`{|}]') & (F.length(port) <= 5)
        kept = F.when((port == "") | F.create_map(*[F.lit(str(x)) for kv in PORTS.items() for x in kv])[s["c"]["scheme"]].eqNullSafe(port), F.lit("")).otherwise(F.concat(F.lit(":"), port))
        name = F.when(s["c"]["special"], F.lower(host)).otherwise(host)
        return F.when(fine & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535), F.struct(s["c"].alias("c"), s["path"].alias("path"), F.concat(name, kept).alias("host"), F.when(user == "", "").otherwise(F.concat(user, F.lit("@"))).alias("user")))

    def whole(n: Column) -> Column:
        c = n["c"]
        folded = F.concat(F.lit("/"), F.array_join(_folded(F.split(F.substring(n["path"], 2, 1 << 30), "/")), "/"))
        path = F.when(c["special"], _encoded(folded, r"\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7a\x7c\x7e")).when(n["path"] == "", "/").otherwise(n["path"])
        query = F.when(c["special"], _encoded(c["query"], r"\x21\x24-\x26\x28-\x3b\x3d\x3f-\x7e")).otherwise(c["query"])
        start = F.concat(c["scheme"], F.lit("://"))
        return let(path, lambda p: F.when(n.isNotNull(), F.struct(F.concat(start, n["host"]).alias("origin"), F.concat(start, n["user"], n["host"], p, query).alias("href"), p.alias("path"))))

    return let(let(let(cut, split), named), whole)


def origin(url: Column) -> Column:
    """Scheme, host and port; null where the url has none."""
    return url_parts(url)["origin"]


def path(url: Column) -> Column:
    return url_parts(url)["path"]


def normalize_url(url: Column) -> Column:
    """The whole url by the standard, without fragment and without one closing slash, except on a bare origin; null where it
    is malformed."""
    cut = lambda u: F.when(u["href"].endswith("/") & (F.length(u["href"]) > F.length(u["origin"]) + 1), F.regexp_replace(u["href"], "/$", "")).otherwise(u["href"])
    return let(url_parts(url), cut)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sections(text: Column) -> Column:
    """Array of (heading, body) by headings of one to six #; without headings one section called Document. What stands
    before the first heading goes, and so do sections without a body."""
    pieces = F.filter(F.split(text, r"(?m)(?=^#{1,6}\s)"), lambda p: p.rlike(r"^#{1,6}\s+"))
    part = F.transform(pieces, lambda p: F.struct(strip(F.regexp_extract(p, r"^#{1,6}\s+(.*)", 1)).alias("heading"), strip(F.regexp_replace(p, r"^#{1,6}\s+.*", "")).alias("body")))
    whole = F.array(F.struct(F.lit("Document").alias("heading"), strip(text).alias("body")))
    return F.when(F.size(pieces) == 0, whole).otherwise(F.filter(part, lambda x: x["body"] != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of different items; 1 where both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def screen_id(url: Column) -> Column:
    return F.left(F.sha1(url), F.lit(12))


def words(text: Column, longer_than: int) -> Column:
    """Different lower-case words of letters and digits beyond a length."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > longer_than))


def compact(text: Column, head: int = 300, mark: str = "… [compacted]") -> Column:
    """Long texts cut to a head and a mark; texts that end in the mark stay, so that a second pass changes nothing."""
    short = F.concat(F.regexp_replace(F.left(text, F.lit(head)), r"\s+$", ""), F.lit(mark))
    return F.when((F.length(text) <= head) | text.endswith(mark), text).otherwise(short)


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.75, "high").when(confidence >= 0.5, "medium").otherwise("low")


def origin_of(base: Column, href: Column) -> Column:
    """The origin that a link leads to from a page: the page's own where the href is a path; null where it has none."""
    return F.when(href.rlike("^/(?!/)"), origin(base)).otherwise(origin(href))


def vocabulary(path: Column) -> Column:
    """Different words beyond three characters of a path, cut at slashes, backslashes and brackets too."""
    return words(F.regexp_replace(path, r"[/\\\[\]]", " "), 3)


def label(given: Column, title: Column, url: Column) -> Column:
    """The first of label, title and url that is not empty."""
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(title, F.lit("")), url)


def snapshot_refs(text: Column) -> Column:
    """Array of (ref, url) of the marks [ref=e1] and [ref=e1, url=...]; the url is null where there is none."""
    rx = F.lit(r"\[ref=(\w+)(?:, url=([^\],\s]+))?\]")
    both = F.arrays_zip(F.regexp_extract_all(text, rx, F.lit(1)).alias("ref"), F.regexp_extract_all(text, rx, F.lit(2)).alias("url"))
    return F.transform(both, lambda x: F.struct(x["ref"].alias("ref"), F.nullif(x["url"], F.lit("")).alias("url")))


def changed_path(line: Column) -> Column:
    """The path that a report's line names as changed; null for other lines."""
    return F.nullif(F.regexp_extract(line, r"^- (.+?) \((?:modified|added|renamed|removed)", 1), F.lit(""))


def titled(req_id: Column, title: Column) -> Column:
    return F.concat(F.lit("**"), req_id, F.lit("** "), title)


def screen_line(name: Column, url: Column) -> Column:
    return F.concat(name, F.lit(" — `"), url, F.lit("`"))


def extract_json(text: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
