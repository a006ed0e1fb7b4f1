"""Discovery order of a crawl, collated order, and urls by the standard."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from undertow.functions import text as X
from undertow.operators import code
from undertow.plans.crawl import bfs_crawl
from undertow.plans.numbering import collated


def queue(start, links, budget):
    seen, waiting, out = set(), deque((s, 0) for s in start), []
    while waiting and len(out) < budget:
        node, depth = waiting.popleft()
        if node not in seen:
            seen.add(node)
            out.append((node, depth, len(out) + 1))
            waiting += [(d, depth + 1) for _, d in sorted((o, d) for s, d, o in links if s == node)]
    return out


@pytest.mark.parametrize("budget", [1, 4, 6, 100])
def test_discovery_order(spark, budget):
    links = [(0, 9, 1), (0, 1, 2), (0, 5, 3), (9, 2, 2), (9, 8, 1), (1, 7, 1), (7, 0, 1), (8, 3, 5), (2, 4, 1), (5, 6, 1), (6, 6, 1), (1, 8, 0), (0, 9, 7)]
    df = spark.createDataFrame([*links, (None, 1, 1), (1, None, 0)], "src long, dst long, ord int")
    start = spark.createDataFrame([(0, 2), (20, 1), (None, 0)], "node long, ord int")
    assert sorted(map(tuple, bfs_crawl(start, df, budget).collect()), key=lambda r: r[2]) == queue([20, 0], links, budget)


def test_collated(spark):
    words = ["b", "B", "a", "A", "ä", "aa", "", "Z", "é", "e", "10", "9", "a"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").repartition(3)
    got = [r.w for r in collated(rows, "w").orderBy("place").collect()]
    assert got == ["", "10", "9", "a", "a", "A", "ä", "aa", "b", "B", "e", "é", "Z"]
    files = code.code_model(spark.createDataFrame([("b.ts", ""), ("B.ts", ""), ("a.ts", ""), ("A.ts", "")], "path string, source string"))["files"]
    assert [r.path for r in files.orderBy("place").collect()] == ["a.ts", "A.ts", "b.ts", "B.ts"]


URLS = {
    "http://a/b/../c d": ("http://a", "/c%20d", "http://a/c%20d"), "https://u@h/[x]": ("https://h", "/[x]", "https://u@h/[x]"), "HTTP://EXAMPLE.com:80": ("http://example.com", "/", "http://example.com/"),
    "https://ex.com:443/a/./b/": ("https://ex.com", "/a/b/", "https://ex.com/a/b/"), "http:\\\\h\\p\\q?x\\y#z": ("http://h", "/p/q", "http://h/p/q?x\\y"), "https://h/a/%2e%2E/b": ("https://h", "/b", "https://h/b"),
    "https://h/a/..": ("https://h", "/", "https://h/"), "https://h/.": ("https://h", "/", "https://h/"), "https://h//a//": ("https://h", "//a//", "https://h//a//"),
    "https://h/é?q=é 'x'#f": ("https://h", "/%C3%A9", "https://h/%C3%A9?q=%C3%A9%20%27x%27"), "https://h/`{}\"<>|😀": ("https://h", "/%60%7B%7D%22%3C%3E|%F0%9F%98%80", "https://h/%60%7B%7D%22%3C%3E|%F0%9F%98%80"),
    "https://user:pw@h:8443/x/?q=1/": ("https://h:8443", "/x/", "https://user:pw@h:8443/x/?q=1/"), "http:/h/p": ("http://h", "/p", "http://h/p"), "http:h/p": ("http://h", "/p", "http://h/p"),
    "https://h:99999/": None, "https://h:/x": ("https://h", "/x", "https://h/x"), "https:///x": ("https://x", "/", "https://x/"), "https://a b/": None, "nothing": None, "": None, "/x": None,
    "ftp://F.org:21/x": ("ftp://f.org", "/x", "ftp://f.org/x"), "https://h?q": ("https://h", "/", "https://h/?q"), "  https://h/x  ": ("https://h", "/x", "https://h/x"), "https://h/a\tb\nc": ("https://h", "/abc", "https://h/abc"),
    "https://h/a;b=c,d@e:f!$&*+~": ("https://h", "/a;b=c,d@e:f!$&*+~", "https://h/a;b=c,d@e:f!$&*+~"), "https://h/%zz%41": ("https://h", "/%zz%41", "https://h/%zz%41"), "https://h/x/?": ("https://h", "/x/", "https://h/x/?"),
    "https://a@b@c/x": ("https://c", "/x", "https://a%40b@c/x"), "https://h/..//../x": ("https://h", "/x", "https://h/x"), "wss://h:443/s": ("wss://h", "/s", "wss://h/s"), "https://h/a\\..\\b": ("https://h", "/b", "https://h/b"),
    "http://[::1]:8080/x": ("http://[::1]:8080", "/x", "http://[::1]:8080/x"), "http://h:x/": None, "https://": None, "mailto:a@b": None,
}


def test_url_standard(spark):
    df = spark.createDataFrame([(u,) for u in [*URLS, None]], "u string").select("u", X.url_parts(F.col("u")).alias("p"), X.normalize_url(F.col("u")).alias("n"))
    got = {r.u: r for r in df.collect()}
    assert {u: r.p and (r.p.origin, r.p.path, r.p.href) for u, r in got.items()} == URLS | {None: None}
    assert got["https://h//a//"].n == "https://h//a/" and got["https://h/a/.."].n == "https://h/" and got["https://user:pw@h:8443/x/?q=1/"].n == "https://user:pw@h:8443/x/?q=1" and got["https://u@h/[x]"].n == "https://u@h/[x]"
