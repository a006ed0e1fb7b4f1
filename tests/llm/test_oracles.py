"""Operators that SQL can express give the rows that DuckDB gives."""

import duckdb
import pytest

from undertow.llm import url_filter
from undertow.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = c.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in got.description)
    want = sorted(map(repr, got.df()[names].astype(object).where(lambda x: x.notna(), None).values.tolist()))
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(repr(list(r)) for r in df.select(names).collect()) == want


def test_many_path_lengths(spark):
    """Beyond the literal number of path lengths every rule still counts."""
    n = url_filter.MOST_LENGTHS + 50
    rules = spark.createDataFrame([("block", "a.com", "/" + "x" * i + "/") for i in range(n)], "action string, host string, path string")
    pages = spark.createDataFrame([(i, "http://b.a.com/" + "x" * i + "/end") for i in range(0, n, 30)] + [(n, "http://a.com/y")], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: "a.com/" + "x" * i + "/" for i in range(0, n, 30)} | {n: None}


def test_hits_beyond_a_broadcast(spark, monkeypatch):
    """Rows meet their verdicts alike where these are shuffled, those without a host and with clashing names included."""
    rules = spark.createDataFrame([("block", "b.c", "/x"), ("allow", "c", "/xy"), ("block", "a.b.c", "")], "action string, host string, path string")
    long = ".".join(f"l{i}" for i in range(3000))
    urls = [None, "", "http://c/xyz", "http://b.c/x", "http://z.a.b.c/xyz", f"http://{long}.b.c/x", f"http://{long}/x", "http://b.c/" + "x" * 200_000, "http://.c/xy", "http://c./xy"] * 3
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, _salt string").repartition(5)
    want = [None, None, "c/xy", "b.c/x", "a.b.c", "b.c/x", None, "b.c/x", "c/xy", None] * 3
    for most in (url_filter.MOST_HITS, -1):
        monkeypatch.setattr(url_filter, "MOST_HITS", most)
        got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
        assert [got[i].rule for i in range(len(urls))] == want and {r._salt for r in got.values()} == {"mine"} and len(got) == len(urls)


def test_many_numbers_of_labels(spark):
    """Beyond the literal number of label counts every rule still counts."""
    n = url_filter.MOST_LENGTHS + 20
    host = lambda i: "x." * i + "com"
    rules = spark.createDataFrame([("block", f"r{i}." + host(i), "/") for i in range(n)], "action string, host string, path string")
    pages = spark.createDataFrame([(i, f"http://sub.r{i}.{host(i)}/p") for i in range(0, n, 20)] + [(n, f"http://r1.{host(2)}/")], "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.judge(pages, rules).collect()}
    assert got == {i: f"r{i}.{host(i)}/" for i in range(0, n, 20)} | {n: None}


def test_scratch_blocks(spark):
    """A block's tables go at its end; kept ones pass to the block around it, and threads have blocks of their own."""
    from threading import Thread

    from undertow.llm.shared import _written, materialise, scratch

    one = lambda: materialise(spark.range(3))
    other = []
    with scratch() as outer:
        with scratch() as inner:
            gone, kept = one(), inner.keep(one())
            beside = Thread(target=lambda: other.append(one()))
            beside.start()
            beside.join()
        assert id(gone) not in _written and kept.count() == 3
        last = outer.keep(one())
    assert id(kept) not in _written and last.count() == 3 and other[0].count() == 3
