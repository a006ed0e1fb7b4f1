"""Small cases of the resolver, code facts, sections, numbering, crawl, run documents and the report."""

import json

import duckdb
from pyspark.sql import functions as F

from undertow.functions import text as X
from undertow.operators import code, report, resolve
from undertow.plans.crawl import bfs_crawl
from undertow.plans.numbering import numbered
from undertow.queries import ORACLE_SQL, QUERIES
from undertow.sources import artifacts


def test_cascade(spark):
    names = spark.createDataFrame([("Home", "s1", 0), ("https://acme.store/", "s1", 1), ("Product Page", "s2", 2), ("https://acme.store/product/abc", "s2", 3), (" ", "s9", 4)], "name string, id string, ord int")
    want = {
        " Product Page ": ("exact", "s2"), "Product Page (https://acme.store/product/abc)": ("paren", "s2"), "Product Page (new)": ("bare", "s2"),
        "visit https://acme.store/product/abc now": ("url", "s2"), "The Product Page": ("fuzzy", "s2"), "Nowhere at all": (None, None), "": (None, None),
    }
    asked = spark.createDataFrame([(a,) for a in want], "ask string")
    assert {r.ask: (r.step, r.id) for r in resolve.resolve_cascade(asked, names).collect()} == want
    assert {r.id for r in resolve.resolve_cascade(asked, names.where("false")).collect()} == {None}


def test_cascade_query_on_pages_with_one_url(spark, tmp_path):
    """Its SQL leaves open which of several pages with one url is named; the query names the last. All else is equal."""
    parts = [(k, f"{('red', 'blue')[k % 2]} part", "b", "t", 1, 1.0) for k in range(24)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k, f"https://a.test/{k % 6}", "") for k in range(30)], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.p_partkey: (r.step, r.id) for r in QUERIES["resolve_cascade"](spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k % 6 == 3} == {k: ("url", "page27") for k in (3, 9, 15, 21, 27)}
    c = duckdb.connect()
    for t in ("part", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows = c.execute("SELECT p_partkey, step, id FROM (" + ORACLE_SQL["resolve_cascade"] + ")").fetchall()
    same_url = lambda found: (found[0], int(found[1][4:]) % 6) if found[0] == "url" else found
    assert {k: same_url((step, i)) for k, step, i in rows} == {k: same_url(v) for k, v in got.items()}


def test_files_are_clamped_and_listed(spark):
    asked = spark.createDataFrame([("R1", " a.ts ", 1.7, 0), ("R2", "a.ts", -2.0, 0), ("R3", "a.ts", None, 0), ("R1", "b.ts", 0.5, 1), ("R4", "a.ts", 0.1, 0), ("R4", "a.ts", 0.9, 1)], "req string, path string, confidence double, ord int")
    got = resolve.resolve_files(asked, spark.createDataFrame([("a.ts",)], "path string"))
    assert {r.req: r.confidence for r in got.collect()} == {"R1": 1.0, "R2": 0.0, "R3": 0.5, "R4": 0.9}


SOURCES = {
    "app/page.tsx": "import Card, { helper as help } from '../lib/card';\nimport * as util from 'lib/util';\nimport 'react';\nexport default function Page() {\n  help(1);\n  fetch('x');\n  local();\n  return <Card><div/></Card>;\n}\nconst local = () => 1;\n",
    "lib/card.tsx": "import { run } from './util';\nexport class Card {\n  render() {\n    run();\n    return null;\n  }\n}\nexport const helper = async (a) => a;\nexport function help() {}\n",
    "lib/util/index.ts": "export function run() {}\n",
    "README.md": "function no() {}",
}


def test_code_model(spark):
    model = code.code_model(spark.createDataFrame(list(SOURCES.items()), "path string, source string"))
    assert {(r.file, r.name, r.kind, r.line, r.exported) for r in model["symbols"].collect()} == {
        ("app/page.tsx", "Page", "function", 4, True), ("app/page.tsx", "local", "function", 10, False), ("lib/card.tsx", "Card", "class", 2, True), ("lib/card.tsx", "render", "method", 3, False),
        ("lib/card.tsx", "helper", "function", 8, True), ("lib/card.tsx", "help", "function", 9, True), ("lib/util/index.ts", "run", "function", 1, True),
    }
    assert {tuple(r) for r in model["imports"].select("from_file", "to_file", "imported_name").collect()} == {("app/page.tsx", "lib/card.tsx", "Card,help"), ("app/page.tsx", "lib/util/index.ts", "util"), ("lib/card.tsx", "lib/util/index.ts", "run")}
    assert {tuple(r) for r in model["edges"].select("kind", "name", "from_file", "to_file").collect()} >= {("render", "Card", "app/page.tsx", "lib/card.tsx"), ("call", "help", "app/page.tsx", "lib/card.tsx"), ("call", "local", "app/page.tsx", "app/page.tsx"), ("call", "run", "lib/card.tsx", "lib/util/index.ts")}
    assert not model["edges"].where("name in ('fetch', 'div')").count()


def test_normal_path(spark):
    cases = {"a/./b/../c.ts": "a/c.ts", "../x": "../x", "a/../../b": "../b", "a//b/": "a/b", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", code.normal_path(F.col("p")).alias("n"))
    assert {r.p: r.n for r in df.collect()} == cases


def test_sections(spark):
    cases = ["no heading ", "before\n# A\nbody a\n## Empty\n### B \n body b\n\nmore\n", "#not a heading", ""]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", X.sections(F.col("t")).alias("s"))
    assert {r.i: [tuple(x) for x in r.s] for r in df.collect()} == {0: [("Document", "no heading")], 1: [("A", "body a"), ("B", "body b\n\nmore")], 2: [("Document", "#not a heading")], 3: [("Document", "")]}


def test_numbers_and_crawl(spark):
    rows = numbered(spark.range(0, 1000, numPartitions=7).select((F.col("id") * 37 % 1000).alias("k")), ["k"])
    assert all(r.number == r.k + 1 for r in rows.collect())
    assert not numbered(spark.range(0), ["id"]).count()
    links = spark.createDataFrame([(0, 2), (0, 1), (1, 3), (3, 0), (2, 4), (4, 5)], "src long, dst long")
    got = bfs_crawl(spark.createDataFrame([(0,)], "node long"), links, 4).orderBy("place").collect()
    assert [(r.node, r.depth) for r in got] == [(0, 0), (1, 1), (2, 1), (3, 2)]


def test_run_documents(spark, tmp_path):
    (tmp_path / "crawl").mkdir()
    screen = {"screenId": "s1", "url": "u", "title": "t", "elements": [], "visited": True}
    (tmp_path / "crawl/manifest.json").write_text(json.dumps({"baseUrl": "u", "screens": [screen], "transitions": [{"fromUrl": "a", "toUrl": "b"}, {"fromUrl": "b", "toUrl": "a"}]}, indent=1))
    (tmp_path / "requirements.json").write_text(json.dumps({"source": "x", "requirements": [{"reqId": "R1", "title": "T"}]}))
    symbol = {"name": "f", "kind": "function", "filePath": "a.ts", "line": 1, "exported": True}
    (tmp_path / "code.json").write_text(json.dumps({"fullName": "o/r", "files": [{"path": "a.ts", "loc": 3, "symbols": [symbol]}], "imports": [], "renders": [], "calls": []}))
    run = artifacts.load_run(spark, str(tmp_path))
    assert {k: v.count() for k, v in run.items()} == {"screens": 1, "transitions": 2, "requirements": 1, "files": 1, "imports": 0, "renders": 0, "calls": 0, "symbols": 1}
    refs = {"e10": {"name": "Go", "role": "link"}, "e2": {"name": "Go", "role": "link"}, "e3": {"name": " ", "role": "link"}}
    (tmp_path / "a.snapshot.json").write_text(json.dumps({"url": "u", "title": "t", "text": "x", "refs": refs}, indent=1))
    assert [r.ref for r in artifacts.elements(artifacts.snapshots(spark, str(tmp_path))).collect()] == ["e2"]
    for at, body in {"src/a.ts": "x", "node_modules/b.ts": "x", "src/c.css": "x", "src/big.ts": "y" * 100}.items():
        (tmp_path / "tree" / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / at).write_text(body)
    assert [tuple(r) for r in artifacts.source_tree(spark, str(tmp_path / "tree"), 50).collect()] == [("src/a.ts", "x")]
    (tmp_path / "files.json").write_text(json.dumps([{"filename": "a.ts", "status": "added", "additions": 1, "deletions": 0}]))
    assert artifacts.changed_files(spark, str(tmp_path / "files.json")).first().patch == ""


def test_report_text(spark, tmp_path):
    none = spark.createDataFrame([], "x string")
    report.write([report.bullets(none, "Screens at risk", F.col("x")), report.bullets(spark.createDataFrame([("b",), ("a",)], "x string"), "Risk areas", F.col("x"))], str(tmp_path / "r"))
    lines = [r.value for f in sorted((tmp_path / "r").glob("part-*")) for r in spark.read.text(str(f)).collect()]
    assert lines[:4] == ["# Impact report", "## Summary", "## Screens at risk", "_none_"] and lines[lines.index("## Risk areas") + 1 :][:2] == ["- a", "- b"]
