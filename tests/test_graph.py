"""The graph of a run, resolved mappings, the engine, reports, narratives and evaluation on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from undertow.functions import model_output
from undertow.functions import text as X
from undertow.operators import code, evaluate, graph, mappings, narrative, report, resolve
from undertow.operators.engine import Engine
from undertow.plans.closure import upstream_of_others, upstream_of_others_sql, upstream_sql
from undertow.sources import artifacts

NS = "acme/shop"
SCREENS = "screen_id string, seq int, url string, title string, label string"
PROPOSED = "req_id string, ord int, screens array<struct<name:string,confidence:double>>, files array<struct<path:string,confidence:double>>"


@pytest.fixture(scope="module")
def shop(spark):
    screens = spark.createDataFrame([("s1", 0, "https://shop.test/", "Home", "Home"), ("s2", 1, "https://shop.test/item/x1", "Item Page", "Item Page")], SCREENS)
    reqs = spark.createDataFrame([("R1",), ("R2",)], "req_id string")
    files = spark.createDataFrame([("app/item/[slug]/page.tsx",), ("app/basket/page.tsx",)], "path string")

    def resolved(*proposals):
        rows = [(r, i, s, f) for i, (r, s, f) in enumerate(proposals)]
        got = mappings.resolve_mappings(reqs, screens, spark.createDataFrame(rows, PROPOSED), files)
        return {k: sorted(tuple(x) for x in v.collect()) for k, v in got.items()}

    return resolved


def test_exact_names_and_paths_stay(shop):
    got = shop(("R1", [("Item Page", 0.9)], [("app/item/[slug]/page.tsx", 0.8)]))
    assert got == {"covered_by": [("R1", "s2", 0.9)], "implemented_by": [("R1", "app/item/[slug]/page.tsx", 0.8)], "gaps": [("R2",)]}


def test_unknown_names_and_paths_go(shop):
    got = shop(("R1", [("Some Invented View", 0.9)], [("no/such/file.tsx", 0.8)]), ("R9", [("Home", 1.0)], []))
    assert got == {"covered_by": [], "implemented_by": [], "gaps": [("R1",), ("R2",)]}


def test_echoes_urls_in_text_and_common_words(shop):
    got = shop(("R1", [("Item Page (https://shop.test/item/x1)", 0.9)], []), ("R2", [("open https://shop.test/item/x1 first", 0.7)], []))
    assert got["covered_by"] == [("R1", "s2", 0.9), ("R2", "s2", 0.7)] and got["gaps"] == []
    assert shop(("R1", [("The Item Page", 0.9)], []))["covered_by"] == [("R1", "s2", 0.9)]


def test_confidences_are_clamped_and_the_last_counts(shop):
    got = shop(("R1", [("Home", 0.2)], []), ("R1", [("Item Page", 1.7), ("Home", -2.0), ("Home", None)], []))
    assert got["covered_by"] == [("R1", "s1", 0.5), ("R1", "s2", 1.0)]
    assert shop() == {"covered_by": [], "implemented_by": [], "gaps": [("R1",), ("R2",)]}


def test_routes(spark):
    files = ["app/item/[slug]/page.tsx", "app/basket/page.tsx", "app/[page]/page.tsx", "app/find/page.tsx", "app/(shop)/x/page.tsx", "app/layout.tsx", "app/item/[slug]/page.test.ts", "lib/utils.ts", "app/[a]/[b]/[c]/page.js"]
    table = resolve.route_table(spark.createDataFrame([(f,) for f in files], "path string"))
    assert {r.pattern for r in table.collect()} == {"/item/[slug]", "/basket", "/[page]", "/find", "/(shop)/x", "/[a]/[b]/[c]"}
    want = {"/item/abc": files[0], "/basket": files[1], "/find": files[3], "/about": files[2], "/basket/extra": None, "/": None, "/none/at": None, "/q/r/s": files[8], "/(shop)/x": files[4], "/item/abc/": files[0]}
    got = resolve.resolve_routes(spark.createDataFrame([(p,) for p in want], "url_path string"), table)
    assert {r.url_path: r.path for r in got.collect()} == want
    path = X.path(F.lit("https://x.test/item/abc?tab=1#top"))
    assert spark.range(1).select(path).first()[0] == "/item/abc"


def test_a_seed_is_upstream_of_another_seed_only(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "a"), ("d", "d"), ("d", "e"), ("e", "d"), ("x", "y")], "src string, dst string")
    for closure in (upstream_of_others, upstream_of_others_sql):
        up = lambda *s: {r.node for r in closure(spark.createDataFrame([(x,) for x in s], "node string"), edges, 6).collect()}  # noqa: B023, E731
        assert up("a") == {"b", "c"}
        assert up("a", "b") == {"b", "c"}
        assert up("d") == {"e"}
        assert up("d", "e") == {"d", "e"}
        assert up("zzz") == set()


def test_recursive_plans_are_whole_beyond_the_row_limit(spark):
    """Seven layers of twelve nodes, each of which depends on all of the layer below: 12**7 paths to the last, 84 nodes."""
    layers = [[f"n{level}_{i}" for i in range(12)] for level in range(7)]
    edges = spark.createDataFrame([(a, b) for below, above in zip(layers, layers[1:]) for a in above for b in below], "src string, dst string")
    seeds = spark.createDataFrame([(x,) for x in layers[0]], "node string")
    for limit in (None, "10"):
        if limit:
            spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
        try:
            assert {tuple(r) for r in upstream_sql(spark, seeds, edges).collect()} == {(x, level) for level, layer in enumerate(layers) for x in layer}
            assert sorted(r.node for r in upstream_of_others_sql(seeds, edges).collect()) == sorted(x for layer in layers[1:] for x in layer)
        finally:
            spark.conf.unset("spark.sql.cteRecursionRowLimit")


SOURCES = {
    "app/item/[slug]/page.tsx": "import Card from '../../../lib/card';\nimport { money } from '../../../lib/money';\nexport default function Page() {\n  money(1);\n  return <Card/>;\n}\n",
    "app/basket/page.tsx": "import { money } from '../../lib/money';\nexport default function Basket() {\n  return money(2);\n}\n",
    "lib/card.tsx": "import { money } from './money';\nexport default function Card() {\n  const one: Promise<Money> = null;\n  return <p>{money(3)}</p>;\n}\nexport function unused() {\n  return 1;\n}\n",
    "lib/money.ts": "export function money(n) {\n  return n;\n}\nexport const other = () => money(4);\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """The graph as later stages see it: written and read again."""
    model = code.code_model(spark.createDataFrame(list(SOURCES.items()), "path string, source string"))
    run = code.as_run(model)
    run["screens"] = spark.createDataFrame([(0, "s1", "https://shop.test/item/x1", "Item", ""), (1, "s2", "https://shop.test/basket", "Basket", "The basket"), (2, "s3", "https://shop.test/", "Home", "Home")], "seq int, screenId string, url string, title string, label string").withColumn("purpose", F.lit(""))
    run["transitions"] = spark.createDataFrame([("https://shop.test/item/x1", "https://shop.test/basket"), ("https://shop.test/item/x1", "https://shop.test/basket"), ("https://shop.test/", "https://shop.test/item/x1"), ("https://shop.test/", "https://shop.test/"), ("https://shop.test/", "https://shop.test/none")], "fromUrl string, toUrl string")
    rows = [(i, f"R{i}", f"title {i}", "", "", "high", "s") for i in (1, 2, 3)] + [(4, "", "no id", "", "", "low", "s")]
    run["requirements"] = spark.createDataFrame(rows, "seq int, reqId string, title string, userAction string, expectedOutcome string, priority string, sourceAnchor string")
    proposals = spark.createDataFrame([("R1", 0, [("Item", 0.9)], [("lib/card.tsx", None)]), ("R2", 0, [("The basket", 0.6), ("Home", 0.4)], [])], PROPOSED)
    folder = str(tmp_path_factory.mktemp("graph"))
    graph.save(graph.build(run, NS, proposals), folder, NS)
    return graph.load(spark, folder, NS)


def rows(df, *cols):
    return {tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()}


def test_graph_of_a_run(built):
    short = lambda df: {(r.src.removeprefix(NS), r.dst.removeprefix(NS)) for r in df.select("src", "dst").collect()}
    assert short(built["renders"]) == {(":app/item/[slug]/page.tsx::Page", ":lib/card.tsx::Card")}
    assert short(built["calls"]) == {(":app/item/[slug]/page.tsx::Page", ":lib/money.ts::money"), (":app/basket/page.tsx::Basket", ":lib/money.ts::money"), (":lib/card.tsx::Card", ":lib/money.ts::money"), (":lib/money.ts::other", ":lib/money.ts::money")}
    assert short(built["navigates_to"]) == {("::screen::s1", "::screen::s2"), ("::screen::s3", "::screen::s1")}
    assert short(built["rendered_by"]) == {("::screen::s1", ":app/item/[slug]/page.tsx"), ("::screen::s2", ":app/basket/page.tsx")}
    assert rows(built["gaps"], "key") == {f"{NS}::req::R3::gap"}
    one = evaluate.invariants(built).first()
    assert one.ok and (one.requirements, one.covered, one.gaps, one.cover_edges, one.impl_edges) == (3, 2, 1, 3, 1)
    stats = graph.layer_stats(built).first()
    assert (stats.files, stats.symbols, stats.screens, stats.transitions, stats.render_edges, stats.call_edges, stats.uncovered) == (4, 6, 3, 2, 1, 4, 1)


@pytest.mark.parametrize("plan", ["loop", "sql"])
def test_impact_of_a_run(spark, built, plan):
    engine = Engine(built, plan)
    changed = lambda *p: engine.impact(spark.createDataFrame([(x,) for x in p], "path string"))
    i = changed("lib/card.tsx", "no/such.ts")
    assert rows(i.files, "path") == {"lib/card.tsx", "app/item/[slug]/page.tsx"} and rows(i.changed, "path") == {"lib/card.tsx"}
    assert rows(i.symbols, "name") == {"Card", "unused"} and rows(i.upstream_symbols, "name") == {"Page"}
    assert rows(i.screens, "url", "label") == {("https://shop.test/item/x1", "Item")}
    assert rows(i.flows, "from_label", "to_label") == {("Item", "The basket"), ("Home", "Item")} and not i.flows_inside.count()
    assert rows(i.requirements, "req_id", "via") == {("R1", "file lib/card.tsx")} and rows(i.losing_coverage, "req_id") == {"R1"} and rows(i.uncovered, "req_id") == {"R3"}
    assert tuple(engine.confidence(i.requirements).first()) == (2, pytest.approx(0.7))
    i = changed("lib/money.ts")
    assert rows(i.files, "path") == set(SOURCES) and rows(i.flows_inside, "from_label") == {"Item"}
    assert rows(i.requirements, "req_id", "via") == {("R1", "file lib/card.tsx"), ("R2", "screen https://shop.test/basket")} and rows(i.losing_coverage, "req_id") == {"R1"}
    none = changed()
    assert not none.files.count() and not none.requirements.count() and tuple(engine.confidence(none.requirements).first()) == (0, 0.0)


def test_namespaces_are_replaced_alone(spark, built, tmp_path):
    folder = str(tmp_path)
    graph.save(built, folder, NS)
    graph.save(built, folder, "acme/other")
    graph.reset(spark, folder, NS)
    assert graph.load(spark, folder, NS)["files"].count() == 0
    assert graph.load(spark, folder, "acme/other")["files"].count() == 4


def test_whole_report(spark, built):
    engine = Engine(built)
    i = engine.impact(spark.createDataFrame([("lib/money.ts",)], "path string"))
    pull = spark.createDataFrame([(7, "Change money", "open", "main", "fix", "0123456789abcdef")], "number int, title string, state string, base_ref string, head_ref string, head_sha string")
    files = spark.createDataFrame([("lib/money.ts", "modified", 3, 1)], "path string, status string, additions int, deletions int")
    layers = spark.createDataFrame([(3, 3, 0)], "requirements int, screens int, files int")
    told = narrative.Answered(spark.createDataFrame([('so: {"summary": " Prices. ", "whatToTest": ["a", "b"], "riskAreas": [], "notes": ["n"]}',)], "answer string"))
    out = report.full(pull, files, i, engine.confidence(i.requirements), told.write(spark, pull, i), layers)
    by = {}
    for r in out.collect():
        by.setdefault(report.TITLES[r.section] if r.section >= 0 else "head", set()).add(r.line)
    assert by["head"] == {"PR #7: **Change money** (open), base main, head fix @ 0123456"}
    assert by["Summary"] == {"Prices."} and by["What to test"] == {"- a", "- b"} and by["Risk areas"] == {"_none_"}
    assert by["Requirements at risk"] == {"- **R1** title 1 — via file lib/card.tsx", "- **R2** title 2 — via screen https://shop.test/basket"}
    assert by["Pre-existing gaps"] == {"- **R3** title 3"} and by["User flows affected"] == {"- Item → The basket"}
    assert "- lib/money.ts (modified, +3/−1)" in by["What changed in code"] and len(by["What changed in code"]) == 5
    assert any("average" in x and "4 cross-layer links" in x for x in by["Confidence"]) and "Notes: n" in by["Confidence"] and any("⚪ Code (0)" in x for x in by["Confidence"])
    bare = narrative.Degraded().write(spark, pull, i).first()
    assert "could not be written" in bare.summary and not bare.notes
    off = {r.line for r in report.offline(pull, files, i, layers).collect() if r.section == report.TITLES.index("Requirements at risk")}
    assert off == {"_not computed in offline mode; requires the connect stage_"}
    kinds = {r.kind for r in narrative.evidence(i).collect()}
    assert kinds == {"file", "symbol", "upstream", "screen", "flow", "at_risk", "losing", "uncovered"}


def test_stability_and_suspicious_words(spark, built):
    runs = spark.createDataFrame([("a", 0, "alpha beta"), ("a", 1, "alpha gamma"), ("b", 0, "only run"), ("c", 0, ""), ("c", 1, "x")], "field string, run int, text string")
    assert {tuple(r) for r in evaluate.stability(runs, ["field"]).collect()} == {("a", 1, 33), ("b", 0, 100), ("c", 1, 100)}
    text = "The Basket shows Mystery items, and mystery Zebra's NASAX Title-1 Customers Mystery! (Wombat) " + " ".join(f"Unknown{i}" for i in range(20))
    got = evaluate.suspicious(spark.createDataFrame([(1, text), (2, "")], "run int, text string"), ["run"], evaluate.known_words(built)).orderBy("place").collect()
    assert [r.word for r in got[:4]] == ["Mystery", "Zebra's", "Title-1", "(Wombat)"] and len(got) == 15 and got[0].mentions == 24


def test_model_answers(spark):
    answer = json.dumps({"requirements": [{"title": " A ", "user_action": " go ", "priority": None}, {"title": ""}, {"description": "no title"}]})
    df = spark.createDataFrame([("h", f"```json {answer} ```"), ("bad", "no json"), ("worse", "{oops}"), ("none", None)], "source_anchor string, answer string")
    assert [tuple(r) for r in model_output.requirements(df).collect()] == [("h", 0, "A", "", "go", "", "medium")]
    props = json.dumps({"mappings": [{"reqId": "R1", "screens": [{"name": "x", "confidence": 0.5}], "files": []}]})
    got = model_output.proposals(spark.createDataFrame([(3, props), (4, "failed")], "ord int, answer string")).collect()
    assert [(r.req_id, len(r.screens), len(r.files)) for r in got] == [("R1", 1, 0)]
    labels = model_output.labels(spark.createDataFrame([("t" * 99, "nothing"), ("t", json.dumps({"label": "L", "key_components": list("abcdefghijkl")}))], "title string, answer string")).collect()
    assert {(r.label, len(r.key_components)) for r in labels} == {("t" * 80, 0), ("L", 10)}


def test_pull_request_and_links(spark, tmp_path):
    (tmp_path / "pr.json").write_text(json.dumps({"number": 5, "title": "T", "body": None, "state": "open", "base": {"ref": "main"}, "head": {"ref": "b", "sha": "abc"}}))
    r = artifacts.pull_request(spark, str(tmp_path / "pr.json")).first()
    assert (r.number, r.title, r.body, r.base_ref, r.head_ref, r.head_sha) == (5, "T", "", "main", "b", "abc")
    html = '<A class="x" href="/a">One <b>two</b>\n three</A><a href="/a">later</a><a href="mailto:x@y">no</a><a href="HTTP://Other.test/">' + "z" * 200 + "</a>"
    got = artifacts.links(spark.createDataFrame([(1, "https://Shop.test:443/p", html)], "page_id int, url string, html string"))
    assert {(r.href, r.text) for r in got.collect()} == {("https://shop.test/a", "One two three"), ("HTTP://Other.test/", "z" * 120)}
    (tmp_path / "README.md").write_text("# A\ntext\n")
    assert artifacts.readme(spark, str(tmp_path / "README.md")).first().text == "# A\ntext\n"
    artifacts.save({"t": spark.range(3)}, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out/t")).count() == 3


def test_evaluation(spark, built):
    told = spark.createDataFrame([(1, "summary", "the Basket breaks Frobnicator"), (2, "summary", "the Basket breaks"), (1, "risks", "same words"), (2, "risks", "same words"), (1, "alone", "x")], "run int, field string, text string")
    got = {r.check: (r.value, r.status) for r in evaluate.evaluation(built, told).collect()}
    assert got == {
        "requirements": ("3", "PASS"), "covered": ("2", None), "gaps": ("1", None), "covered + gaps = requirements": ("3 = 3", "PASS"), "dangling edges": ("0/0/0", "PASS"), "stability: summary": ("67%", None),
        "stability: risks": ("100%", None), "stability: alone": ("100%", None), "suspicious mentions": ("1: frobnicator", None), "verdict": (None, "PASS"),
    }
    broken = dict(built) | {"gaps": built["gaps"].limit(0)}
    rows = evaluate.evaluation(broken, told.limit(0))
    got = {r.check: r.status for r in rows.collect()}
    assert got["verdict"] == got["covered + gaps = requirements"] == "FAIL" and got["dangling edges"] == "PASS"
    assert "| suspicious mentions | none | — |" in {r.line for r in evaluate.evaluation_lines(rows).collect()}
