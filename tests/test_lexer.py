"""The lexer and scopes: comments, strings, templates, regular expressions and JSX text give no facts; blocks tell holders."""

import random

import pytest
from pyspark.sql import functions as F

from undertow.functions.fold import running
from undertow.operators import code, lexer


def places(spark, source, path="a.tsx"):
    rows = code.facts(spark.createDataFrame([(path, source)], "path string, source string")).first().places
    return [(p.kind, p.name, p.line, p.holder) for p in rows]


def names(spark, source, kind="call", path="a.tsx"):
    return [n for k, n, _, _ in places(spark, source, path) if k == kind]


def test_running_fold(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        items = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
        got = spark.range(1).select(running(items, F.lit(0), lambda s, x: s + x, lambda s, x: s * 2, "int", 128).alias("r")).first().r
        assert got == [x * (x - 1) for x in range(1, n + 1)]
    assert spark.range(1).select(running(F.lit(None).cast("array<int>"), F.lit(0), lambda s, x: s + x, lambda s, x: s, "int").alias("r")).first().r is None


@pytest.mark.parametrize(
    "source,calls",
    [
        ("// Foo()\na(); /* bar()\n baz() */ b();", ["a", "b"]),
        ("x('bar()'); y(\"it's no()\"); z('a\\'no()');", ["x", "y", "z"]),
        ("a('open\nb('closed')", ["a", "b"]),
        ("a('goes on\\\n no()'); b()", ["a", "b"]),
        ("t(`no() ${yes(`in ${deep()} it's`)} tail's no()`); u()", ["t", "yes", "deep", "u"]),
        ("t(`\\` \\${no()} $ {no()}`); u()", ["t", "u"]),
        ("const r = /no()[/'\"]/g; a(); const q = 1 / b() / c(); i++ / d()", ["a", "b", "c", "d"]),
        ("if (x) return /no()\\//.test(y); z()", ["z"]),
        ("const r = /ab*/; a('x')", ["a"]),
        ("return <p>it's no() {yes()} more's no()</p>; after()", ["yes", "after"]),
        ("const a = c ? <A b='it()' d={e()}/> : <></>; f()", ["e", "f"]),
        ("return <ul>{xs.map(x => <li key={k(x)}>don't no()</li>)} {a && <b>{y()}</b>}</ul>\nz()", ["k", "y", "z"]),
        ("const f = <T,>(x: T) => a(x); const g = <T extends B>(x: T) => b(x);", ["a", "b"]),
        ("o.no(); o?.no(); new No(); yes<T>(1); function no() {} class A { no() {} }", ["yes"]),
        ("if (a()) { while (b()) c() }", ["a", "b", "c"]),
        ("\\", []), ("'", []), ("`${", []), ("}}})", []), ("<a", []), ("return <a", []),
    ],
)
def test_only_code_calls(spark, source, calls):
    assert names(spark, source) == calls


def test_tags(spark):
    source = "const a = <Card.Body x={<Inner/>}>text <Row/> {b && <Leaf>t</Leaf>}</Card.Body>; let w: Promise<Thing> = q < Small;"
    assert names(spark, source, "render") == ["Card", "Inner", "Row", "Leaf"]
    assert names(spark, source, "render", "a.ts") == []
    assert names(spark, "const x = <Foo>bar('it');\nbaz()", "call", "a.ts") == ["bar", "baz"]


def test_scopes(spark):
    source = "\n".join([
        "export default async function Page({ a, b }: Props) {",  # 1
        "  const inner = (x = first()) => go(x);",
        "  if (a) { held(); }",
        "  function nested() { deepest(); }",
        "  return later();",
        "}",
        "outside();",  # 7
        "export class Kit extends Base {",
        "  run(x: number): Promise<Thing> {",
        "    return [1].map((y) => { each(y); });",
        "  }",
        "  static async go<T>() { other() }",
        "}",
        "export const arrow = async (a, b) =>",  # 14
        "  tail(a);",
        "outside();",
        "const obj = { method() { called() }, plain: outside() };",
        "const two = a => { x() }; outside();",
        "var old = function () { y() }",
        "outside()",
    ])
    got = places(spark, source)
    assert [p for p in got if p[0] not in ("call", "render")] == [
        ("function", "Page", 1, None), ("function", "inner", 2, "Page"), ("function", "nested", 4, "Page"), ("class", "Kit", 8, None), ("method", "run", 9, "Kit"),
        ("method", "go", 12, "Kit"), ("function", "arrow", 14, None), ("method", "method", 17, None), ("function", "two", 18, None), ("function", "old", 19, None),
    ]
    assert [(n, h) for k, n, _, h in got if k == "call"] == [
        ("first", "inner"), ("go", "inner"), ("held", "Page"), ("deepest", "nested"), ("later", "Page"), ("outside", None), ("each", "run"), ("other", "go"), ("tail", "arrow"), ("outside", None),
        ("called", "method"), ("outside", None), ("x", "two"), ("outside", None), ("y", "old"), ("outside", None),
    ]
    symbols = code.symbols(spark.createDataFrame([("a.ts", source + "\nfunction hidden() { const local = () => 1 }\nexport { hidden };")], "path string, source string")).collect()
    assert {s.name for s in symbols if s.exported} == {"Page", "Kit", "arrow"}
    assert [s.name for s in symbols if s.line == 21] == ["local"]  # the last of a line


def test_imports_in_code_only(spark):
    source = "// import A from 'a';\nimport B, { type C, d as e } from './b'; // import F from 'f'\n/*\nimport G from 'g';\n*/\nconst t = `\nimport H from 'h';\n`;\nimport * as I from \"i\";\nimport './j';\n"
    rows = code.imports(spark.createDataFrame([("a.ts", source)], "path string, source string")).collect()
    assert sorted((r.module, tuple(r.names)) for r in rows) == [("./b", ("B", "C", "e")), ("./j", ()), ("i", ("I",))]


def test_blanked_texts_keep_their_shape(spark):
    rng = random.Random(4)
    parts = ["'", '"', "`", "${", "}", "{", "/", "//", "/*", "*/", "\n", "<A", "</A>", ">", "/>", "<>", "\\", "a(", ")", " ", "=", "=>", "return", "x", "[", "]", ";", "\x01", "\x02", "é", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for tags in (True, False):
        for r in df.select("t", lexer.lexed(F.col("t"), F.lit(tags)).alias("l")).collect():
            assert r.l.code.count("\n") == r.l.full.count("\n") == r.t.count("\n") and len(r.l.code) == len(r.l.full) == len(r.t)
    assert df.select(lexer.structure(lexer.lexed(F.col("t"), F.lit(True))["code"])).collect()


def test_null_and_empty_sources(spark):
    df = spark.createDataFrame([("a.ts", None), ("b.ts", ""), (None, "f()"), ("c.py", "g()")], "path string, source string")
    assert [(r.file, len(r.places)) for r in code.facts(df).orderBy("file").collect()] == [(None, 1), ("a.ts", 0), ("b.ts", 0), ("c.py", 1)]


def test_long_text_is_linear(spark):
    line = "export const f = (a) => { g(`x ${h(a)}`); } // no()\n"
    got = places(spark, line * 4000)
    assert len(got) == 12_000 and got[-1] == ("call", "h", 4000, "f")
    assert names(spark, "g('" + "x" * 500_000 + "'); k(/" + "y" * 100_000 + "/)") == ["g", "k"]
