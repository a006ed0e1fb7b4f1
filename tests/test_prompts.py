"""Prompts with caps, and the log of a model's calls."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from undertow.operators import prompts, usage
from undertow.operators.engine import Impact

CALL = "seq int, tag string, model string, input long, output long, cache_read long, cache_write long, cost double"


def test_joined_lists_equal_plain_ones(spark):
    dice = random.Random(7)
    rows = [(g, dice.randrange(40), "x" * dice.randrange(0, 5) or None) for g, n in (("hot", 3000), ("a", 3), (None, 12)) for _ in range(n)]
    rows += [("a", 1, ""), ("a", None, "first")]
    df = spark.createDataFrame(rows, "g string, at int, line string").repartition(7)
    for chars, lines in ((1, None), (2, None), (101, None), (102, None), (103, 9), (None, 5), (10**5, None)):
        got = {r.g: r.text for r in prompts.joined(df, ["g"], ["at"], "; ", chars, lines).collect()}
        for g in ("hot", "a", None):
            kept = sorted((r for r in rows if r[0] == g and r[2]), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))[:lines]
            assert got[g] == "; ".join(r[2] for r in kept)[:chars], (g, chars, lines)
    assert prompts.joined(df.limit(0), ["g"], ["at"], "; ", 10).count() == 0
    with pytest.raises(ValueError):
        prompts.joined(df, ["g"], ["at"], "; ")


def test_texts_are_cut_and_nulls_are_empty(spark):
    one = spark.createDataFrame([("h", "b" * 7000), (None, None)], "h string, b string")
    a, b = one.select(prompts.section(F.col("h"), F.col("b")).alias("s"), prompts.screen(F.col("h"), F.col("h"), F.col("b")).alias("c"), prompts.shown(F.col("h"), F.col("b")).alias("v")).collect()
    assert a.s == "Heading: h\n\n" + "b" * 6000 and a.c == "URL: h\nTitle: h\n\n" + "b" * 3500 and a.v == "Title: h\n" + "b" * 4000
    assert (b.s, b.c, b.v) == ("Heading: \n\n", "URL: \nTitle: \n\n", "Title: \n")


def test_prompts_for_links_come_in_batches(spark):
    asked = spark.createDataFrame([(f"R{i:03}", f"t{i}", None, "ok") for i in range(25)] + [(None, "t", "", "")], "req_id string, title string, user_action string, expected_outcome string")
    screens = spark.createDataFrame([("u1", "t", "l"), ("u0", None, None), (None, "t", "l")], "url string, title string, label string")
    files = spark.createDataFrame([(f"f{i:04}",) for i in range(400)] * 2, "path string")
    got = {r.batch: r.prompt for r in prompts.mappings(asked, screens, files, batch=10).collect()}
    assert sorted(got) == [0, 1, 2]
    asks = "\n".join(f"- R{i:03}: t{i} | user:  -> ok" for i in range(20, 25))
    assert got[2] == f"Requirements:\n{asks}\n\nScreens:\n- u0 (u0)\n- l (u1)\n\nFiles:\n" + "\n".join(f"f{i:04}" for i in range(300))
    none = prompts.mappings(asked, screens.limit(0), files.limit(0)).collect()
    assert none[0].prompt.endswith("\n\nScreens:\nnone\n\nFiles:\nnone") and prompts.mappings(asked.limit(0), screens, files).count() == 0


def test_evidence_of_a_narrative(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    titled = "key string, req_id string, title string"
    reached = Impact(
        changed=table([], "path string"), files=table([("b.ts",), ("a.ts",)], "path string"), symbols=table([("S" * 2000,), ("T" * 2000,)], "name string"),
        upstream_symbols=table([], "name string"), screens=table([("k", "u", "L")], "key string, url string, label string"),
        flows=table([("a", "b", "A", "B")], "src string, dst string, from_label string, to_label string"), flows_inside=table([], "src string, dst string, from_label string, to_label string"),
        requirements=table([("k", "R1", "one", "file")], titled + ", via string"), losing_coverage=table([], titled), uncovered=table([("R2", "two")], "req_id string, title string"),
    )
    pull = table([("Fix", "d" * 2000)], "title string, body string")
    lines = prompts.narrative(pull, table([("a.ts", 1, None)], "path string, additions int, deletions int"), reached).first().prompt.split("\n")
    assert lines[:4] == ["Title: Fix", "Description: " + "d" * 1500, "Changed files: a.ts (+1/-0)", "- affected files: a.ts; b.ts"]
    assert lines[4] == "- changed symbols: " + ("S" * 2000 + "; " + "T" * 2000)[:3000]
    assert lines[5:] == ["- symbols that depend on them: none", "- screens at risk: L (u)", "- flows touched: A -> B", "- requirements at risk: R1 one", "- requirements losing coverage: none", "- requirements without coverage before: R2 two"]


def test_usage_is_logged_summed_and_written(spark, tmp_path):
    calls = spark.createDataFrame([(2, "a", "m", 10, 1, 5, None, 0.1), (1, "a", "m", 30, 2, 10, 7, 0.2), (3, None, "m", None, None, None, None, None)], CALL)
    usage.record(calls.where("seq < 3"), f"{tmp_path}/log")
    usage.record(calls.where("seq = 3"), f"{tmp_path}/log")
    sums = usage.summary(usage.log(spark, f"{tmp_path}/log"))
    got = {(r.is_total, r.tag): tuple(r)[2:] for r in sums.collect()}
    assert got == {(False, "a"): (2, 40, 3, 15, 7, Decimal("0.3"), 37.5), (False, None): (1, 0, 0, 0, 0, Decimal(0), 0.0), (True, None): (3, 40, 3, 15, 7, Decimal("0.3"), 37.5)}
    assert usage.line(sums).first().line == "3 calls, 40 in (15 cached = 37.5%), 3 out, $0.300"
    assert usage.summary(calls.limit(0)).count() == 0
    usage.save_report(calls, f"{tmp_path}/cost.json", rows=2)
    back = usage.load_report(spark, f"{tmp_path}/cost.json")
    assert tuple(back["totals"].first()) == (3, 40, 3, 15, 7, Decimal("0.3"))
    assert sorted((str(r.tag), r.calls, r.cost) for r in back["by_tag"].collect()) == [("None", 1, Decimal(0)), ("a", 2, Decimal("0.3"))]
    assert sorted((r.input, r.cost) for r in back["calls"].collect()) == [(0, Decimal(0)), (10, Decimal("0.1")), (30, Decimal("0.2"))]
    assert len([x for x in spark.read.text(f"{tmp_path}/cost.json").collect() if '"calls":[' in x[0]]) == 2
    usage.save_report(calls.limit(0), f"{tmp_path}/none.json")
    assert not (tmp_path / "none.json").exists()
