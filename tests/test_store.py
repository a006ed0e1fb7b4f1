"""Versions of stored graphs, and the merge of a run into one."""

import pytest
from pyspark.sql import functions as F

from undertow.operators import graph, store

NS = "acme/shop"
EDGE, LINK = "src string, dst string", "src string, dst string, confidence double"


def frames(spark, files=(), symbols=(), calls=(), imports=(), screens=(), moves=(), rendered=(), reqs=(), covered=(), gaps=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return {
        "files": make([(f"f:{p}", p, n) for p, n in files], "key string, path string, loc int"), "symbols": make([(f"s:{p}:{n}", p, n) for p, n in symbols], "key string, path string, name string"),
        "imports": make([(f"f:{a}", f"f:{b}", n) for a, b, n in imports], "src string, dst string, name string"), "renders": make([], EDGE), "calls": make([(f"s:{a}", f"s:{b}") for a, b in calls], EDGE),
        "screens": make([(k, k) for k in screens], "key string, url string"), "navigates_to": make(moves, EDGE), "rendered_by": make([(a, f"f:{b}") for a, b in rendered], EDGE),
        "requirements": make([(k, t) for k, t in reqs], "key string, title string"), "covered_by": make(covered, LINK), "implemented_by": make([], LINK),
        "gaps": make([(f"{k}::gap", k, "x") for k in gaps], "key string, src string, reason string"),
    }


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def old(spark):
    return frames(
        spark, files=[("a", 1), ("b", 2), ("c", 3)], symbols=[("a", "x"), ("a", "y"), ("b", "z"), ("c", "w")], calls=[("a:x", "b:z"), ("b:z", "a:y"), ("c:w", "a:x")], imports=[("a", "b", "z"), ("c", "a", "x")],
        screens=["s1", "s2"], moves=[("s1", "s2"), ("s2", "s1")], rendered=[("s1", "a"), ("s2", "c")], reqs=[("r1", "old"), ("r2", "t")], covered=[("r1", "s1", 0.5)], gaps=["r2"],
    )


def test_merge(spark, old):
    new = frames(spark, files=[("a", 9), ("d", 4)], symbols=[("a", "x"), ("d", "q")], calls=[("a:x", "d:q"), ("a:x", "a:none")], imports=[("a", "d", "q"), ("a", "d", "q")], screens=["s2"], moves=[("s2", "s2x")], reqs=[("r1", "new"), ("r3", "t")], covered=[("r3", "s2", 0.9), ("r3", "s2", 0.7)])
    out = store.merge(old, new)
    assert got(out["files"]) == [("f:a", "a", 9), ("f:b", "b", 2), ("f:c", "c", 3), ("f:d", "d", 4)]
    assert got(out["symbols"].select("key")) == [("s:a:x",), ("s:b:z",), ("s:c:w",), ("s:d:q",)]
    assert got(out["calls"]) == [("s:a:x", "s:d:q"), ("s:c:w", "s:a:x")]  # a's call of b and b's call of a's lost y are gone
    assert got(out["imports"]) == [("f:a", "f:d", "q"), ("f:c", "f:a", "x")]
    assert got(out["navigates_to"]) == [("s1", "s2")] and got(out["rendered_by"]) == [("s1", "f:a")]
    assert got(out["requirements"]) == [("r1", "new"), ("r2", "t"), ("r3", "t")] and got(out["covered_by"]) == [("r3", "s2", 0.9)]
    assert got(out["gaps"].select("key")) == [("r1::gap",), ("r2::gap",)]


def test_merge_of_some_tables_and_deleted_files(spark, old):
    out = store.merge(old, {}, deleted=spark.createDataFrame([("a",), ("none",)], "path string"))
    assert got(out["symbols"].select("name")) == [("w",), ("z",)] and got(out["calls"]) == [] and got(out["imports"]) == [] and got(out["rendered_by"]) == [("s2", "f:c")]
    assert got(out["covered_by"]) == [("r1", "s1", 0.5)] and got(out["gaps"].select("src")) == [("r2",)]
    again = store.merge(old, {k: old[k] for k in ("files", "symbols", "calls", "imports")})
    assert all(got(again[k].select(old[k].columns)) == got(old[k]) for k in ("symbols", "calls", "imports"))


def test_versions(spark, old, tmp_path):
    folder = str(tmp_path / "g")
    with pytest.raises(FileNotFoundError):
        store.load(spark, folder, NS)
    assert store.save(old, folder, NS) == 1 and store.save(old, folder, "other") == 1
    now = store.load(spark, folder, NS)
    merged = store.merge(now, frames(spark, files=[("a", 7)], symbols=[("a", "x")]))
    assert store.save(merged, folder, NS, based_on=1) == 2  # from the folder it was read from
    assert got(store.load(spark, folder, NS)["files"])[0] == ("f:a", "a", 7) and got(store.load(spark, folder, NS, 1)["files"])[0] == ("f:a", "a", 1)
    with pytest.raises(store.StaleVersion):
        store.save(merged, folder, NS, based_on=1)
    assert store.save({"files": old["files"].where("loc = 3")}, folder, NS) == 3  # the other tables stay
    last = store.load(spark, folder, NS)
    assert set(last) == set(store.TABLES) and got(last["files"]) == [("f:c", "c", 3)] and last["symbols"].count() == 3
    assert store.reset(spark, folder, NS) == 4 and not store.load(spark, folder, NS)["symbols"].count() and store.load(spark, folder, "other")["symbols"].count() == 4
    assert store.versions(spark, folder, NS) == [1, 2, 3, 4] and store.clean(spark, folder, NS, 2) == [3, 4]
    assert store.load(spark, folder, NS, 3)["symbols"].count() == 3
    with pytest.raises(FileNotFoundError):
        store.load(spark, folder, NS, 1)


def test_a_killed_save_changes_nothing(spark, old, tmp_path):
    folder = str(tmp_path / "g")
    store.save(old, folder, NS)
    bad = dict(old) | {"gaps": old["gaps"].select(F.raise_error(F.lit("killed")).cast("string").alias("key"))}
    with pytest.raises(Exception, match="killed"):
        store.save({**bad, "gaps": spark.range(1).select(F.raise_error(F.lit("killed")).cast("string").alias("key"))}, folder, NS)
    assert store.versions(spark, folder, NS) == [1] and got(store.load(spark, folder, NS)["files"]) == got(old["files"])
    assert graph.load is store.load


def test_two_writers(spark, old, tmp_path):
    """The name of a version is taken once."""
    at = store._Folder(spark, str(tmp_path / "g"), NS)
    assert at.put("versions/1", "{}") and not at.put("versions/1", '{"x": 1}') and at.read("versions/1") == "{}"
    assert store.save(old, str(tmp_path / "g"), NS) == 2
