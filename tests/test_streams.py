"""Replays over several batches give what one batch gives."""

import pytest

from undertow.sources import artifacts
from undertow.streaming import live

ROWS = [
    (1, 1, "visit", "home"), (1, 2, "link", "a"), (1, 3, "link", "b"), (1, 4, "link", "a"), (1, 5, "act", "home"), (2, 6, "link", "x"), (1, 7, "act", "home"), (1, 8, "visit", "b"),
    (1, 9, "act", "home"), (1, 10, "link", "c"), (2, 11, "visit", "y"), (1, 12, "visit", "d"), (1, 13, "link", "b"), (1, 14, "visit", "a"), (1, 15, None, "z"), (2, 16, "link", None),
]


def replay(spark, tmp_path, batches, schema):
    """A stream that takes one file a batch, oldest first."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        for f in (tmp_path / f"b{i}").glob("part-*"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))


@pytest.mark.parametrize("cuts", [[0, 16], [0, 4, 9, 16]])
def test_sessions(spark, tmp_path, cuts):
    batches = [ROWS[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if len(batches) > 1:
        batches[-1] = batches[-1] + [(1, 17, "visit", "home"), (1, 18, "link", "c"), (2, 19, "link", "x")]  # late duplicates
    stream = replay(spark, tmp_path, batches, "user long, seq long, kind string, url string")
    got = {r.user: r for r in live.run_to_table(live.sessions(stream, "user", screens=3, actions=2), "update", ["user"]).collect()}
    assert (got[1].visited, got[1].frontier, got[1].admitted, got[1].refused) == (["home", "b", "d"], ["a", "c"], 2, 1)
    assert (got[2].visited, got[2].frontier, got[2].admitted, got[2].refused) == (["y"], ["x"], 0, 0)


def test_elements_of_three_snapshots(spark, tmp_path):
    long = "n" * 130
    batches = [
        [("p", "e2", "link", "Go"), ("p", "e1", "link", " Go "), ("p", "e3", "button", "Go"), ("q", "e1", "link", "Go"), ("p", "e4", "link", "  ")],
        [("p", "e1", "link", "Go"), ("p", "e10", "link", "New"), ("p", "e9", "link", "New"), ("p", "e11", "link", long), ("p", "e12", "link", long + "x")],
        [("p", "e1", "link", "New"), ("p", "e2", "link", "Last"), ("p", "e3", None, "Last"), ("p", "e5", None, "Last")],
    ]
    stream = replay(spark, tmp_path, batches, "url string, ref string, role string, name string")
    got = {(r.url, r.ref, r.role, r.name) for r in live.run_to_table(live.elements(stream), "append", None).collect()}
    want = {("p", "e1", "link", "Go"), ("p", "e3", "button", "Go"), ("q", "e1", "link", "Go"), ("p", "e9", "link", "New"), ("p", "e11", "link", "n" * 120), ("p", "e2", "link", "Last"), ("p", "e3", None, "Last")}
    assert got == want
    frames = [spark.createDataFrame(b, "url string, ref string, role string, name string") for b in batches]
    known = artifacts.elements_again(frames[0].limit(0), frames[0])
    for f in frames[1:]:
        known = artifacts.elements_again(known, f)
    assert {tuple(r) for r in known.collect()} == want
