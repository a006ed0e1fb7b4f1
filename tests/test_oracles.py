"""Every query with an oracle gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from undertow.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(float(r[i])) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    want = plain(got.fetchall(), names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == want
    assert want or name in ("dangling_edges",)
    assert os.path.exists(SF)
