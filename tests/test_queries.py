"""Every store query against its SQL in DuckDB."""

import duckdb
import pytest

from tidepool.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert rows == sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
