"""Every query against its SQL on DuckDB, over whole small tables."""

import math

import duckdb
import pytest

from paperproof.oracle import ORACLE
from paperproof.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7f}"
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "orders", "lineitem", "part", "customer", "events", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in ORACLE:
        return
    want = db.execute(ORACLE[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    rows = sorted(tuple(_plain(v) for v in r) for r in want.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in cols) for r in got) == rows
