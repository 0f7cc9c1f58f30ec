"""Every query with SQL against DuckDB, value by value, on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from martingrid.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, found):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    same = lambda v: v.isoformat() if isinstance(v, datetime.datetime) else round(v, 7) + 0.0 if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(same(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got, want = duck.execute(ORACLES[name]), None
    want = rows([c[0] for c in got.description], got.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert have[0] == want[0] and len(have[1]) == len(want[1])
    bad = [(a, b) for a, b in zip(have[1], want[1], strict=True) if a != b]
    assert len(bad) == 0, bad[:5]
