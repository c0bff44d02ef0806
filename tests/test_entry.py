"""The driver contract: queries run, and match their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(v):
    if v is None or v != v or str(v) == "<NA>":
        return None
    if isinstance(v, bool):
        return v
    try:
        return round(float(v), 4) + 0.0
    except (TypeError, ValueError):
        return str(v)


def key(row):
    return tuple((v is None, str(type(v)), v) if not isinstance(v, float) else (False, "f", round(v, 3)) for v in row)


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline"))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(want.columns) == cols
    norm = lambda rows: sorted([tuple(plain(v) for v in r) for r in rows], key=key)
    a = norm(got.select(*cols).toPandas().astype(object).itertuples(index=False))
    b = norm(want[cols].astype(object).itertuples(index=False))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-4) if all(isinstance(v, float) for v in x) else all(p == q or abs(p - q) < 2e-4 for p, q in zip(x, y))
