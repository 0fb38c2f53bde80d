"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows with a stable schema."""

import math
from pathlib import Path

import duckdb
import pytest

from sheetlens import queries

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    return str(v)


def test_names_agree():
    assert queries.ORACLES.keys() <= queries.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, str(SF))
    if name not in queries.ORACLES:
        assert got.count() > 0
        return
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(repr([plain(v) for v in r]) for r in want.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in got.select(*[got[f"`{n}`"] for n in names]).collect()) == rows
