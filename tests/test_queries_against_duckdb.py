"""Every registered query that has SQL gives what DuckDB gives, on the smallest tables, and some rows."""

from pathlib import Path

import duckdb
import pytest

from tracewright.plans import ORACLES, QUERIES, catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def comparable(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(comparable, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    got = sorted((comparable(tuple(r[c] for c in columns)) for r in frame.collect()), key=repr)
    assert got
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        want = sorted((comparable(tuple(r[names.index(c)] for c in columns)) for r in cur.fetchall()), key=repr)
        assert got == want


def test_flagship():
    assert catalog.FLAGSHIP in QUERIES
