"""Every registered query with SQL against DuckDB, on whole tables of the smallest scale."""

import math
import os

import pytest

from rankframe.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 5) + 0.0 if hasattr(v, "__float__") else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(map(plain, r)) for r in frame.select(*columns).collect()), key=repr)
    assert len(set(columns)) == len(columns)
    if name in registry.oracle_sql():
        cursor = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
        assert got == want


def test_entry(spark):
    assert registry.entry(spark, SF).count() > 0
