"""Every registered query of the engine against its SQL in another engine, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from scholia.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return int(v) if isinstance(v, int) or hasattr(v, "dtype") and v.dtype.kind in "iu" else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, other, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name in catalog.ORACLES:
        rel = other.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == columns
        want = sorted((tuple(plain(v) for v in r) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
        assert got == want
    else:
        assert got
