"""Every named query against its SQL twin in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from fathom.plans import catalog, catalog_files, catalog_reports  # noqa: F401

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{float(v):.4f}" if isinstance(v, float) else str(int(v)) if isinstance(v, (int, bool)) else str(v)
    return sorted(tuple(str(norm(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    expected = want.fetchall()
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(expected, names)
