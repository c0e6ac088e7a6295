"""Queries against their SQL twins on whole tables."""

import duckdb
import pytest

from fathom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(SQL[name])
    names = sorted(d[0] for d in want.description)
    rows = [dict(zip([d[0] for d in want.description], r, strict=True)) for r in want.fetchall()]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    key = lambda r: str([r[n] for n in names])
    assert sorted(map(key, rows)) == sorted(key(r.asDict()) for r in got.collect())
