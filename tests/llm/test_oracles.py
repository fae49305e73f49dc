"""Queries with SQL of their own give its rows."""

import glob
import os

import duckdb
import pytest

from envgrid.llm import registry

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    rows = c.execute(registry.ORACLES[name])
    want, names = rows.fetchall(), [d[0] for d in rows.description]
    got = registry.QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want))
