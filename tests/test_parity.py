"""Every query with an oracle gives the oracle's rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from envgrid.plans import registry

D = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def canon(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float):
            return f"{v + 0.0:.6f}"
        return str(v)[:19] if isinstance(v, pd.Timestamp) else str(v)

    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df = df.assign(**{c: df[c].astype("datetime64[us]").dt.strftime("%Y-%m-%d %H:%M:%S")})
    rows = [tuple(one(v) if not hasattr(v, "isoformat") else str(pd.Timestamp(v))[:19] for v in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_parity(spark, duck, name):
    got = registry.QUERIES[name](spark, D)
    want = duck.execute(registry.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = got.toPandas(), want
    for c in a.columns:  # integers in either width
        if pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]) and not pd.api.types.is_bool_dtype(a[c]):
            a[c], b[c] = a[c].astype(float), b[c].astype(float)
    assert canon(a) == canon(b)
