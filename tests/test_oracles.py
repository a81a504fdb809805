"""Every registered query with a SQL counterpart gives the same rows as DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import panelkit.plans  # noqa: F401
from panelkit import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(([None if pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") or type(v).__name__ == "Decimal" else str(v) for v in row] for row in df.astype(object).itertuples(index=False)), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    for a, b in zip(plain(ours), plain(theirs), strict=True):
        assert all(x == pytest.approx(y, rel=1e-9, abs=1e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


def test_entry_is_registered(spark):
    import __spark_entry__

    assert "lag_consecutive" in __spark_entry__.queries()
    assert __spark_entry__.entry(spark).columns == ["n_nationkey", "yr", "revenue", "revenue_before"]
