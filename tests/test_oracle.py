"""Every query with oracle SQL matches DuckDB on sf0.001 (names, rows, values)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import TABLES, rows_of  # noqa: E402

from tagwise.plans.registry import load_all  # noqa: E402

REG = load_all()
NAMES = sorted(n for n, s in REG.items() if s.sql is not None)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf, con, name):
    spec = REG[name]
    df = spec.fn(spark, sf)
    c1, r1 = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(spec.sql)
    c2, r2 = rows_of(rel.columns, rel.fetchall())
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_contract(spark):
    import importlib.util
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    assert set(m.oracle_sql()) <= set(m.queries())
    assert m.entry(spark).count() > 0
