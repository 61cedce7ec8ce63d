"""Every named query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from lakequill.plans import catalogue  # noqa: F401
from lakequill.plans.registry import ORACLES, QUERIES
from lakequill.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert len(rows) > 0
        return
    got = duck.execute(ORACLES[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    a = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    b = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in got.fetchall()), key=repr)
    assert a == b


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
    assert os.path.exists(os.path.join(os.path.dirname(e.__file__), "bench.py"))
