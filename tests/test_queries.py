"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

from voxcohort.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Columns without a value in the smallest tables.
NULL_HERE: dict[str, set[str]] = {}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        v = round(v, 5)
        return int(v) if v == int(v) else v
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "as_tuple"):
        return plain(float(v))
    return str(v) if isinstance(v, datetime.date) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([None if r[i] is None else plain(r[i]) for i in order]) for r in data))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    data = [tuple(r) for r in got.collect()]
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())
    # A column of nulls would compare nothing.
    assert {c for i, c in enumerate(got.columns) if all(r[i] is None for r in data)} <= NULL_HERE.get(name, set())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["feature", "kw_h", "eta_squared", "kw_q"]
    assert set(registry.ORACLES) <= set(registry.QUERIES)
