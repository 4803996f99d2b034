"""Every catalogued query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from verdigris import catalog

SF = "/root/testdata/sf0.001"


def clean(rows):
    value = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted(repr([value(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert clean(tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == clean(want.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
