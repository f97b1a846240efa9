"""Every registered query against its DuckDB twin."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as driver
from corpusloom.checks import classify, converge, ingest, model, relevance, translate
from tests.conftest import DATA

OWN = (relevance, classify, converge, translate, model, ingest)
TABLES = ["documents", "labels", "benchmark", "conversations", "pages"]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    return float(f"{value:.12g}") if isinstance(value, float) and math.isfinite(value) else value


def in_order(rows):
    return sorted(rows, key=lambda row: [(x is None, str(x)) for x in row])


QUERIES = {name: query for module in OWN for name, query in module.QUERIES.items()}


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(driver.oracle_sql())
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = in_order([tuple(plain(row[c]) for c in columns) for row in df.collect()])
    result = duck.execute(driver.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    places = [list(kinds).index(c) for c in sorted(kinds)]
    theirs = in_order([tuple(plain(row[i]) for i in places) for row in result.fetchall()])
    assert columns == sorted(kinds)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    assert ours == theirs


def test_entry(spark):
    assert driver.entry(spark).count() > 0
