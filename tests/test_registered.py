"""Every registered query against its SQL in DuckDB."""

import re

import pytest
from oracle import compare, duck

import __spark_entry__ as registered

SF_DIR = "/root/testdata/sf0.01"
#: Without the numbered operators and their pipeline, which may be taken out.
QUERIES, ORACLES = ({n: q for n, q in found.items() if not re.match(r"op\d+_|pipeline$", n)} for found in (registered.queries(), registered.oracle_sql()))


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    assert compare(QUERIES[name](spark, SF_DIR), connection, ORACLES[name]) == ""


def test_entry_has_rows(spark):
    df = registered.entry(spark)
    assert df.count() == 200
    assert df.columns[:2] == ["p_brand", "p_size"]
