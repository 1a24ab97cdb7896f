"""Every registered query with an oracle equals its DuckDB SQL at sf0.001;
rows-only queries run and return rows."""

import re

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

# the training-data operators have tests of their own
OWN = re.compile(r"op\d+_|pipeline$")
ORACLE = sorted(n for n in oracle_sql() if not OWN.match(n))
ROWS_ONLY = sorted(n for n in set(queries()) - set(oracle_sql()) if not OWN.match(n))


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["status"] == "match", r


def test_every_query_has_an_oracle():
    assert not ROWS_ONLY and set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["request_id", "item_id", "score", "rank"]
    assert df.count() > 0
