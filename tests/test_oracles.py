"""Every registered query of the library against its SQL; a query without SQL fails."""

import pytest

import __spark_entry__ as entrypoint
from oracle_compare import compare, duck
from querylight.plans.all_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF_DIR)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())
