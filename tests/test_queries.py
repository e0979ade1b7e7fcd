"""Each registered query against its SQL."""

import os

import pytest

from compare import duck, same
from vellum.plans import oracles, package_oracles, package_queries, queries

QUERIES, ORACLE_SQL = queries.QUERIES | package_queries.QUERIES, oracles.ORACLE_SQL | package_oracles.ORACLE_SQL
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    assert same(QUERIES[name](spark, SF), duck(SF), ORACLE_SQL[name]) is None
