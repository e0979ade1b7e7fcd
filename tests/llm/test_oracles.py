"""Queries that SQL can express against their SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import duck, same  # noqa: E402

from vellum.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, sf, name):
    assert same(QUERIES[name](spark, sf), duck(sf), ORACLE_SQL[name]) is None
