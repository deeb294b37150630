"""Registered queries against their DuckDB oracle SQL on the smallest tables."""

import pytest

from tandem.plans import ORACLE, QUERIES
from tandem.plans.check import compare, duck
from conftest import SF001

KEYS = sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    r = compare(spark, key, SF001, con)
    assert r["ok"], r


def test_every_query_has_a_docstring():
    for k, fn in QUERIES.items():
        assert fn.__doc__, k
