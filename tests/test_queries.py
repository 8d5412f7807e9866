"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle import assert_same, connect

from lontarix import queries

ORACLES = queries.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert_same(queries.queries()[name](spark, SF), con, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
