"""Every registered query against its SQL form."""

import pytest

import __spark_entry__ as entry_points
from eventflow.plans.registry import QUERIES

from .oracle import connect, differences

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, data, name):
    assert differences(entry_points.queries()[name](spark, data), con, entry_points.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["event_id", "value", "tx_hour", "is_high_value", "risk_score", "topic"]
    assert df.count() == 1000
