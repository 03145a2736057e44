"""Every registered query against its SQL: names, types, rows, exact values."""

from __future__ import annotations

import pytest

import __spark_entry__
from tests.conftest import SF
from tests.oracle import compare, connect
from tidemark.catalog import REGISTRY


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, sf_dir, con, name):
    q = REGISTRY[name]
    assert q.sql, "every query has an oracle"
    assert compare(spark, con, q.run, q.sql, sf_dir) == []


def test_entry_points(spark):
    top = __spark_entry__.entry(spark)
    assert top.columns == ["r_name", "n_name", "rows", "revenue", "avg_fare", "place"]
    assert 0 < top.count() <= 15
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
