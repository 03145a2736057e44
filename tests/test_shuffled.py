"""The same results with no table broadcast by size, partitions left apart and hot ones split."""

from __future__ import annotations

import pytest

from tests.oracle import compare, connect
from tidemark.catalog import REGISTRY
from tidemark.operators import joins

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.shuffle.partitions": "12",
}
NAMES = [
    "top_nations_by_revenue", "role_playing_join", "star_join_dimensions", "join_on_either_key", "join_version_of_the_day",
    "versioned_customers", "upsert", "referential_integrity", "exact_quantiles", "sequence_within_user",
    "running_total_of_facts", "supplier_quartiles", "late_classification", "session_windows", "metric_values",
]


@pytest.fixture
def shuffled(spark, monkeypatch):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(joins.small, "__defaults__", (0, None))
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", NAMES)
def test_results_hold_without_broadcasts(shuffled, sf_dir, name):
    q = REGISTRY[name]
    assert compare(shuffled, connect(sf_dir), q.run, q.sql, sf_dir) == []


def test_fact_joins_then_sort_and_merge(shuffled, sf_dir):
    plan = REGISTRY["group_summary"].run(shuffled, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "BroadcastHashJoin" not in plan
