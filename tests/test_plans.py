"""Plan facts: what reaches the scan, how tables join, where Python runs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import REGISTRY
from tidemark.catalog.joins import nation_revenue
from tidemark.scratch import scratch_path
from tidemark.sources import readers, writers
from tidemark.tables import sales, table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, sf_dir):
    df = sales(spark, sf_dir).filter("rate = 'A'").groupBy("from_nation").agg(F.sum("distance"))
    scan = next(line for line in plan(df).splitlines() if "FileScan" in line and "l_returnflag" in line)
    assert "EqualTo(l_returnflag,A)" in scan
    read = re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1)
    assert "l_extendedprice" not in read and "l_shipdate" not in read


def test_partition_filter_prunes_directories(spark, sf_dir):
    out = scratch_path(spark, "plan")
    df = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    writers.write_partitioned(df, out, ["year"])
    text = plan(readers.read_partition(spark, out, F.col("year") == 1998))
    assert re.search(r"PartitionFilters: \[[^\]]*year[^\]]*1998", text)


def test_dimension_joins_are_broadcast(spark, sf_dir):
    text = plan(nation_revenue(spark, sf_dir))
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_big_sides_shuffle_when_over_the_limit(spark, sf_dir):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
        assert "SortMergeJoin" in plan(a.join(b, F.col("o_custkey") == F.col("c_custkey")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["top_nations_by_revenue", "top_two_per_region", "top_keys_per_window"])
def test_rank_filters_limit_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(REGISTRY[name].run(spark, sf_dir))


def test_row_checks_are_one_scan(spark, sf_dir):
    from tidemark.catalog.quality import LINE_RULES
    from tidemark.operators.quality import run_checks

    rules = [r for r in LINE_RULES if r["check"] != "uniqueness"]
    assert plan(run_checks(table(spark, sf_dir, "lineitem"), rules)).count("FileScan") == 1


def test_uniqueness_does_not_multiply_rows(spark, sf_dir):
    assert "Expand" not in plan(REGISTRY["quality_checks"].run(spark, sf_dir))


def test_cube_expands_groups_not_rows(spark, sf_dir):
    lines = plan(REGISTRY["cube_three_dimensions"].run(spark, sf_dir)).splitlines()
    expand = next(i for i, line in enumerate(lines) if "Expand" in line)
    assert any("HashAggregate" in line for line in lines[expand:])


PYTHON = {"vectorised_tip_pct"}


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - PYTHON))
def test_no_python_in_the_plan(spark, sf_dir, name):
    source = REGISTRY[name].run.__code__.co_consts
    if name.startswith("stream_") or any(isinstance(c, str) and "scratch" in c for c in source):
        pytest.skip("runs its own jobs")
    text = plan(REGISTRY[name].run(spark, sf_dir))
    assert not re.search(r"PythonUDF|ArrowEvalPython|BatchEvalPython|InPandas|CartesianProduct", text)


@pytest.mark.parametrize("name", sorted(n for n in REGISTRY if n.startswith("stream_")))
def test_streams_have_no_python_node(spark, sf_dir, name, monkeypatch):
    """The stream's plan is taken where the query would start it."""
    from tidemark.streaming import gate, late, live, sinks

    class Started(Exception):
        pass

    def catch(stream, *args, **options):
        assert stream.isStreaming
        raise Started(stream._jdf.queryExecution().analyzed().toString())

    for module, function in ((sinks, "drain"), (sinks, "stream_to_table"), (late, "split_late"), (gate, "gate_stream"), (live, "surge_stream")):
        monkeypatch.setattr(module, function, catch)
    with pytest.raises(Started) as taken:
        REGISTRY[name].run(spark, sf_dir)
    assert not re.search(r"PythonUDF|ArrowEvalPython|BatchEvalPython|InPandas|MapInArrow", str(taken.value))


ONE_ROW = ["above_average_suppliers", "supplier_quartiles", "outlier_days", "quality_scores"]


@pytest.mark.parametrize("name", ONE_ROW)
def test_cross_joins_only_meet_one_row(spark, sf_dir, name):
    """Nested-loop joins appear only against the broadcast of a global aggregate, which is one row."""
    lines = plan(REGISTRY[name].run(spark, sf_dir)).splitlines()
    for at, line in enumerate(lines):
        if "BroadcastExchange IdentityBroadcastMode" in line:
            below = next(x for x in lines[at + 1 :] if "Aggregate" in x or "Exchange" in x or "Join" in x or "FileScan" in x)
            assert "HashAggregate(keys=[]" in below, below


@pytest.mark.parametrize("name", ["active_users", "trending_users", "recent_by_type"])
def test_trailing_spans_filter_at_the_scan(spark, sf_dir, name):
    """The edge of the span is a scalar subquery, so there is no nested-loop join, and columns are pruned."""
    text = plan(REGISTRY[name].run(spark, sf_dir))
    assert "NestedLoop" not in text and "props" not in text


def test_both_sources_come_from_one_pass(spark, sf_dir):
    from tidemark.catalog.marts import both

    assert plan(both(spark, sf_dir)).count("lineitem.parquet") == 1


def test_quantile_positions_are_broadcast_by_size(spark, sf_dir):
    from tidemark.operators.aggregates import quantiles
    from tidemark.tables import table

    text = plan(quantiles(table(spark, sf_dir, "events"), ["event_type"], "user_id", [0.5]))
    assert "SortMergeJoin" not in text


def test_nearly_unique_keys_are_dealt_by_the_size_of_the_table(spark, sf_dir, monkeypatch):
    """More rows mean more partitions, not larger ones, whatever the session's shuffle partitions; both sides of the join lie alike."""
    from tidemark.operators import joins

    run, asked = REGISTRY["multi_column_join"].run, lambda df: set(map(int, re.findall(r"hashpartitioning\(l_orderkey#\d+L?, l_linenumber#\d+, (\d+)\)", plan(df))))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    want = sorted(map(tuple, run(spark, sf_dir).collect()))
    monkeypatch.setattr(joins, "DEALT_BYTES", joins.estimated_bytes(lines) // 20)
    assert asked(run(spark, sf_dir)) <= {20, 21} and len(asked(run(spark, sf_dir))) == 1
    assert sorted(map(tuple, run(spark, sf_dir).collect())) == want
    grown = joins.dealt(lines.unionAll(lines), ["l_orderkey", "l_linenumber"])
    assert grown.rdd.getNumPartitions() >= 40


def test_summary_of_the_layers_starts_no_python_worker(spark, sf_dir):
    out = REGISTRY["medallion_summary"].run(spark, sf_dir)
    assert "ExistingRDD" not in plan(out) and out.count() == 7
