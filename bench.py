"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times into a no-op sink, which computes
every column of every row; the median counts. ``BENCH_QUERIES`` (comma-separated) picks others.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidemark.catalog import REGISTRY
from tidemark.scratch import scope
from tidemark.session import build_session

HEADLINE = [
    "top_nations_by_revenue", "harmonise_three_sources", "filter_predicates", "classify_trips", "vectorised_tip_pct",
    "star_join_dimensions", "join_on_either_key", "join_version_of_the_day", "seen_and_new_keys", "group_summary",
    "distinct_users_per_day", "exact_quantiles", "cube_three_dimensions", "null_counts", "running_revenue",
    "running_total_of_facts", "month_over_month", "supplier_quartiles", "keep_first_per_key", "versioned_customers",
    "upsert", "cleaning_drops_per_rule", "quality_checks", "referential_integrity", "profile_lines", "metric_values",
    "gold_daily_overall", "gold_od_matrix", "session_windows", "late_classification", "tumbling_windows",
    "stream_tumbling_windows", "write_partitioned_rows", "medallion_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    picked = list(REGISTRY) if names == "all" else names.split(",") if names else HEADLINE
    spark = build_session(
        app="tidemark-bench", master=f"local[{cpus}]", spark_sql_shuffle_partitions=cpus,
        spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_driver_memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        with scope(spark):
            start = time.perf_counter()
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

    seconds = {}
    for name in picked:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
                "spark": spark.version,
                "shuffle_partitions": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
