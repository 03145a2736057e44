"""Quantiles by selection, and figures folded from stored states."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import joins as J
from tidemark.operators import profile as P
from tidemark.plans.partials import Measure, PartialStore
from tidemark.scratch import scratch_path

QS = [0.0, 0.1, 0.5, 0.95, 1.0]


def interpolated(values, q):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    at = q * (len(values) - 1)
    lo, hi = values[math.floor(at)], values[math.ceil(at)]
    return lo + (hi - lo) * (at - math.floor(at))


def spread(kind, n, draw):
    if kind == "narrow":
        return [100 + draw.random() / 1000 for _ in range(n)]
    if kind == "ties":
        return [draw.choice([-1.5, 0.0, 2.25]) for _ in range(n)]
    if kind == "wide":
        return [draw.choice([-1, 1]) * 10 ** draw.uniform(-8, 12) for _ in range(n)]
    return [draw.gauss(0, 3) for _ in range(n - 2)] + [0.0, -0.0]


@pytest.mark.parametrize("few, bins", [(200_000, 1024), (20, 8), (0, 2)])
def test_quantiles_equal_sorting_however_many_rounds(spark, monkeypatch, few, bins):
    monkeypatch.setattr(A, "FEW_ROWS", few)
    monkeypatch.setattr(A, "BINS", bins)
    draw = random.Random(few)
    groups = {"narrow": 60, "ties": 90, "wide": 70, None: 50, "one": 3}
    data = {g: spread(g, n, draw) for g, n in groups.items()} | {"single": [7.5]}
    if few == 0:
        data = {g: v[:12] for g, v in data.items()}
    rows = [(g, v) for g, values in data.items() for v in values] + [("narrow", None), ("none", None)]
    got = A.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", QS).collect()
    assert len(got) == len(data) * len(QS)
    for r in got:
        assert r.value == pytest.approx(interpolated(data[r.g], r.q), rel=1e-12, abs=1e-300), (r.g, r.q)


def test_quantiles_of_infinite_values_decimals_and_nothing(spark):
    odd = [float("-inf"), -1.0, 2.0, float("inf"), float("nan")]
    got = {r.q: r.value for r in A.quantiles(spark.createDataFrame([(v,) for v in odd], "v double"), [], "v", [0.0, 0.25, 0.5, 0.75]).collect()}
    assert got == {0.0: float("-inf"), 0.25: -1.0, 0.5: 2.0, 0.75: float("inf")} or math.isnan(got[0.75])
    money = spark.createDataFrame([(Decimal(n) / 100,) for n in range(1, 102)], "v decimal(12,2)")
    assert A.quantiles(money, [], "v", [0.5]).first().value == 0.51
    assert A.quantiles(money.limit(0), [], "v", [0.5]).count() == 0


def test_first_bins_never_fall(spark):
    draw = random.Random(1)
    values = sorted([draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300) for _ in range(5000)] + [n / 1000 for n in range(-2000, 2000)])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bins = [r.b for r in df.orderBy("v").select(A._first_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins) and len(set(bins)) > 500


DAYS = "day date, zone string, k bigint, v decimal(12,2)"


def trips(spark, rows):
    return spark.createDataFrame([(dt.date(2024, 1, d), z, k, Decimal(v)) for d, z, k, v in rows], DAYS)


def store(spark, dims=("zone",)):
    return PartialStore(spark, scratch_path(spark, "t-partials"), "day", list(dims), {
        "n": Measure("count", F.lit(1)), "total": Measure("sum", F.col("v")), "low": Measure("min", F.col("v")), "high": Measure("max", F.col("v")),
        "avg": Measure("mean", F.col("v")), "keys": Measure("distinct", F.col("k")), "about": Measure("about_distinct", F.col("k")),
    })


def figures(df, *by):
    return {tuple(r[b] for b in by): (r.n, r.total, r.low, r.high, r.avg, r["keys"], r.about) for r in df.collect()}


def direct(df, *by):
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.try_divide(F.sum("v").cast("double"), F.count("v")).alias("avg"), F.count_distinct("k").alias("keys"),
        F.hll_sketch_estimate(F.hll_sketch_agg("k")).alias("about"))
    return figures(out, *by)


ROWS = [(1, "a", 1, "2.50"), (1, "a", 1, "1"), (1, None, 70_000, "4"), (2, "a", 1, "3"), (2, "b", -5, "9"), (2, None, None, "1"), (3, "a", 2, "7")]


def test_folded_equals_recomputed_and_a_restated_day_replaces_its_own(spark):
    kept = store(spark)
    for day in (1, 2, 3):
        kept.refresh(trips(spark, [r for r in ROWS if r[0] == day]))
    whole = trips(spark, ROWS)
    assert figures(kept.fold({"zone": F.col("zone")}), "zone") == direct(whole, "zone")
    assert figures(kept.fold({"day": F.col("day")}), "day") == direct(whole, "day")
    assert figures(kept.fold({})) == direct(whole)
    late = F.col("day") >= F.lit("2024-01-02").cast("date")
    assert figures(kept.fold({"zone": F.col("zone")}, late), "zone") == direct(whole.filter(late), "zone")

    files = {f: os.path.getmtime(f) for f in glob.glob(f"{kept.path}/*/day=2024-01-0[13]/*.parquet")}
    again = [r for r in ROWS if r[0] != 2] + [(2, "b", None, "8")]
    kept.refresh(trips(spark, [r for r in again if r[0] == 2]))
    assert figures(kept.fold({"zone": F.col("zone")}), "zone") == direct(trips(spark, again), "zone")
    assert {f: os.path.getmtime(f) for f in glob.glob(f"{kept.path}/*/day=2024-01-0[13]/*.parquet")} == files  # other days are untouched
    kept.drop(["2024-01-02"])
    assert figures(kept.fold({})) == direct(trips(spark, [r for r in ROWS if r[0] != 2]))
    assert sorted(r["rows"] for r in kept.periods().collect()) == [1, 3]


def test_a_fold_reads_the_wanted_periods_only(spark):
    kept = store(spark)
    kept.refresh(trips(spark, ROWS))
    plan = kept.fold({"zone": F.col("zone")}, F.col("day") == F.lit("2024-01-02").cast("date"))._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [isnotnull(day") == 2


@pytest.mark.parametrize("how", ["left", "inner"])
def test_carried_versions_equal_the_join_on_a_long_history_and_a_hot_key(spark, how):
    day = lambda n: F.date_add(F.lit("2000-01-01").cast("date"), n)
    dim = spark.range(10_000).select(F.lit("hot").alias("k"), day(F.col("id").cast("int") * 3).alias("valid_from"), day(F.col("id").cast("int") * 3 + 1).alias("valid_to"),
                                     F.col("id").alias("version"), F.when(F.col("id") % 7 > 0, "x").alias("note"))
    more = spark.sql("SELECT 'one' AS k, DATE '2001-01-01' AS valid_from, DATE '9999-12-31' AS valid_to, -1L AS version, 'y' AS note UNION ALL SELECT NULL, DATE '2000-01-01', DATE '9999-12-31', -2L, 'z'")
    dim = dim.unionAll(more)
    keys = F.element_at(F.array(F.lit("hot"), F.lit("hot"), F.lit("hot"), F.lit("one"), F.lit(None), F.lit("none")), (F.col("id") % 6 + 1).cast("int"))
    fact = spark.range(3000).select("id", keys.alias("k"), (day((F.pmod(F.xxhash64("id"), F.lit(40_000)) - 2000).cast("int"))).cast("timestamp_ntz").alias("at"))
    want = J.as_of_version(fact, dim, "k", "at", how).select("id", "k", "at", "valid_from", "valid_to", "version", "note")
    got = J.as_of_running(fact, dim, "k", "at", how)
    assert got.columns == want.columns and got.count() == want.count() > 300
    assert got.exceptAll(want).count() == 0


def plain_top(rows, c, k):
    counts = {}
    for r in rows:
        counts[r[c]] = counts.get(r[c], 0) + 1
    return sorted(((c, None if v is None else str(v), n) for v, n in counts.items()), key=lambda x: (-x[2], x[1] is not None, x[1] or ""))[:k]


@pytest.mark.parametrize("fullest", [64, 2])
def test_top_values_equal_full_counts(spark, monkeypatch, fullest):
    monkeypatch.setattr(P, "FULLEST", fullest)
    monkeypatch.setattr(P, "BUCKETS", 32)
    draw = random.Random(4)
    rows = [(i, draw.choice(["a", "b", None, "c"]) if i % 3 else f"r{i}", int(draw.paretovariate(0.7)) % 10_000, draw.choice([0.5, -1.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, s string, p bigint, d double").repartition(4)
    got = [tuple(r) for r in P.top_values(df, ["k", "s", "p", "d"], 3).collect()]
    for i, c in enumerate(["k", "s", "p", "d"]):
        own = [g for g in got if g[0] == c]
        want = plain_top([{c: r[i]} for r in rows], c, 3)
        assert sorted(n for *_, n in own) == sorted(n for *_, n in want)
        if c != "k":
            assert sorted(own, key=repr) == sorted(want, key=repr)
    assert P.top_values(df.limit(0), ["k", "s"], 3).count() == 0
