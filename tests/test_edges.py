"""Edge rules on small hand-written frames."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import times as T
from tidemark.functions import udfs as U
from tidemark.functions.amounts import mean, ratio
from tidemark.operators import aggregates as A
from tidemark.operators import history as H
from tidemark.operators import joins as J
from tidemark.operators import quality as Q
from tidemark.operators import windows as W
from tidemark.operators.ranges import lay_out, running, with_row_number


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


# --- scalars ---------------------------------------------------------------------------------------------


def test_safe_divide_zero_and_null(spark):
    df = spark.createDataFrame([(6.0, 3.0), (1.0, 0.0), (1.0, None)], "a double, b double")
    got = df.select(S.safe_divide("a", "b").alias("x"), S.safe_divide("a", "b", 0.0).alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [(2.0, 2.0), (None, 0.0), (None, 0.0)]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-5.0,), (5.0,), (500.0,), (None,)], "v double")
    assert [r.v for r in df.select(S.clamp("v", 0.0, 100.0).alias("v")).collect()] == [0.0, 5.0, 100.0, None]


def test_hash_key_is_null_safe_and_separated(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("abc", None), (None, "abc")], "x string, y string")
    keys = [r.k for r in df.select(S.hash_key(["x", "y"]).alias("k")).collect()]
    assert None not in keys and len(set(keys)) == 4


def test_parse_any_gives_null_for_rubbish(spark):
    df = spark.createDataFrame([("2020-02-01",), ("01/02/2020",), ("31/31/2020",), (None,)], "t string")
    got = [r.d for r in df.select(S.parse_any("t", ["yyyy-MM-dd", "dd/MM/yyyy"]).cast("date").alias("d")).collect()]
    assert got == [dt.date(2020, 2, 1), dt.date(2020, 2, 1), None, None]


def test_normalise_and_recode_null(spark):
    df = spark.createDataFrame([(" Male ", 99), ("x", 1), (None, None)], "g string, c int")
    got = df.select(S.normalise("g", {"male": "m"}, "unknown").alias("g"), S.recode("c", [99], 1).alias("c")).collect()
    assert [(r.g, r.c) for r in got] == [("m", 1), ("unknown", 1), ("unknown", 1)]


def test_full_and_prefix_match(spark):
    df = spark.createDataFrame([("ab",), ("abc",)], "t string")
    got = df.select(S.matches("t", "ab").alias("full"), S.matches("t", "ab", full=False).alias("pre")).collect()
    assert [(r.full, r.pre) for r in got] == [(True, True), (False, True)]


def test_minute_boundaries_count_marks(spark):
    row = spark.range(1).select(
        T.minute_boundaries(ts("2024-01-01 12:00:59"), ts("2024-01-01 12:01:00")).alias("marks"),
        T.minutes_between(ts("2024-01-01 12:00:59"), ts("2024-01-01 12:01:00")).alias("minutes"),
    ).first()
    assert row.marks == 1 and row.minutes == pytest.approx(1 / 60)


def test_weekday_convention(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),)], "d date")
    got = days.select(T.iso_dow("d").alias("w"), T.day_type("d").alias("t")).collect()
    assert [(r.w, r.t) for r in got] == [(1, "weekday"), (7, "weekend")]


def test_classification_edges(spark):
    df = spark.createDataFrame([(None, None), (1.0, 5), (1.01, 6), (15.0, 23), (15.1, 3)], "d double, h int")
    got = df.select(U.distance_class("d").alias("c"), U.time_of_day("h").alias("t"), U.day_part("h").alias("p")).collect()
    assert [r.c for r in got] == ["unknown", "short", "medium", "long", "very_long"]
    assert [r.t for r in got] == [None, "overnight", "morning_rush", "evening", "overnight"]
    assert [r.p for r in got] == [None, "early_morning", "early_morning", "evening", "late_night"]


def test_vectorised_twin_on_nulls_and_zero(spark):
    df = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0), (None, 2.0), (1.0, None)], "t double, b double")
    got = df.select(U.tip_pct_vec("t", "b").alias("a"), U.tip_pct("t", "b").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] == [25.0, None, None, None]


# --- aggregates ------------------------------------------------------------------------------------------


def test_mean_and_ratio_of_nothing(spark):
    df = spark.createDataFrame([(None, 0)], "v decimal(10,2), d int")
    row = df.agg(mean("v").alias("m"), ratio(F.sum("d"), F.sum("d")).alias("r")).first()
    assert row.m is None and row.r is None


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_quantiles_match_numpy(spark, n):
    rng = random.Random(n)
    data = [(g, rng.choice([1.0, 2.0, 5.5, rng.random() * 10])) for g in "ab" for _ in range(n)] + [("a", None)]
    df = spark.createDataFrame(data, "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {(r.g, r.q): r.value for r in A.quantiles(df, ["g"], "v", qs).collect()}
    for g in "ab":
        want = np.quantile([v for k, v in data if k == g and v is not None], qs)
        assert [got[g, q] for q in qs] == pytest.approx(list(want))


def test_most_common_breaks_ties_low(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("b", 3), ("b", None)], "g string, v int")
    assert values(A.most_common(df, ["g"], "v"), "g", "most_common", "occurrences") == [("a", 1, 1), ("b", 3, 2)]


def test_cube_equals_direct_cube(spark):
    df = spark.createDataFrame([(a, b, a * b) for a in range(3) for b in range(4)] * 2, "a int, b int, v int")
    ours = A.cube(df, ["a", "b"], {"n": F.lit(1), "s": F.col("v")})
    direct = df.cube("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    assert values(ours, "a", "b", "n", "s") == values(direct, "a", "b", "n", "s")


# --- ranges ----------------------------------------------------------------------------------------------


def skewed(spark, rows=3000):
    """One key holds two thirds of the rows; the order column has ties."""
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.66 else f"k{rng.randrange(40)}", rng.randrange(200), i, rng.randrange(1, 9)) for i in range(rows)]
    return spark.createDataFrame(data, "k string, t int, id int, v int").repartition(6)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_equals_plain_window(spark, keys, exclusive):
    df = skewed(spark)
    order = ["t", "id"]
    laid = lay_out(df, keys, order, slots=16)
    outputs = {"n": ("count", F.col("v")), "s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("t"))}
    got = running(laid, keys, order, outputs, exclusive)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    want = df.withColumns({"n": F.count("v").over(w), "s": F.sum("v").over(w), "hi": F.max("v").over(w), "lo": F.min("t").over(w)})
    assert values(got, "id", "n", "s", "hi", "lo") == values(want, "id", "n", "s", "hi", "lo")
    assert laid.select("_slot").distinct().count() > 4


def test_hot_key_is_spread_over_slots(spark):
    laid = lay_out(skewed(spark), ["k"], ["t", "id"], slots=16)
    rows = laid.groupBy("_slot").count().agg(F.max("count"), F.sum("count")).first()
    assert rows[0] < rows[1] / 5


def test_row_number_with_null_key(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "k string, t int")
    assert values(with_row_number(df, ["k"], ["t"], "n"), "k", "t", "n") == [("a", 5, 1), (None, 1, 1), (None, 2, 2)]


@pytest.mark.parametrize("rows,n", [(10, 4), (3, 4), (8, 4), (1, 1), (9, 2)])
def test_segments_equal_ntile(spark, rows, n):
    df = spark.range(rows).withColumnRenamed("id", "v")
    want = df.withColumn("segment", F.ntile(n).over(Window.orderBy("v")))
    assert values(W.quantile_segments(df, ["v"], n), "v", "segment") == values(want, "v", "segment")


# --- windows ---------------------------------------------------------------------------------------------


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3)], "n string, v int")
    got = values(W.rank_all(df, [], [F.col("v").desc()], ["n"]), "n", "rank_gaps", "rank_dense", "row_num")
    assert got == [("a", 1, 1, 1), ("b", 1, 1, 2), ("c", 3, 2, 3)]
    assert W.top_n_per(df, [], [F.col("v").desc()], 1).count() == 2
    assert W.top_n_per(df, [], [F.col("v").desc(), "n"], 1, ties=False).count() == 1


def test_growth_from_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (2, 5), (3, 10)], "t int, v int")
    assert values(W.growth(df, [], ["t"], "v"), "t", "growth_pct") == [(1, None), (2, None), (3, 100.0)]


def test_band_that_excludes_the_judged_period(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([100, 101, 99, 100, 140])], "t int, v int")
    flags = {r.t: (r.outside_band, r.is_anomaly) for r in W.volume_bands(df, "t", "v").collect()}
    assert flags[4] == (True, True) and flags[3] == (False, False)
    inside = {r.t: r.outside_band for r in W.volume_bands(df, "t", "v", include_current=True).collect()}
    assert not any(inside.values())


# --- joins -----------------------------------------------------------------------------------------------


def test_small_respects_its_limit(spark, sf_dir):
    dim = spark.read.parquet(f"{sf_dir}/nation.parquet")
    hinted = lambda df: "hint" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(J.small(dim)) and not hinted(J.small(dim, limit=10))
    assert not hinted(J.small(dim, limit=10, bound=dim))


def test_not_in_with_null_on_the_right(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (None,)], "k int")
    assert values(J.not_in(left, right, "k"), "k") == [(2,), (None,)]


def test_any_key_join_matches_once(spark):
    fact = spark.createDataFrame([(1, 7, 7), (2, 7, 8), (3, None, 7)], "id int, a int, b int")
    dim = spark.createDataFrame([(7, "x")], "k int, n string")
    got = J.join_any_key(fact, dim, {"a": "a", "b": "b"}, "k")
    assert values(got, "id", "via_a", "via_b") == [(1, True, True), (2, True, False), (3, False, True)]


def test_orphans_ignore_null_keys(spark):
    child = spark.createDataFrame([(1,), (9,), (None,)], "c int")
    parent = spark.createDataFrame([(1,)], "p int")
    assert values(J.orphans(child, parent, "c", "p"), "c") == [(9,)]


# --- history ---------------------------------------------------------------------------------------------


def dimension(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    return H.open_dimension(rows, "k", "2020-01-01")


def changes(spark, rows):
    return spark.createDataFrame(rows, "k int, change_date date, v string")


def test_scd2_invariants(spark):
    day = dt.date(2021, 5, 1)
    once = H.scd2_apply(dimension(spark), changes(spark, [(1, day, "z"), (3, day, "c")]), "k", ["v"])
    twice = H.scd2_apply(once, changes(spark, [(1, dt.date(2022, 1, 1), "y")]), "k", ["v"])
    assert once.count() == 5 and twice.count() == 6
    assert values(twice.filter("is_current"), "k", "v") == [(1, "y"), (2, "b"), (3, "c")]
    a, b = twice.alias("a"), twice.alias("b")
    overlap = a.join(b, F.expr("a.k = b.k and a.version_key <> b.version_key and a.valid_from <= b.valid_to and b.valid_from <= a.valid_to"))
    assert overlap.isEmpty()
    assert twice.select("version_key").distinct().count() == 6
    assert values(H.version_at(twice, "2021-04-30"), "k", "v") == [(1, "a"), (2, "b"), (3, None)]
    assert values(H.version_at(twice, "2021-05-01"), "k", "v") == [(1, "z"), (2, "b"), (3, "c")]


@pytest.mark.parametrize(
    "rows, why",
    [
        ([(99, dt.date(2022, 1, 1), "x")], "no current version"),
        ([(1, dt.date(1990, 1, 1), "x")], "before the current version"),
        ([(1, None, "x")], "without a date"),
    ],
)
def test_scd2_rejects_changes_that_do_not_fit(spark, rows, why):
    with pytest.raises(Exception, match=why):
        H.scd2_apply(dimension(spark), changes(spark, rows), "k", ["v"]).collect()


def test_scd2_rerun_changes_nothing_and_a_second_value_is_an_error(spark):
    day = dt.date(2022, 1, 1)
    once = H.scd2_apply(dimension(spark), changes(spark, [(1, day, "z")]), "k", ["v"])
    again = H.scd2_apply(once, changes(spark, [(1, day, "z")]), "k", ["v"])
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    with pytest.raises(Exception, match="different change on one day"):
        H.scd2_apply(once, changes(spark, [(1, day, "other")]), "k", ["v"]).collect()


def test_scratch_is_narrow_and_empty_after_its_scope(spark, sf_dir):
    import glob

    from tidemark.catalog import REGISTRY
    from tidemark.scratch import scope

    base = spark.conf.get("spark.checkpoint.dir")
    with scope(spark):
        before = set(glob.glob(f"{base}/ranges-*"))
        REGISTRY["late_classification"].run(spark, sf_dir).count()
        (path,) = set(glob.glob(f"{base}/ranges-*")) - before
        assert "props" not in spark.read.parquet(path).columns
    assert not glob.glob(path)


def test_sketch_bound_can_fail(spark):
    rough = spark.createDataFrame([(120, 100), (101, 100)], "active_users long, exact long")
    near = F.abs(F.col("active_users") - F.col("exact")) <= F.col("exact") * 0.15 + 1
    assert [r[0] for r in rough.select(near).collect()] == [False, True]


def test_only_a_missing_path_is_an_empty_table(spark, tmp_path):
    from tidemark.sources.writers import rewrite_evolved

    df = spark.createDataFrame([(1,)], "a int")
    assert rewrite_evolved(df, str(tmp_path / "none"), str(tmp_path / "new"), {}).count() == 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        rewrite_evolved(df, str(tmp_path / "bad"), str(tmp_path / "newer"), {})


def test_ingest_survives_a_lost_checkpoint_and_rejects_a_foreign_table(spark, tmp_path):
    from tidemark.sources.ingest import ingest_new

    df = spark.range(10).selectExpr("id", "id as v")
    df.write.parquet(str(tmp_path / "landing/a"))
    args = dict(src=str(tmp_path / "landing/*"), out=str(tmp_path / "t"), schema=df.schema, keys=["id"], order=["v"])
    assert ingest_new(spark, checkpoint=str(tmp_path / "c1"), **args) == 10
    spark.range(10, 15).selectExpr("id", "id as v").write.parquet(str(tmp_path / "landing/b"))
    assert ingest_new(spark, checkpoint=str(tmp_path / "c2"), **args) == 5
    assert spark.read.parquet(str(tmp_path / "t")).count() == 15
    df.write.parquet(str(tmp_path / "foreign"))
    with pytest.raises(Exception, match="epoch"):
        ingest_new(spark, checkpoint=str(tmp_path / "c3"), **{**args, "out": str(tmp_path / "foreign")})


def test_pivot_gathers_unknown_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("a", None), ("b", 1)], "k string, y int")
    out = A.pivot(df, ["k"], "y", [1], F.count(F.lit(1)), other="other").collect()
    assert {r.k: (r["1"], r["other"]) for r in out} == {"a": (1, 2), "b": (1, 0)}


def test_mean_ratio_does_not_round_small_values(spark):
    df = spark.createDataFrame([(1e-7, 1.0), (2e-7, 1.0)], "n double, d double")
    assert A.mean_of_ratios(df, [], "n", "d").first().ratio == pytest.approx(1.5e-7)


def test_scd2_rejects_two_changes_for_a_key(spark):
    day = dt.date(2021, 5, 1)
    with pytest.raises(Exception, match="several changes"):
        H.scd2_apply(dimension(spark), changes(spark, [(1, day, "x"), (1, day, "y")]), "k", ["v"]).collect()


def test_snapshot_compares_null_safely(spark):
    source = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "n")], "k int, v string")
    out = H.snapshot(dimension(spark), source, "k", ["v"], "2021-01-01")
    assert values(out, "k", "v", "is_current") == [
        (1, "a", True), (2, "b", False), (2, None, True), (3, None, True), (4, "n", True)
    ]
    again = H.snapshot(out, source, "k", ["v"], "2021-02-01")
    assert again.count() == out.count()


def test_merge_kinds_and_idempotence(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    source = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k int, v string")
    got = H.merge(target, source, ["k"])
    assert values(got, "k", "v", "change") == [
        (1, "a", "unchanged"), (2, "B", "updated"), (3, None, "unchanged"), (4, "d", "inserted")
    ]
    again = H.merge(got.drop("change"), source, ["k"])
    assert values(H.merge_audit(again), "change", "rows") == [("unchanged", 4)]


def test_merge_rejects_repeated_source_keys(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="several source rows"):
        H.merge(target, source, ["k"]).collect()


def test_dedupe_is_deterministic(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "c"), (2, 1, "z")], "k int, t int, v string")
    for parts in (1, 4):
        shuffled = df.repartition(parts)
        assert values(H.dedupe(shuffled, ["k"], ["t"]), "k", "t", "v") == [(1, 1, "a"), (2, 1, "z")]
        assert values(H.dedupe(shuffled, ["k"], ["t"], "last"), "k", "t", "v") == [(1, 3, "c"), (2, 1, "z")]


def test_schema_diff(spark):
    a = spark.createDataFrame([(1, "x", 2)], "k int, gone string, t int")
    b = spark.createDataFrame([(1, 2, "n")], "k int, t bigint, new string")
    got = values(H.schema_diff(a, b), "column_name", "change", "old_type", "new_type")
    assert got == [("gone", "removed", "string", None), ("new", "added", None, "string"), ("t", "type_changed", "int", "bigint")]


# --- quality ---------------------------------------------------------------------------------------------


def checked(df, *rules):
    return {(r["check"], r["column_name"]): (r["failing_rows"], r["passed"]) for r in Q.run_checks(df, rules).collect()}


def test_missing_counts_null_nan_and_empty(spark):
    df = spark.createDataFrame([("x", 1.0), ("", float("nan")), (None, None), ("y", 2.0)], "s string, d double")
    got = checked(df, {"check": "completeness", "column": "s", "max_null_pct": 50}, {"check": "completeness", "column": "d"})
    assert got == {("completeness", "s"): (2, True), ("completeness", "d"): (2, False)}


def test_rules_ignore_nulls(spark):
    df = spark.createDataFrame([(5, "a"), (50, "b"), (None, None), (5, "zz")], "n int, s string")
    got = checked(
        df, {"check": "range", "column": "n", "min": 0, "max": 10}, {"check": "uniqueness", "column": "n"},
        {"check": "accepted_values", "column": "s", "values": ["a", "b"]}, {"check": "pattern", "column": "s", "pattern": "[a-z]"},
    )
    assert got == {
        ("range", "n"): (1, False), ("uniqueness", "n"): (1, False),
        ("accepted_values", "s"): (1, False), ("pattern", "s"): (0, True),
    }


def test_checks_on_an_empty_table(spark):
    df = spark.createDataFrame([], "n int")
    got = checked(df, {"check": "completeness", "column": "n"}, {"check": "uniqueness", "column": "n"})
    assert got == {("completeness", "n"): (0, True), ("uniqueness", "n"): (0, True)}


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([(1,), (20,), (None,)], "v int")
    valid, bad = Q.split(df, [("small", F.col("v") < 10)])
    assert values(valid, "v") == [(1,)] and values(bad, "v", "reason") == [(20, "small"), (None, "small")]


def test_gate_raises_only_when_open(spark):
    scores = spark.createDataFrame([("a", 95.0), ("b", 85.0)], "dataset string, overall double")
    Q.enforce_gate(Q.circuit(scores))
    low = spark.createDataFrame([("c", 79.9), ("d", 49.0)], "dataset string, overall double")
    assert values(Q.circuit(low), "dataset", "state", "severity") == [("c", "OPEN", "ERROR"), ("d", "OPEN", "CRITICAL")]
    with pytest.raises(Q.GateOpen, match="c"):
        Q.enforce_gate(Q.circuit(low))


def test_freshness_of_an_empty_table(spark):
    df = spark.createDataFrame([], "t timestamp_ntz")
    assert Q.freshness(df, "t", 1, "2024-01-01", "x").first()["status"] == "UNKNOWN"


def test_tiny_fractions_do_not_fit_whole_numbers(spark):
    from pyspark.sql import types as T

    from tidemark.operators.projections import enforce

    df = spark.createDataFrame([(1.0000000001, "1.0000000001"), (2.0, "2"), (3.0, "3"), (None, None)], "a double, b string")
    want = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    fit, lost = enforce(df, want)
    assert {r.column_name: r.failures for r in lost.collect()} == {"a": 1, "b": 1}
