"""State carried between batches, key filters, and tables rewritten bucket by bucket."""

from __future__ import annotations

import datetime as dt
import glob
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators.quality import GateOpen
from tidemark.scratch import scratch_path
from tidemark.sources import keyindex, writers
from tidemark.sources.bucketed import BucketedTable
from tidemark.sources.ingest import ingest_new
from tidemark.streaming import live as V
from tidemark.streaming import windows as W
from tidemark.streaming.gate import GateSink
from tidemark.streaming.state import KeyedState

BASE = dt.datetime(2024, 1, 1)
WINDOWS = "window_start timestamp_ntz, k string, window_sum decimal(12,2), window_rows bigint"


def windows(spark, rows):
    return spark.createDataFrame([(BASE + dt.timedelta(hours=h), k, Decimal(s), n) for h, k, s, n in rows], WINDOWS)


def flags(df):
    return sorted(((r.window_start, r.k, r.window_mean, r.base_mean, r.is_surge) for r in df.collect()), key=repr)


@pytest.mark.parametrize("full_every", [1, 2, 32])
def test_surges_by_batch_equal_the_batch_form_and_retries_change_nothing(spark, full_every):
    rounds = [
        [(0, "a", "10", 2), (0, "b", "4", 1)], [(1, "a", "12", 2)], [], [(2, "a", "90", 3), (3, "a", "9", 1), (4, "a", "9", 1)],
        [(5, "b", "40", 2), (5, None, "1", 1)], [(6, "a", "100", 1), (6, None, "3", 1)], [(7, "b", "4", 4), (7, "a", "1", 1)],
    ]
    out = scratch_path(spark, "t-surge")
    kinds = dict(windows(spark, rounds[0]).dtypes)
    for epoch, rows in enumerate(rounds):
        for _ in range(2 if epoch % 2 else 1):  # every other batch is given twice, each time to a new sink
            V.SurgeSink(spark, out, "k", kinds, 1.5, 3, full_every).take(windows(spark, rows), epoch)
    together = V.flag_surges(windows(spark, [r for rows in rounds for r in rows]), "k", 1.5, 3)
    got = V.SurgeSink(spark, out, "k", kinds, 1.5, 3).flags()
    assert flags(got) == flags(together) and any(f[4] for f in flags(got))
    state = os.listdir(f"{out}/state")
    assert len(state) <= len(rounds) if full_every == 32 else len(state) <= full_every + 3


def test_state_of_an_epoch_that_failed_is_not_read(spark):
    path = scratch_path(spark, "t-state")
    state = KeyedState(spark, path, "k string, v bigint", ["k"])
    state.write(0, spark.createDataFrame([("a", 1), ("b", 1)], "k string, v bigint"))
    state.write(1, spark.createDataFrame([("a", 2)], "k string, v bigint"))
    os.remove(f"{path}/epoch-1-part/_SUCCESS")
    assert {(r.k, r.v) for r in state.before(2).collect()} == {("a", 1), ("b", 1)}
    state.write(1, spark.createDataFrame([("a", 3)], "k string, v bigint"))
    assert {(r.k, r.v) for r in state.before(2).collect()} == {("a", 3), ("b", 1)}
    assert {(r.k, r.v) for r in state.before(1).collect()} == {("a", 1), ("b", 1)}
    wanted = spark.createDataFrame([("b",), ("z",)], "k string")
    assert [(r.k, r.v) for r in state.before(2, wanted).collect()] == [("b", 1)]


def test_key_filter_never_misses_and_rarely_errs(spark):
    old = spark.range(0, 20_000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("s"))
    index = keyindex.build(old, ["k", "s"]).withColumn("part", F.lit("p0")).unionByName(
        keyindex.build(old.limit(0), ["k", "s"]).withColumn("part", F.lit("none")))
    got = keyindex.candidates(old.filter("k % 3 = 0"), index, ["k", "s"], "part")
    assert got.count() == old.filter("k % 3 = 0").count() and {r.part for r in got.select("part").distinct().collect()} == {"p0"}
    other = old.withColumn("s", F.concat("s", F.lit("x")))  # the same range, other keys
    assert keyindex.candidates(other, index, ["k", "s"], "part").count() < 200
    beyond = old.withColumn("k", F.col("k") + 50_000)
    assert keyindex.candidates(beyond, index, ["k", "s"], "part").count() == 0
    nothing = spark.createDataFrame([(None, "1"), (3, None)], "k bigint, s string")
    assert keyindex.candidates(nothing, index, ["k", "s"], "part").count() == 0


def land(spark, base, name, ids, start=0):
    rows = [(i, BASE + dt.timedelta(seconds=start + n), str(start)) for n, i in enumerate(ids)]
    spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, v string").write.parquet(f"{base}/in/{name}")


def ruin(folder):
    for file in glob.glob(f"{folder}/*.parquet"):
        with open(file, "wb") as f:
            f.write(b"not a parquet file")
        crc = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
        if os.path.exists(crc):
            os.remove(crc)


def test_a_batch_of_new_keys_opens_no_old_file(spark):
    base = scratch_path(spark, "t-index")
    take = lambda: ingest_new(spark, f"{base}/in/*", f"{base}/out", f"{base}/cp", "id bigint, ts timestamp_ntz, v string", ["id"], ["ts"])
    land(spark, base, "a", range(0, 100))
    assert take() == 100
    (first,) = [p for p in glob.glob(f"{base}/out/epoch=*")]
    land(spark, base, "b", range(200, 300), 1)
    ruin(first)
    assert take() == 100  # the first directory cannot be read any more, and is not
    land(spark, base, "c", [*range(250, 320), 300], 2)
    assert take() == 20  # keys of the second directory are found there, and only there
    land(spark, base, "d", [5], 3)
    with pytest.raises(Exception):
        take()  # a key of the first directory makes it open


def test_ingest_opens_directories_without_a_filter(spark):
    base = scratch_path(spark, "t-unindexed")
    args = (spark, f"{base}/in/*", f"{base}/out", f"{base}/cp", "id bigint, ts timestamp_ntz, v string", ["id"], ["ts"])
    land(spark, base, "old", [1, 2])
    spark.read.parquet(f"{base}/in/old").write.parquet(f"{base}/out/epoch=before-0")
    land(spark, base, "new", [2, 3, None, None], 1)
    assert ingest_new(*args) == 2  # 3 and the null key; 1 and 2 were there
    assert sorted((r.id for r in spark.read.parquet(f"{base}/out").collect()), key=repr) == [1, 2, 3, None]
    assert "_keys" in os.listdir(f"{base}/out")


def accounts(spark, n=1000, buckets=16):
    rows = spark.range(n).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    table = BucketedTable(spark, scratch_path(spark, "t-buckets"), ["k"], buckets)
    table.create(rows)
    return table


def files(table):
    return {b: sorted(glob.glob(f"{table.path}/data/{f}/_bucket={b}/*.parquet")) for b, f in table.manifest().items()}


def test_a_merge_rewrites_the_buckets_it_touches(spark):
    table = accounts(spark)
    before = files(table)
    ids = [r.k for r in table.read(buckets=[3]).limit(10).collect()]
    source = spark.createDataFrame([(k, 1) for k in ids], "k bigint, v int")
    audit = {r.change: r.rows for r in table.merge(source).collect()}
    after = files(table)
    assert {b for b in after if after[b] != before[b]} == {3} and audit["updated"] == 10
    assert audit["unchanged"] == table.read(buckets=[3]).count() - 10
    assert {(r.v, r["n"]) for r in table.read().groupBy("v").agg(F.count("*").alias("n")).collect()} == {(0, 990), (1, 10)}
    assert table.read(version=0).filter("v = 1").count() == 0  # the version before is still there


def test_the_same_merge_again_writes_nothing(spark):
    table = accounts(spark)
    source = spark.createDataFrame([(1, 5), (2000, 5)], "k bigint, v int")
    table.merge(source)
    held, kept = table.versions(), files(table)
    assert table.merge(source).count() == 0 and table.versions() == held and files(table) == kept
    assert table.merge(source.limit(0)).count() == 0 and table.versions() == held
    assert table.read().count() == 1001


def test_a_merge_that_fails_leaves_the_table(spark):
    table = accounts(spark)
    with pytest.raises(Exception, match="several source rows"):
        table.merge(spark.createDataFrame([(1, 1), (1, 2)], "k bigint, v int"))
    assert table.versions() == [0] and table.read().filter("v <> 0").count() == 0
    with pytest.raises(ValueError, match="left their buckets"):
        table.rewrite(spark.createDataFrame([(1, 1)], "k bigint, v int"), lambda old, new: old.withColumn("k", F.col("k") + 1))
    assert table.versions() == [0]


def test_of_two_changes_from_one_version_the_second_fails(spark):
    table = accounts(spark)
    other = BucketedTable(spark, table.path, ["k"], 16)

    def meanwhile(old, new):
        other.merge(spark.createDataFrame([(7, 7)], "k bigint, v int"))
        return H.merge(old, new, ["k"])

    with pytest.raises(RuntimeError, match="written by another"):
        table.rewrite(spark.createDataFrame([(8, 8)], "k bigint, v int"), meanwhile)
    assert {(r.k, r.v) for r in table.read().filter("v <> 0").collect()} == {(7, 7)}
    table.merge(spark.createDataFrame([(8, 8)], "k bigint, v int"))
    assert table.read().filter("v <> 0").count() == 2


def test_buckets_may_empty_and_old_versions_go(spark):
    table = accounts(spark, 50, 4)
    rows = table.read(buckets=[2])
    gone = rows.count()
    table.rewrite(rows, lambda old, new: old.join(new.select("k"), "k", "left_anti"))
    assert 2 not in table.manifest() and table.read().count() == 50 - gone
    table.vacuum()
    assert table.versions() == [1] and table.read().count() == 50 - gone
    assert not glob.glob(f"{table.path}/data/*/_bucket=2")
    empty = BucketedTable(spark, scratch_path(spark, "t-empty"), ["k"], 4)
    empty.create(spark.createDataFrame([], "k bigint, v int"))
    empty.merge(spark.createDataFrame([(1, 1)], "k bigint, v int"))
    assert [(r.k, r.v) for r in empty.read().collect()] == [(1, 1)]


def test_a_claim_without_a_manifest_is_given_up(spark):
    table = accounts(spark, 20, 2)
    os.makedirs(f"{table.path}/claims", exist_ok=True)
    open(f"{table.path}/claims/v1", "w").close()
    with pytest.raises(RuntimeError):
        table.merge(spark.createDataFrame([(1, 1)], "k bigint, v int"))
    table.release()
    assert {r.change for r in table.merge(spark.createDataFrame([(1, 1)], "k bigint, v int")).collect()} >= {"updated"}


def rules():
    return [("given", F.col("v").isNotNull()), ("small", F.col("v") <= 10)]


def batch(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v bigint")


def test_the_gate_halts_before_a_bad_batch_and_retries_change_nothing(spark):
    out = scratch_path(spark, "t-gate")
    schema = batch(spark, []).schema
    good, warned, bad = [1] * 19 + [99], [1] * 17 + [None, 11, 12], [None] * 5 + [1] * 5
    for epoch, values in enumerate((good, warned, [])):
        for _ in range(2):
            GateSink(spark, out, "t", rules()).take(batch(spark, values), epoch)
    with pytest.raises(GateOpen, match="5 of 10 rows"):
        GateSink(spark, out, "t", rules()).take(batch(spark, bad), 3)
    sink = GateSink(spark, out, "t", rules())
    assert sink.read("table", schema).count() == 36 and sink.read("halted", schema).count() == 10
    assert sorted((r.v, r.reason) for r in sink.read("quarantine", schema).filter("v IS NOT NULL").collect()) == [(11, "small"), (12, "small"), (99, "small")]
    states = {r.epoch: (r.state, r.rows, r.passed, r.failures) for r in spark.read.parquet(f"{out}/decisions").collect()}
    assert states[0] == ("CLOSED", 20, 19, {"given": 0, "small": 1}) and states[1][0] == "HALF-OPEN"
    assert states[2][:2] == ("CLOSED", 0) and states[3][0] == "OPEN" and states[3][3] == {"given": 5, "small": 5}
    sink.take(batch(spark, good), 3)  # the batch as mended
    assert sink.read("table", schema).count() == 55 and sink.read("halted", schema).count() == 0


def test_panes_equal_copied_rows_on_odd_users(spark):
    rows = [(BASE + dt.timedelta(minutes=7 * i), u, Decimal(i)) for i, u in enumerate([1, 1, None, -3, 40_000, 40_001, 1, None, 2, 2] * 9)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, u bigint, v decimal(12,2)")
    aggs = {"rows": F.count(F.lit(1)), "sum_value": F.sum("v"), "users": F.count_distinct("u")}
    want = {tuple(r) for r in W.sliding(df, "ts", "1 hour", "15 minutes", [], aggs).collect()}
    assert {tuple(r) for r in W.sliding_panes(df, "ts", "1 hour", "15 minutes", "v", "u").collect()} == want
    plan = W.sliding_panes(df, "ts", "1 hour", "15 minutes", "v", "u")._jdf.queryExecution().executedPlan().toString()
    scan = plan.rindex("Scan ExistingRDD")
    assert "Expand" not in plan[plan.rindex("bitmap_construct_agg") : scan]  # rows are not copied, panes are


@pytest.mark.parametrize("kind", ["bigint", "timestamp_ntz", "string", "date"])
def test_interleaved_files_are_narrow_in_both_columns(spark, kind):
    n = 20_000
    a = F.pmod(F.xxhash64("id"), F.lit(5000)).cast("bigint")
    b = (F.pmod(F.xxhash64(F.col("id") + 1), F.lit(5000)) * F.pmod(F.col("id"), F.lit(7))).cast("bigint")
    shapes = {"bigint": lambda c: c, "timestamp_ntz": lambda c: F.timestamp_seconds(c * 1000).cast("timestamp_ntz"),
              "string": lambda c: F.lpad(c.cast("string"), 6, "0"), "date": lambda c: F.date_add(F.lit("1970-01-01").cast("date"), c.cast("int"))}
    df = spark.range(n).select(shapes[kind](a).alias("a"), F.when(F.col("id") % 50 > 0, shapes[kind](b)).alias("b"))
    out = scratch_path(spark, "t-morton")
    writers.write_interleaved(df, f"{out}/both", ["a", "b"], 16)
    writers.write_clustered(df, f"{out}/sorted", ["a", "b"], 16)
    assert spark.read.parquet(f"{out}/both").exceptAll(df).count() == 0 and spark.read.parquet(f"{out}/both").count() == n

    def opened(place, column):
        """Files whose range holds the middle value of the column."""
        rows = spark.read.parquet(place)
        middle = rows.select(F.sort_array(F.collect_list(column))[n // 3].alias("m")).first().m
        ranges = rows.groupBy(F.input_file_name().alias("f")).agg(F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        return sum(r.lo is not None and r.lo <= middle <= r.hi for r in ranges)

    assert opened(f"{out}/sorted", "b") >= 14
    assert opened(f"{out}/both", "a") <= 8 and opened(f"{out}/both", "b") <= 8


def test_interleaved_empty_table(spark):
    out = scratch_path(spark, "t-morton")
    writers.write_interleaved(spark.createDataFrame([], "a bigint, b string"), out, ["a", "b"], 4)
    assert spark.read.parquet(out).count() == 0
