"""Streams: restarts, repeats, late rows and session gaps."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quality import split
from tidemark.scratch import scratch_path
from tidemark.sources.ingest import ingest_new
from tidemark.streaming import late as L
from tidemark.streaming import sinks as K
from tidemark.streaming import windows as W

BASE = dt.datetime(2024, 1, 1)


def at(*seconds):
    return [BASE + dt.timedelta(seconds=s) for s in seconds]


def frame(spark, rows):
    rows = [(i, t, k, Decimal(v)) for i, t, k, v in rows]
    return spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, k string, v decimal(12,2)")


def test_session_gap_is_inclusive(spark):
    times = at(0, 60, 121, 121)
    df = frame(spark, [(i, t, "a", 1) for i, t in enumerate(times)])
    got = W.sessions(df, "k", "ts", 60, ["ts", "id"], "v").orderBy("session_start").collect()
    assert [(r.rows, r.duration_sec) for r in got] == [(2, 60.0), (2, 0.0)]


def test_surge_needs_more_than_five_a_minute(spark):
    df = frame(spark, [(i, t, "a", 1) for i, t in enumerate(at(*range(0, 12, 2)))] + [(9, BASE, "b", 1)])
    got = {r.k: r.is_surge for r in W.sessions(df, "k", "ts", 60, ["ts", "id"], "v").collect()}
    assert got == {"a": True, "b": False}


def test_late_classes(spark):
    rows = [(0, 0), (1, 5400), (2, 5000), (3, 3700), (4, 10)]
    df = spark.createDataFrame([(i, BASE + dt.timedelta(seconds=s), BASE + dt.timedelta(hours=i)) for i, s in rows], "id bigint, ts timestamp_ntz, arrival timestamp_ntz")
    got = {r.id: (r.status, r.lag_sec) for r in L.classify_late(df, "ts", ["arrival", "id"], 600, 3600).collect()}
    assert got == {
        0: ("on_time", None), 1: ("on_time", None), 2: ("on_time", None), 3: ("late_open", 1100.0), 4: ("dropped", 4790.0)
    }


def test_ingest_takes_each_file_and_key_once(spark):
    base = scratch_path(spark, "t-ingest")
    schema = "id bigint, ts timestamp_ntz, k string, v decimal(12,2)"
    args = (spark, f"{base}/in", f"{base}/out", f"{base}/cp", schema, ["id"], ["ts"])
    frame(spark, [(i, t, "a", 1) for i, t in enumerate(at(0, 1, 2))]).write.parquet(f"{base}/in", mode="append")
    assert ingest_new(*args) == 3
    assert ingest_new(*args) == 0
    frame(spark, [(i, t, "b", 1) for i, t in zip((2, 3, 3), at(9, 9, 8))]).write.parquet(f"{base}/in", mode="append")
    assert ingest_new(*args) == 1
    got = {r.id: r.k for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {0: "a", 1: "a", 2: "a", 3: "b"}


def test_stream_to_table_twice_adds_nothing(spark):
    base = scratch_path(spark, "t-copy")
    df = frame(spark, [(i, t, "a", 1) for i, t in enumerate(at(0, 1))])
    df.write.parquet(f"{base}/in")
    for _ in range(2):
        K.stream_to_table(K.read_stream(spark, f"{base}/in", df.schema), f"{base}/out", f"{base}/cp")
    assert spark.read.parquet(f"{base}/out").count() == 2


def test_stream_dedupe_within_watermark(spark):
    base = scratch_path(spark, "t-twice")
    df = frame(spark, [(1, BASE, "a", 1), (1, BASE, "a", 1), (2, BASE, "a", 1)])
    df.write.parquet(f"{base}/in")
    once = K.dedupe_stream(K.read_stream(spark, f"{base}/in", df.schema), ["id"], "ts", "1 minute")
    K.stream_to_table(once, f"{base}/out", f"{base}/cp")
    assert spark.read.parquet(f"{base}/out").count() == 2


def test_stream_equals_batch_on_closed_windows(spark):
    base = scratch_path(spark, "t-twin")
    df = frame(spark, [(i, t, "ab"[i % 2], 1) for i, t in enumerate(at(*range(0, 4000, 37)))])
    df.write.parquet(f"{base}/in")
    aggs = lambda: {"rows": F.count(F.lit(1))}
    timed = W.event_time(K.read_stream(spark, f"{base}/in", df.schema), "ts", "1 minute")
    live = K.drain(W.tumbling(timed, "ts", "10 minutes", ["k"], aggs()), "append", "t-twin")
    mark = max(r.ts for r in df.collect()) - dt.timedelta(minutes=1)
    twin = W.tumbling(df, "ts", "10 minutes", ["k"], aggs()).filter(F.col("window_end") <= F.lit(mark).cast("timestamp_ntz"))
    key = lambda rows: sorted((r.window_start.replace(tzinfo=None), r.k, r.rows) for r in rows)
    local = live.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    assert key(local.collect()) == key(twin.collect()) != []


def test_scratch_refuses_local_folders_on_a_cluster(spark, monkeypatch):
    class Fake:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Fake, "x")


def test_split_is_a_partition(spark):
    df = frame(spark, [(i, t, None if i % 3 else "a", i) for i, t in enumerate(at(*range(9)))])
    valid, bad = split(df, [("key", F.col("k").isNotNull()), ("value", F.col("v") > 3)])
    assert valid.count() + bad.count() == 9
