"""Event-time windows, late rows, live figures and stream sinks.

Streaming queries take all available input, end, and are compared on closed windows only.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import EV, SALES, events, mean, query, total
from tidemark.functions.amounts import exact
from tidemark.operators.sets import stack
from tidemark.scratch import scratch_path
from tidemark.streaming import gate as G
from tidemark.streaming import late as L
from tidemark.streaming import live as V
from tidemark.streaming import sinks as K
from tidemark.streaming import windows as W
from tidemark.tables import SCHEMAS, sales, table


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream with a decimal value."""
    raw = K.read_stream(spark, f"{sf_dir}/events*.parquet", SCHEMAS["events"])
    return raw.withColumn("value", exact("value"))


def aggs() -> dict:
    return {
        "rows": F.count(F.lit(1)),
        "sum_value": F.round(F.sum("value"), 2).cast("double"),
    }


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Zoned instants back to local time (UTC)."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_RUNNING = f"WITH {EV} SELECT event_type, COUNT(*) AS rows, {total('value')} AS sum_value, {mean('value')} AS avg_value FROM ev GROUP BY event_type"


@query(_RUNNING)
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.running_counts(events(spark, sf_dir), ["event_type"], "value")


@query(_RUNNING)
def stream_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.drain(V.running_counts(stream(spark, sf_dir), ["event_type"], "value"), "complete", "running")


_TUMBLING = f"""WITH {EV}, w AS (SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type,
COUNT(*) AS rows, {total('value')} AS sum_value FROM ev GROUP BY ALL) SELECT * FROM w"""
_CLOSED = " WHERE window_end <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE"


@query(_TUMBLING)
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tumbling(events(spark, sf_dir), "ts", "1 hour", ["event_type"], aggs())


@query(_TUMBLING + _CLOSED)
def stream_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = W.event_time(stream(spark, sf_dir), "ts", "10 minutes")
    out = K.drain(W.tumbling(timed, "ts", "1 hour", ["event_type"], aggs()), "append", "tumbling")
    return plain(out, "window_start", "window_end")


_TOP = """WITH c AS (SELECT date_trunc('day', ts) AS window_start, user_id, COUNT(*) AS rows FROM events GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY window_start ORDER BY rows DESC, user_id) AS INTEGER) AS place FROM c)
SELECT * FROM r WHERE place <= 3"""


@query(_TOP)
def top_keys_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_in_window(table(spark, sf_dir, "events"), "ts", "1 day", "user_id", 3)


@query(_TOP + " AND window_start + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_top_keys_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts come from the stream; a closed window is ranked as it is emitted."""
    timed = W.event_time(stream(spark, sf_dir), "ts", "10 minutes")
    counted = W.tumbling(timed, "ts", "1 day", ["user_id"], {"rows": F.count(F.lit(1))})

    def best(batch: DataFrame) -> DataFrame:
        return W.rank_in_window(batch, "user_id", 3)

    return plain(K.drain(counted, "append", "top", best), "window_start")


_SLIDING = f"""WITH {EV}, s AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) - k * INTERVAL 2 HOUR AS window_start, value FROM ev, (VALUES (0), (1), (2)) t(k)),
w AS (SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, COUNT(*) AS rows, {total('value')} AS sum_value FROM s GROUP BY window_start)
SELECT * FROM w"""


@query(_SLIDING)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sliding(events(spark, sf_dir), "ts", "6 hours", "2 hours", [], aggs())


@query(_SLIDING + _CLOSED)
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = W.event_time(stream(spark, sf_dir), "ts", "10 minutes")
    out = K.drain(W.sliding(timed, "ts", "6 hours", "2 hours", [], aggs()), "append", "sliding")
    return plain(out, "window_start", "window_end")


GAP = 6 * 3600
_SESSIONS = f"""{EV}, g AS (SELECT *, lag(ts) OVER w AS prev FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, SUM(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > {GAP}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT user_id, MIN(ts) AS session_start, MAX(ts) AS session_end, COUNT(*) AS rows, SUM(value) AS v,
  (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1000000 AS duration_sec FROM r GROUP BY user_id, run),
sess AS (SELECT user_id, session_start, session_end, rows, CAST(v AS DOUBLE) AS total_value, duration_sec, rows / greatest(duration_sec / 60, 1.0) AS per_minute,
  rows / greatest(duration_sec / 60, 1.0) > 5 AS is_surge FROM s)"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.sessions(events(spark, sf_dir), "user_id", "ts", GAP, ["ts", "event_id"], "value")


@query(f"WITH {_SESSIONS} SELECT * FROM sess")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).withColumn("total_value", F.col("total_value").cast("double"))


@query(f"WITH {_SESSIONS} SELECT * FROM sess WHERE session_end + INTERVAL {GAP} SECOND <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = W.event_time(stream(spark, sf_dir), "ts", "10 minutes")
    out = K.drain(W.sessions_stream(timed, "user_id", "ts", f"{GAP} seconds", "value"), "append", "sessions")
    return plain(out, "session_start", "session_end").withColumn("total_value", F.col("total_value").cast("double"))


@query(f"""WITH {_SESSIONS} SELECT COUNT(*) AS sessions, CAST(SUM(CAST(duration_sec * 1000000 AS BIGINT)) AS DOUBLE) / COUNT(*) / 1000000 AS avg_duration_sec,
MAX(duration_sec) AS max_duration_sec, COUNT(*) FILTER (WHERE is_surge) AS surges, SUM(rows) / COUNT(*) AS avg_rows,
CAST(ROUND(SUM(CAST(total_value AS DECIMAL(22,2))), 2) AS DOUBLE) AS total_value FROM sess""")
def session_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.session_stats(_sessions(spark, sf_dir))


_ARRIVAL = "ts + CASE WHEN event_id % 20 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 SECOND END AS arrival"


@query(f"""SELECT CAST(arrival - ts > INTERVAL 1 MINUTE AS BOOLEAN) AS is_late, COUNT(*) AS rows, MAX(arrival) AS last_arrival
FROM (SELECT ts, {_ARRIVAL} FROM events) GROUP BY 1""")
def derived_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = L.with_arrival(table(spark, sf_dir, "events"), "ts", "event_id")
    late = F.col("arrival") - F.col("ts") > F.expr("interval 1 minute")
    return df.groupBy(late.alias("is_late")).agg(F.count(F.lit(1)).alias("rows"), F.max("arrival").alias("last_arrival"))


_LATE = f"""{EV}, a AS (SELECT *, {_ARRIVAL} FROM ev), m AS (SELECT *, MAX(epoch_us(ts)) OVER (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) - 1800000000 AS mark, epoch_us(ts) AS us FROM a),
c AS (SELECT event_id, value, CASE WHEN us >= mark THEN 'on_time' WHEN (us // 3600000000 + 1) * 3600000000 > mark THEN 'late_open' ELSE 'dropped' END AS status,
CASE WHEN us < mark THEN (mark - us) / 1000000 END AS lag_sec FROM m)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = L.with_arrival(events(spark, sf_dir).select("event_id", "ts", "value"), "ts", "event_id")
    return L.classify_late(df, "ts", ["arrival", "event_id"], 1800, 3600)


@query(f"WITH {_LATE} SELECT event_id, status, lag_sec FROM c")
def late_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("event_id", "status", "lag_sec")


@query(f"WITH {_LATE} SELECT status, COUNT(*) AS rows, MAX(lag_sec) AS max_lag_sec, {total('value')} AS sum_value FROM c GROUP BY status")
def lateness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lateness_summary(_classified(spark, sf_dir), "value")


# Ends of the arrival chunks fed one after another; the last chunk is open.
CHUNKS = ("2024-01-10", "2024-01-20", None)


@query(f"""WITH a AS (SELECT *, {_ARRIVAL} FROM events), p AS (SELECT *, CASE WHEN arrival < TIMESTAMP '2024-01-10' THEN 0 WHEN arrival < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END AS chunk FROM a),
k AS (SELECT chunk, MAX(MAX(ts)) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 30 MINUTE AS mark FROM p GROUP BY chunk)
SELECT CASE WHEN COALESCE(ts < mark, FALSE) THEN 'late' ELSE 'kept' END AS part, COUNT(*) AS rows, CAST(SUM(event_id) AS BIGINT) AS sum_id FROM p JOIN k USING (chunk) GROUP BY 1""")
def stream_late_side_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows arrive late (see derived arrivals) in three rounds; the stragglers are set aside."""
    df = L.with_arrival(table(spark, sf_dir, "events"), "ts", "event_id").drop("props", "value")
    base = scratch_path(spark, "late")
    for source in _in_rounds(spark, df, "arrival", base):
        L.split_late(source, "ts", "30 minutes", f"{base}/out", f"{base}/checkpoint")
    parts = [spark.read.parquet(f"{base}/out/{p}").select(F.lit(p).alias("part"), "event_id") for p in ("kept", "late")]
    return stack(parts).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("sum_id"))


@query("SELECT COUNT(DISTINCT user_id) AS active_users FROM events WHERE event_type = 'view' AND ts >= (SELECT MAX(ts) FROM events) - INTERVAL 24 HOUR")
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return V.active_users(df, "ts", "user_id", "24 hours", V.latest(df, "ts"), F.col("event_type") == "view")


@query("""WITH s AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS window_start FROM events, (VALUES (0), (1), (2), (3)) t(k))
SELECT window_start, TRUE AS within_bound FROM s WHERE window_start + INTERVAL 24 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY window_start""")
def stream_active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch of a sliding window must be within 15 % of the exact count."""
    timed = W.event_time(stream(spark, sf_dir), "ts", "10 minutes")
    rough = plain(K.drain(V.active_users_stream(timed, "ts", "user_id", "24 hours", "6 hours"), "append", "active"), "window_start")
    exact = W.sliding(table(spark, sf_dir, "events"), "ts", "24 hours", "6 hours", [], {"exact": F.count_distinct("user_id")})
    near = F.abs(F.col("active_users") - F.col("exact")) <= F.col("exact") * 0.15 + 1
    return rough.join(exact.select("window_start", "exact"), "window_start").select("window_start", near.alias("within_bound"))


@query("""WITH m AS (SELECT MAX(ts) AS as_of FROM events), c AS (SELECT user_id, COUNT(*) FILTER (WHERE ts >= as_of - INTERVAL 72 HOUR) AS recent,
COUNT(*) FILTER (WHERE ts < as_of - INTERVAL 72 HOUR) AS before FROM events, m WHERE ts >= as_of - INTERVAL 72 HOUR - INTERVAL 72 HOUR GROUP BY user_id)
SELECT user_id, recent, before, (recent - before) / greatest(before, 1) AS score FROM c ORDER BY score DESC, recent DESC, user_id LIMIT 10""")
def trending_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return V.trending(df, "ts", "user_id", "72 hours", V.latest(df, "ts"), 10)


@query("""SELECT event_type, COUNT(*) AS rows, COUNT(DISTINCT user_id) AS users FROM events
WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 10 HOUR GROUP BY event_type""")
def recent_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return V.recent_by(df, "ts", "event_type", "user_id", "10 hours", V.latest(df, "ts"))


@query("SELECT date_trunc('minute', ts) AS minute, event_type, COUNT(*) AS rows FROM events GROUP BY ALL")
def events_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.per_minute(table(spark, sf_dir, "events"), "ts", ["event_type"])


@query(f"""WITH {EV}, w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, {mean('value')} AS window_mean, SUM(value) AS s, COUNT(value) AS n FROM ev GROUP BY ALL),
b AS (SELECT *, CAST(SUM(s) OVER f AS DOUBLE) / SUM(n) OVER f AS base_mean FROM w WINDOW f AS (PARTITION BY event_type ORDER BY window_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT window_start, event_type, window_mean, base_mean, COALESCE(window_mean > 1.2 * base_mean, FALSE) AS is_surge FROM b""")
def surge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.surge(events(spark, sf_dir), "ts", "6 hours", "event_type", "value", 1.2, 4)


#: Windows that have closed: their end lies at or before the newest event less the ten-minute watermark.
_CLOSED = "window_start + INTERVAL 6 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE"


_STREAM_SURGE = f"""WITH {EV}, w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, {mean('value')} AS window_mean, SUM(value) AS s, COUNT(value) AS n FROM ev GROUP BY ALL),
b AS (SELECT *, CAST(SUM(s) OVER f AS DOUBLE) / SUM(n) OVER f AS base_mean FROM w WHERE {_CLOSED} WINDOW f AS (PARTITION BY event_type ORDER BY window_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
SELECT window_start, event_type, window_mean, base_mean, COALESCE(window_mean > 1.2 * base_mean, FALSE) AS is_surge FROM b"""


@query(_STREAM_SURGE)
def stream_surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream sums windows as they close; surges are flagged over the table of closed windows."""
    timed = W.event_time(stream(spark, sf_dir).withColumn("value", exact("value")), "ts", "10 minutes")
    closed = K.drain(V.window_sums(timed, "ts", "6 hours", "event_type", "value"), "append", "surge")
    return V.flag_surges(plain(closed, "window_start"), "event_type", 1.2, 4)


def _in_rounds(spark: SparkSession, df: DataFrame, column: str, base: str):
    """Land ``df`` in three rounds by ``column``, and give the stream of the landing folder after each."""
    start = F.lit(None)
    for i, end in enumerate(CHUNKS):
        stop = F.lit(end).cast("timestamp_ntz")
        df.filter(F.coalesce(F.col(column) >= start, F.lit(True)) & F.coalesce(F.col(column) < stop, F.lit(True))).write.parquet(f"{base}/landing/chunk{i}")
        yield K.read_stream(spark, f"{base}/landing/*", df.schema)
        start = stop


@query(_STREAM_SURGE)
def stream_surge_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land in three rounds, the stream restarts for each, and every batch flags the windows it closes."""
    df, base = events(spark, sf_dir).select("event_id", "ts", "event_type", "value"), scratch_path(spark, "surge-by-batch")
    for source in _in_rounds(spark, df, "ts", base):
        flags = V.surge_stream(W.event_time(source, "ts", "10 minutes"), "ts", "6 hours", "event_type", "value", 1.2, 4, f"{base}/out", f"{base}/checkpoint")
    return plain(flags, "window_start")


@query(f"""SELECT * FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, COUNT(*) AS rows, COUNT(*) FILTER (WHERE event_type = 'click') AS click_rows,
COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchase_rows, COUNT(*) FILTER (WHERE event_type IN ('click', 'purchase')) / COUNT(*) AS hub_share
FROM events GROUP BY 1) WHERE {_CLOSED}""")
def stream_hub_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = W.event_time(stream(spark, sf_dir), "ts", "10 minutes")
    return plain(K.drain(V.hub_monitor(timed, "ts", "6 hours", "event_type", ["click", "purchase"]), "append", "hubs"), "window_start")


@query(f"""WITH {SALES}, c AS (SELECT from_nation, started AS moment, 1 AS d FROM sales UNION ALL SELECT from_nation, ended, -1 FROM sales)
SELECT from_nation, CAST(SUM(d) AS BIGINT) AS active FROM c WHERE moment <= TIMESTAMP '1998-01-01' GROUP BY from_nation""")
def active_trips_per_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sales(spark, sf_dir)
    starts = df.select("from_nation", F.col("started").alias("moment"), F.lit(1).alias("d"))
    ends = df.select("from_nation", F.col("ended").alias("moment"), F.lit(-1).alias("d"))
    log = stack([starts, ends]).filter(F.col("moment") <= F.lit("1998-01-01").cast("timestamp_ntz"))
    return V.current_state(log, "from_nation", F.col("d"))


@query("SELECT user_id, CAST(SUM(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END) AS BIGINT) AS active FROM events GROUP BY user_id")
def stream_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return K.drain(V.current_state(stream(spark, sf_dir), "user_id", delta), "update", "state", keys=["user_id"])


@query("""SELECT CAST(CAST('0x' || md5(CAST(user_id AS VARCHAR))[1:8] AS BIGINT) % 6 AS INTEGER) AS partition_no, COUNT(*) AS rows, COUNT(DISTINCT user_id) AS keys
FROM events GROUP BY 1""")
def key_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.key_partitions(table(spark, sf_dir, "events"), "user_id", 6)


@query("SELECT event_type, COUNT(*) AS rows, CAST(SUM(event_id) AS BIGINT) AS sum_id FROM events GROUP BY event_type")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are delivered twice."""
    df = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    landing = scratch_path(spark, "twice")
    df.unionByName(df.filter("event_type = 'error'")).write.parquet(landing)
    out = scratch_path(spark, "once")
    once = K.dedupe_stream(K.read_stream(spark, landing, df.schema), ["event_id"], "ts", "1 hour")
    K.stream_to_table(once, out, scratch_path(spark, "once-checkpoint"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("sum_id"))


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_into_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = K.read_stream(spark, f"{sf_dir}/events*.parquet", SCHEMAS["events"])
    out = scratch_path(spark, "copied")
    K.stream_to_table(source.drop("props"), out, scratch_path(spark, "copied-checkpoint"))
    return spark.read.parquet(out)


@query("""SELECT COALESCE(c_mktsegment, '-') AS segment, event_type, COUNT(*) AS rows FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY ALL""")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    rich = K.enrich_stream(stream(spark, sf_dir), dim, "user_id").withColumn("segment", F.coalesce("segment", F.lit("-")))
    return K.drain(rich.groupBy("segment", "event_type").agg(F.count(F.lit(1)).alias("rows")), "complete", "enriched")


#: The share of rows over this value is small; the last round also lacks every other value.
MOST_VALUE = 150


@query(f"""WITH e AS (SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 'halted' WHEN value <= {MOST_VALUE} THEN 'table' ELSE 'quarantine' END AS part FROM events)
SELECT part, COUNT(*) AS rows, CAST(SUM(event_id) AS BIGINT) AS sum_id FROM e GROUP BY part""")
def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events land in three rounds; the gate sets bad rows aside and halts the stream before the last round's batch."""
    df = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    spoilt = (F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("event_id") % 2 == 1)
    df, base = df.withColumn("value", F.when(~spoilt, F.col("value"))), scratch_path(spark, "gate")
    rules = [("value_given", F.col("value").isNotNull()), ("value_in_range", F.col("value") <= MOST_VALUE)]
    for source in _in_rounds(spark, df, "ts", base):
        try:
            G.gate_stream(source, f"{base}/out", f"{base}/checkpoint", "events", rules)
        except StreamingQueryException as halted:
            if "quality gate open" not in str(halted):
                raise
    sink = G.GateSink(spark, f"{base}/out", "events", rules)
    parts = [sink.read(p, df.schema).select(F.lit(p).alias("part"), "event_id") for p in ("table", "quarantine", "halted")]
    return stack(parts).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("sum_id"))


_PANES = f"""WITH {EV}, s AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS window_start, value, user_id FROM ev, (VALUES (0), (1), (2), (3)) t(k)),
w AS (SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, COUNT(*) AS rows, {total('value')} AS sum_value, COUNT(DISTINCT user_id) AS users FROM s GROUP BY window_start)
SELECT * FROM w"""


@query(_PANES)
def sliding_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct users of sliding windows, from panes."""
    out = W.sliding_panes(events(spark, sf_dir), "ts", "24 hours", "6 hours", "value", "user_id")
    return out.withColumn("sum_value", F.round("sum_value", 2).cast("double"))


@query(_PANES + " WHERE window_start + INTERVAL 24 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_sliding_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = W.event_time(stream(spark, sf_dir), "ts", "10 minutes")
    out = K.drain(W.sliding_panes(timed, "ts", "24 hours", "6 hours", "value", "user_id"), "append", "panes")
    return plain(out, "window_start", "window_end").withColumn("sum_value", F.round("sum_value", 2).cast("double"))


@query("""SELECT * FROM (SELECT date_trunc('minute', ts) AS minute, event_type, COUNT(*) AS rows FROM events GROUP BY ALL)
WHERE minute + INTERVAL 1 MINUTE <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per minute and type, as minutes close."""
    return plain(K.drain(V.per_minute(W.event_time(stream(spark, sf_dir), "ts", "10 minutes"), "ts", ["event_type"]), "append", "per-minute"), "minute")


@query(f"WITH {EV} SELECT event_type, COUNT(*) AS rows, {total('value')} AS sum_value, {mean('value')} AS avg_value FROM ev GROUP BY event_type")
def stream_value_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value so far by type: every batch writes the types it changed, and the newest row of each counts."""
    df, base = events(spark, sf_dir).select("ts", "event_type", "value"), scratch_path(spark, "by-type")
    for source in _in_rounds(spark, df, "ts", base):
        out = K.drain(V.running_counts(source, ["event_type"], "value"), "update", "by-type", keys=["event_type"])
    return out
