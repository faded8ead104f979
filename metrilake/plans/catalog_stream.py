"""Registered streaming queries.

Each query streams ``events`` from its Parquet file with an ``availableNow``
trigger through the streaming operator into a table in the shared folder and
returns that table, so the batch oracle can check the streamed result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api as A
from ..frame import TS, VALUE, MetricFrame, to_ms
from ..sources import tables as T
from ..streaming import stream as X
from .catalog import rnd, G6H, out

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def event_stream(spark: SparkSession, sf: str, max_files: int | None = None) -> DataFrame:
    """``events`` as a file stream: (event_type, user_id, event_id, ts ms, value, event_time)."""
    schema = T.table(spark, sf, "events").schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.option("pathGlobFilter", "events.parquet").parquet(sf.rstrip("/"))
    s = s.select("event_type", F.col("user_id").cast("string").alias("user_id"), "event_id",
                 to_ms("ts").alias(TS), "value")
    return X.with_event_time(s)


def event_batches(spark: SparkSession, sf: str, order: str = TS, parts: int = 5, end: int | None = None) -> DataFrame:
    """``events`` replayed in micro-batches along a column (``replayed``, with its end row if ``end`` is given)."""
    e = T.table(spark, sf, "events").select("event_type", F.col("user_id").cast("string").alias("user_id"), "event_id", to_ms("ts").alias(TS), "value")
    return X.with_event_time(X.replayed(spark, e, order, parts, "events", end))


H6 = 21_600_000
D1 = 86_400_000


@register("x1_stream_eval", f"""
SELECT event_type, (epoch_us(ts) // 1000 + {H6} - 1) // {H6} * {H6} AS eval_ts, arg_max(value, ts) AS last,
       COUNT(*) AS samples, ROUND(SUM(value), 6) AS sum FROM events GROUP BY ALL""")
def q_x1_stream_eval(spark, sf):
    """Tumbling 6h evaluation of a stream with a 30m watermark, update mode."""
    s = X.with_delay(event_stream(spark, sf), "30m")
    r = X.run_to_table(spark, X.stream_eval(s, ["event_type"], "6h"), "x1", "update", ["event_type", "eval_ts"])
    return r.select("event_type", "eval_ts", "last", "samples", rnd("sum", 6).alias("sum"))


@register("x2_stream_range", f"""
WITH w AS (SELECT e.event_type, e.value, epoch_us(e.ts) // 1000 AS t, k.i FROM events e, range(0, 5) k(i)),
x AS (SELECT event_type, value, t, (t + {H6} - 1) // {H6} * {H6} + i * {H6} AS eval_ts FROM w),
y AS (SELECT *, LAG(value) OVER (PARTITION BY event_type, eval_ts ORDER BY t, value) AS before FROM x WHERE eval_ts - {D1} <= t)
SELECT event_type, eval_ts, MIN(value) AS min, MAX(value) AS max, COUNT(*) AS samples, ROUND(arg_max(value, t) - arg_min(value, t), 6) AS delta,
       ROUND(arg_max(value, t) - arg_min(value, t) + SUM(CASE WHEN value < before THEN before ELSE 0 END), 6) AS increase FROM y GROUP BY event_type, eval_ts""")
def q_x2_stream_range(spark, sf):
    """Sliding ``[1d]`` every 6h over a stream of five batches, each window as the 30m watermark passes it, those that the
    last samples are in behind the stream's end (X2)."""
    s = X.with_delay(event_batches(spark, sf, end=D1 + H6 + 1_800_000), "30m")
    r = X.run_to_table(spark, X.stream_range(s, ["event_type"], "1d", "6h"), "x2")
    return r.select("event_type", "eval_ts", "min", "max", "samples", rnd("delta", 6).alias("delta"), rnd("increase", 6).alias("increase"))


@register("x4_dedup_stream", """
SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts, value FROM events""")
def q_x4_dedup_stream(spark, sf):
    """The same samples delivered twice, repeated (series, ts) dropped within the watermark."""
    a = event_stream(spark, sf)
    b = event_stream(spark, sf)
    s = X.with_delay(a.unionByName(b), "30m")
    d = X.dedup_stream(s, ["event_type", "user_id"])
    r = X.run_to_table(spark, d, "x4")
    return r.select("event_type", "user_id", TS, VALUE)


@register("x8_dedup_replicas_stream", """
SELECT event_type, COUNT(DISTINCT (user_id, ts // 60000)) AS samples FROM (
  SELECT event_type, user_id, epoch_us(ts) // 1000 AS ts FROM events UNION ALL
  SELECT event_type, user_id, epoch_us(ts) // 1000 + 1000 FROM events) GROUP BY event_type""")
def q_x8_dedup_replicas_stream(spark, sf):
    """Two replicas (b = a shifted by 1s) reduced to one sample per series and 1m slot."""
    a = event_stream(spark, sf).withColumn("replica", F.lit("a"))
    b = (event_stream(spark, sf).withColumn("replica", F.lit("b"))
         .withColumn(TS, F.col(TS) + F.lit(1000)).withColumn(X.EVENT_TIME, F.timestamp_millis(F.col(TS))))
    s = X.with_delay(a.unionByName(b), "30m")
    d = X.dedup_stream(s, ["event_type", "user_id"], slot="1m")
    r = X.run_to_table(spark, d, "x8")
    # every surviving row counts: without dedup there are twice as many as events
    return r.groupBy("event_type").agg(F.count(F.lit(1)).alias("samples"))


JITTER_SQL = ("(SELECT event_type, event_id, epoch_us(ts) // 1000 - (event_id % 3) * 600000 AS ts, value FROM events)")


@register("x5_split_late", f"""
SELECT event_type, event_id, ts, value,
  COALESCE(ts < MAX(ts) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)
  AS out_of_order FROM {JITTER_SQL}""")
def q_x5_split_late(spark, sf):
    """Arrival-order check per series on a jittered stream of five batches: samples older than the newest seen are flagged."""
    s = event_batches(spark, sf, "event_id").withColumn(TS, F.col(TS) - (F.col("event_id") % 3) * F.lit(600_000))
    r = X.split_late_to_table(spark, s.drop("user_id", X.EVENT_TIME), ["event_type"], "event_id", "x5", block=1000)
    return r.select("event_type", "event_id", TS, VALUE, "out_of_order")


@register("x6_hold_stream", f"""
WITH a AS (SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts, value > 100 AS active FROM events),
r AS (SELECT *, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) AS pts,
             LAG(active) OVER (PARTITION BY user_id ORDER BY ts) AS pact FROM a),
n AS (SELECT *, CASE WHEN active AND (pact IS NULL OR NOT pact OR ts - pts > {2 * D1}) THEN 1 ELSE 0 END AS nr FROM r),
i AS (SELECT *, SUM(nr) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM n)
SELECT user_id, ts, CASE WHEN ts - MIN(ts) OVER (PARTITION BY user_id, isl) >= {D1} THEN 'firing' ELSE 'pending' END AS state,
       MIN(ts) OVER (PARTITION BY user_id, isl) AS active_at FROM i WHERE active""")
def q_x6_hold_stream(spark, sf):
    """Streaming ``for 1d`` per user on the condition value > 100, in five batches; a false or a 2d gap resets."""
    s = event_batches(spark, sf).select("user_id", TS, (F.col(VALUE) > 100).alias("active"), X.EVENT_TIME)
    r = X.run_to_table(spark, X.hold_stream(X.with_delay(s, "30m"), ["user_id"], "1d", "2d"), "x6")
    return r.select("user_id", TS, "state", "active_at")


@register("x9_lag_report", f"""
WITH e AS (SELECT * FROM events WHERE epoch_us(ts) // 1000 <= {G6H.end}),
h AS (SELECT event_type, MAX(epoch_us(ts) // 1000) / 1000.0 AS v FROM e GROUP BY event_type),
s AS (SELECT event_type, CAST(user_id % 2 AS VARCHAR) AS shard, MAX(epoch_us(ts) // 1000) / 1000.0 AS v
      FROM e GROUP BY ALL)
SELECT s.event_type, s.shard, {G6H.end} AS ts, ROUND(h.v - s.v, 3) AS value FROM h JOIN s USING (event_type)""")
def q_x9_lag_report(spark, sf):
    """Consumer lag: newest ingested time minus newest sent time per shard (X9, a group_right match)."""
    e = T.table(spark, sf, "events").select("event_type", (F.col("user_id") % 2).cast("string").alias("shard"), "ts")
    g = A.Grid.instant(G6H.end)
    ts_gauge = A.from_table(e.withColumn("value", to_ms("ts") / 1000.0), ["event_type", "shard"])
    highest = A.aggregate(A.last_over_time(ts_gauge, "60d", g), "max", by=["event_type"])
    sent = A.last_over_time(ts_gauge, "60d", g)
    return out(X.lag_report(highest, sent), 3)


@register("x9_lag_stream", """
WITH b AS (SELECT event_type, epoch_us(ts) // 1000 AS t, CAST(event_id // 200 AS BIGINT) AS batch FROM events WHERE event_id < 1000),
k AS (SELECT DISTINCT batch FROM b), s AS (SELECT DISTINCT event_type AS stream FROM b)
SELECT s.stream, k.batch * 1000 AS ts, ROUND((MAX(b.t) - MAX(b.t) FILTER (WHERE b.event_type = s.stream)) / 1000.0, 3) AS value
FROM s, k JOIN b ON b.batch <= k.batch GROUP BY s.stream, k.batch
HAVING COUNT(*) FILTER (WHERE b.event_type = s.stream AND b.batch = k.batch) > 0""")
def q_x9_lag_stream(spark, sf):
    """Lag per event type after each batch of a running stream, from what the batches' observations report."""
    e = T.table(spark, sf, "events").filter("event_id < 1000").select("event_type", "event_id", to_ms("ts").alias(TS))
    types = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    s = X.replayed(spark, e.withColumn("batch", F.floor(F.col("event_id") / 200)), "batch", [0, 1, 2, 3], "x9").drop("batch")
    highest, sent = X.observed_times(spark, s, "event_type", types, "x9")
    return out(X.lag_report(highest, sent), 3)


@register("x7_group_stream", f"""
WITH wm AS (SELECT MAX(epoch_us(ts) // 1000) - 1800000 AS w FROM events WHERE value > 100),
f AS (SELECT 'null' AS receiver, 'namespace=ns-' || CAST(user_id % 5 AS VARCHAR) AS group_key,
             (epoch_us(ts) // 1000) // {H6} AS slot, hash(CAST(user_id AS VARCHAR), event_type) AS fp
      FROM events WHERE value > 100),
g AS (SELECT receiver, group_key, slot, COUNT(DISTINCT fp) AS alerts, bit_xor(DISTINCT fp) AS dig
      FROM f WHERE (slot + 1) * {H6} <= (SELECT w FROM wm) GROUP BY ALL),
l AS (SELECT *, LAG(slot) OVER w AS ps, LAG(dig) OVER w AS pd FROM g WINDOW w AS (PARTITION BY receiver, group_key ORDER BY slot)),
c AS (SELECT *, (ps IS NULL OR ps <> slot - 1) AS new_run, (ps IS NULL OR ps <> slot - 1 OR pd <> dig) AS changed FROM l),
m AS (SELECT *, MAX(CASE WHEN changed THEN slot END) OVER (PARTITION BY receiver, group_key ORDER BY slot
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lc FROM c)
SELECT receiver, group_key, slot * {H6} + CASE WHEN new_run THEN 30000 ELSE 0 END AS notify_ts, alerts,
       CASE WHEN changed THEN 'update' ELSE 'repeat' END AS kind
FROM m WHERE changed OR ((slot - lc) * {H6} > 0 AND ((slot - lc) * {H6}) % {D1} = 0)""")
def q_x7_group_stream(spark, sf):
    """Streaming notification grouping (X7): values above 100 fire ``HighValue`` per (user, event type),
    routed by the route tree and grouped by namespace in 6h slots, repeat 1d, group_wait 30s,
    slots closed by the 30m watermark of the alert stream (its newest alert time − 30m)."""
    from ..operators import alerts as AL
    from . import configs as C
    s = X.with_delay(event_stream(spark, sf).filter(F.col(VALUE) > 100), "30m")
    s = s.select(F.lit("HighValue").alias("alertname"), F.lit("info").alias("severity"),
                 F.concat(F.lit("ns-"), (F.col("user_id").cast("bigint") % 5).cast("string")).alias("namespace"),
                 "user_id", "event_type", TS, X.EVENT_TIME)
    r = AL.route(s, C.ROUTE)
    g = X.group_notifications_stream(r, ["user_id", "event_type"], "6h", "1d", C.ROUTE["group_wait"])
    return X.run_to_table(spark, g, "x7").select("receiver", "group_key", "notify_ts", "alerts", "kind")
