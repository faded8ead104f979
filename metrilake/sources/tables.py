"""Metric views over the driver's tables (the test inputs).

``events`` becomes gauge and counter families, ``customer``/``orders`` become
info metrics and ``lineitem`` a cumulative histogram.  The same definitions
exist as SQL text for the DuckDB oracle (``oracle_views``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import TS, VALUE, MetricFrame, to_ms
from ..operators.select import from_table
from ..operators.series import running_sum

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def m_gauge(spark, sf_dir) -> MetricFrame:
    """Gauge per (event_type, user_id): the event value."""
    ev = table(spark, sf_dir, "events")
    return from_table(ev, ["event_type", "user_id"], "ts", "value")


def m_counter(spark, sf_dir) -> MetricFrame:
    """Counter per event_type: running sum of value in (ts, event_id) order.

    The running sum is split by (event_type, day) and stitched with per-day
    totals, so the five hot event types never sit in five tasks.
    """
    ev = table(spark, sf_dir, "events").select("event_type", "event_id", to_ms("ts").alias(TS), "value")
    d = running_sum(ev, ["event_type"], TS, ["event_id"], F.col("value"), VALUE + "_c")
    return from_table(d.select("event_type", TS, F.col(VALUE + "_c").alias(VALUE)), ["event_type"])


def m_user_counter(spark, sf_dir) -> MetricFrame:
    """Counter per (event_type, user_id): running sum of value."""
    ev = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", to_ms("ts").alias(TS), "value")
    d = running_sum(ev, ["event_type", "user_id"], TS, ["event_id"], F.col("value"), "_c")
    return from_table(d.select("event_type", "user_id", TS, F.col("_c").alias(VALUE)), ["event_type", "user_id"])


def m_counter_reset(spark, sf_dir) -> MetricFrame:
    """Counter per event_type that restarts every day (reset handling)."""
    ev = (table(spark, sf_dir, "events")
          .select("event_type", "event_id", to_ms("ts").alias(TS), "value", F.to_date("ts").alias("_day")))
    d = running_sum(ev, ["event_type", "_day"], TS, ["event_id"], F.col("value"), "_c", bucket_ms=3_600_000)
    return from_table(d.select("event_type", TS, F.col("_c").alias(VALUE)), ["event_type"])


def m_state(spark, sf_dir) -> MetricFrame:
    """0/1 health per user: 0 on an error event, else 1."""
    ev = table(spark, sf_dir, "events")
    d = ev.select("user_id", "ts", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("value"))
    return from_table(d, ["user_id"])


def m_order_info(spark, sf_dir) -> MetricFrame:
    """1-valued info per order at its date: custkey → priority/status (duplicates per key)."""
    o = table(spark, sf_dir, "orders")
    d = o.select("o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate", F.lit(1.0).alias("value"))
    return from_table(d, ["o_custkey", "o_orderpriority", "o_orderstatus"], ts="o_orderdate")


def m_order_value(spark, sf_dir) -> MetricFrame:
    """Gauge per customer: order total price at order date."""
    o = table(spark, sf_dir, "orders")
    return from_table(o.select("o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice"),
                      ["o_custkey", "o_orderstatus"], ts="o_orderdate", value="o_totalprice")


HIST_BOUNDS = (("5", 5.0), ("10", 10.0), ("25", 25.0), ("50", 50.0), ("+Inf", float("inf")))


def m_bucket(spark, sf_dir) -> MetricFrame:
    """Cumulative histogram of l_quantity per (returnflag, linestatus, ship month) with ``le``.

    One sample per month and series; each lineitem row adds 1 to every bucket
    whose bound it is below (an explode of ≤ 5 bounds, then a grouped sum).
    """
    li = table(spark, sf_dir, "lineitem")
    bounds = F.array(*[F.struct(F.lit(le).alias("le"), F.lit(b).alias("b")) for le, b in HIST_BOUNDS])
    d = (li.select("l_returnflag", "l_linestatus", "l_quantity",
                   F.date_trunc("month", "l_shipdate").alias("_m"), F.explode(bounds).alias("_x"))
           .filter(F.col("l_quantity") <= F.col("_x.b"))
           .groupBy("l_returnflag", "l_linestatus", F.col("_x.le").alias("le"), "_m")
           .agg(F.count(F.lit(1)).cast("double").alias("value")))
    return from_table(d, ["l_returnflag", "l_linestatus", "le"], ts="_m")


def m_gauge_ns(spark, sf_dir) -> MetricFrame:
    """Gauge per (namespace, user_id, event_type); the namespace is derived from the user."""
    ev = table(spark, sf_dir, "events")
    d = ev.select(F.concat(F.lit("ns-"), (F.col("user_id") % 5).cast("string")).alias("namespace"),
                  "user_id", "event_type", "ts", "value")
    return from_table(d, ["namespace", "user_id", "event_type"])


def m_user_count(spark, sf_dir) -> MetricFrame:
    """Counter per (event_type, user_id): running count of events (the ``_count`` half of
    a summary whose ``_sum`` is :func:`m_user_counter`)."""
    ev = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", to_ms("ts").alias(TS))
    d = running_sum(ev, ["event_type", "user_id"], TS, ["event_id"], F.lit(1.0), "_c")
    return from_table(d.select("event_type", "user_id", TS, F.col("_c").alias(VALUE)), ["event_type", "user_id"])


def app_intervals(spark, sf_dir) -> DataFrame:
    """Job and stage spans per application (a user of ``events``): a job is a user's day,
    from its first to its last event; a stage is the same for one event type.
    Columns ``(app, kind, name, start_ts, end_ts)`` with epoch-ms bounds."""
    ev = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("app"), "event_type",
                                               F.to_date("ts").cast("string").alias("_day"),
                                               to_ms("ts").alias(TS))
    jobs = (ev.groupBy("app", "_day").agg(F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"))
              .select("app", F.lit("job").alias("kind"), F.concat_ws("/", "app", "_day").alias("name"),
                      "start_ts", "end_ts"))
    stages = (ev.groupBy("app", "event_type", "_day").agg(F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"))
                .select("app", F.lit("stage").alias("kind"), F.concat_ws("/", "app", "event_type", "_day").alias("name"),
                        "start_ts", "end_ts"))
    return jobs.unionByName(stages)
