"""Ingest-shaped inputs derived by Spark from the given tables.

Each builder has a DuckDB twin in ``catalog_ingest`` so the oracle sees the
same rows.  Nothing here is made up: every row comes from a table row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def pod_targets(spark: SparkSession, sf: str) -> DataFrame:
    """One discovered pod per customer, as a label map (relabel input)."""
    # a few splits of a small file hold many rows, each of which takes a list of rules: they are dealt to all tasks
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal", "c_mktsegment").hint("rebalance")
    pairs = {
        "__address__": F.concat(F.lit("10.0."), F.col("c_nationkey").cast("string"), F.lit("."),
                                F.col("c_custkey").cast("string"),
                                F.when(F.col("c_custkey") % 3 == 0, F.lit(":8080")).otherwise(F.lit(""))),
        "__meta_kubernetes_namespace": F.concat(F.lit("ns-"), F.col("c_nationkey").cast("string")),
        "__meta_kubernetes_pod_name": F.col("c_name"),
        "__meta_kubernetes_pod_annotation_jmx_prometheus_io_scrape":
            F.when(F.col("c_acctbal") >= 0, F.lit("true")).otherwise(F.lit("false")),
        "__meta_kubernetes_pod_annotation_jmx_prometheus_io_port":
            (F.lit(9000) + F.col("c_nationkey")).cast("string"),
        "__meta_kubernetes_pod_annotation_jmx_prometheus_io_path":
            F.when(F.col("c_mktsegment") == "BUILDING", F.lit("/jmx")).otherwise(F.lit("")),
        "__meta_kubernetes_pod_label_app": F.lower(F.col("c_mktsegment")),
        "__meta_kubernetes_pod_label_nation": F.col("c_nationkey").cast("string"),
    }
    m = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return c.select(F.col("c_custkey").alias("target_id"),
                    F.map_filter(m, lambda k, v: v != "").alias("labels"))


GRAPHITE_SQL = """
SELECT CASE event_type
  WHEN 'click' THEN 'user' || CAST(user_id AS VARCHAR) || '.app-' || CAST(user_id % 7 AS VARCHAR) || '.jvm.pools.heap.used'
  WHEN 'view' THEN 'user' || CAST(user_id AS VARCHAR) || '.app-' || CAST(user_id % 7 AS VARCHAR) || '.applicationMaster.numContainers'
  WHEN 'signup' THEN 'user' || CAST(user_id AS VARCHAR) || '.shuffleService.blockTransferRate.count'
  WHEN 'purchase' THEN 'user' || CAST(user_id AS VARCHAR) || '.app-' || CAST(user_id % 7 AS VARCHAR) || '.driver.spark.streaming.q' || CAST(user_id % 3 AS VARCHAR) || '.latency'
  ELSE 'user' || CAST(user_id AS VARCHAR) || '.app-' || CAST(user_id % 7 AS VARCHAR) || '.' || CAST(user_id % 4 AS VARCHAR) || '.executor.bytesRead.count'
END || ' ' || CAST(value AS VARCHAR) || ' ' || CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS value, event_id
FROM events
"""


def graphite_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One Graphite line per event; the event type picks the reporting source."""
    e = table(spark, sf, "events")
    u = F.col("user_id").cast("string")
    app = F.concat(F.lit(".app-"), (F.col("user_id") % 7).cast("string"))
    path = (F.when(F.col("event_type") == "click", F.concat(F.lit("user"), u, app, F.lit(".jvm.pools.heap.used")))
            .when(F.col("event_type") == "view", F.concat(F.lit("user"), u, app, F.lit(".applicationMaster.numContainers")))
            .when(F.col("event_type") == "signup", F.concat(F.lit("user"), u, F.lit(".shuffleService.blockTransferRate.count")))
            .when(F.col("event_type") == "purchase",
                  F.concat(F.lit("user"), u, app, F.lit(".driver.spark.streaming.q"), (F.col("user_id") % 3).cast("string"),
                           F.lit(".latency")))
            .otherwise(F.concat(F.lit("user"), u, app, F.lit("."), (F.col("user_id") % 4).cast("string"),
                                F.lit(".executor.bytesRead.count"))))
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").cast("string")
    return e.select(F.concat_ws(" ", path, F.col("value").cast("string"), sec).alias("value"), "event_id")


EXPO_NAMES = {
    "click": "container_cpu_usage_seconds_total",
    "error": "container_cpu_user_seconds_total",
    "purchase": "container_memory_swap",
    "signup": "container_spec_cpu_shares",
    "view": "metrics_application_1704067200_0001_executor_bytesRead_total",
}


def exposition_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Exposition text per event plus # HELP/# TYPE lines per metric name."""
    e = table(spark, sf, "events")
    name = F.create_map(*[x for k, v in EXPO_NAMES.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
    pod = F.when(F.col("user_id") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("pod-"), F.col("user_id").cast("string")))
    block = F.concat(F.lit('{id="/kubepods/'), F.col("user_id").cast("string"), F.lit('",pod="'), pod,
                     F.lit('",le="'), F.when(F.col("event_id") % 2 == 0, F.lit("0.2")).otherwise(F.lit("1")), F.lit('"}'))
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").cast("string")
    lines = e.select(F.concat(name, block, F.lit(" "), F.col("value").cast("string"), F.lit(" "), ms).alias("value"))
    helps = e.select("event_type").distinct().select(
        F.concat(F.lit("# HELP "), name, F.lit(" from events")).alias("value"))
    return lines.unionByName(helps)
