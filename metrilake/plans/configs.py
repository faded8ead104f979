"""Fixed configuration values of the monitoring deployment being reproduced.

These are data, not logic: the relabel lists of the two Spark scrape jobs,
the ingest drop lists, the Graphite templates, the alert routing tree and
inhibition rules, the retention settings.  They are stated as written in the
deployment's values and config files.
"""
from __future__ import annotations

from ..operators.relabel import Drop, Keep, LabelMap, Replace

# --- fixed values: scrape relabelling of the "spark-pods-jmx" job ----------------------
SPARK_PODS_JMX = [
    Keep(["__meta_kubernetes_pod_annotation_jmx_prometheus_io_scrape"], "true"),
    Replace(["__meta_kubernetes_pod_annotation_jmx_prometheus_io_path"], "__metrics_path__", "(.+)"),
    Replace(["__address__", "__meta_kubernetes_pod_annotation_jmx_prometheus_io_port"], "__address__",
            r"([^:]+)(?::\d+)?;(\d+)", "$1:$2"),
    LabelMap("__meta_kubernetes_pod_label_(.+)"),
    Replace(["__meta_kubernetes_namespace"], "kubernetes_namespace"),
    Replace(["__meta_kubernetes_pod_name"], "kubernetes_pod_name"),
]

# --- fixed values: scrape relabelling of the "spark-driver-executors-pods" job ----------
SPARK_DRIVER_EXECUTORS = [
    Keep(["__meta_kubernetes_pod_annotation_executors_prometheus_io_scrape"], "true"),
    Replace(["__meta_kubernetes_pod_annotation_executors_prometheus_io_path"], "__metrics_path__", "(.+)"),
    Replace(["__address__", "__meta_kubernetes_pod_annotation_executors_prometheus_io_port"], "__address__",
            r"([^:]+)(?::\d+)?;(\d+)", "$1:$2"),
    LabelMap("__meta_kubernetes_pod_label_(.+)"),
    Replace(["__meta_kubernetes_namespace"], "kubernetes_namespace"),
    Replace(["__meta_kubernetes_pod_name"], "kubernetes_pod_name"),
]
SPARK_DRIVER_EXECUTORS_METRICS_PATH = "/metrics/executors/prometheus"
SPARK_DRIVER_EXECUTORS_SCRAPE_INTERVAL = "15s"

# --- fixed values: metric relabelling of the executors job ---------------------------
SPARK_METRIC_RELABEL = [
    Replace(["__name__"], "__name__", "metrics_application_[0-9]+_[0-9]+_(.+)", "spark_$1"),
    Replace(["__name__"], "__name__", "metrics_(.+)", "spark_$1"),
]

# --- fixed values: apiserver bucket drop -------------------------------------------
APISERVER_DROP = [
    Drop(["__name__", "le"],
         "apiserver_request_duration_seconds_bucket;(0.15|0.2|0.3|0.35|0.4|0.45|0.6|0.7|0.8|0.9|1.25|1.5|1.75|2|3|"
         "3.5|4|4.5|6|7|8|9|15|25|40|50)"),
]

# --- fixed values: cAdvisor metric drops -------------------------------------------
CADVISOR_DROP = [
    Drop(["__name__"], "container_cpu_(cfs_throttled_seconds_total|load_average_10s|system_seconds_total|"
                       "user_seconds_total)"),
    Drop(["__name__"], "container_fs_(io_current|io_time_seconds_total|io_time_weighted_seconds_total|"
                       "reads_merged_total|sector_reads_total|sector_writes_total|writes_merged_total)"),
    Drop(["__name__"], "container_memory_(mapped_file|swap)"),
    Drop(["__name__"], "container_(file_descriptors|tasks_state|threads_max)"),
    Drop(["__name__"], "container_spec.*"),
    Drop(["id", "pod"], ".+;"),
]

# --- fixed values: Graphite templates (most specific first) ---------------------------
GRAPHITE_TEMPLATES = [
    "*.*.jvm.pools.* username.applicationid.process.namespace.namespace.measurement*",
    "*.*.applicationMaster.* username.applicationid.namespace.measurement*",
    "*.shuffleService.* username.namespace.measurement*",
    "*.*.*.spark.streaming.* username.applicationid.process.namespace.namespace.id.measurement*",
    "username.applicationid.process.namespace.measurement*",
]
GRAPHITE_SEPARATOR = "."

# --- fixed values: alert routing --------------------------------------------------
RESOLVE_TIMEOUT = "5m"
INHIBIT_RULES = [
    {"source": {"eq": {"severity": "critical"}}, "target": {"re": {"severity": "warning|info"}},
     "equal": ["namespace", "alertname"]},
    {"source": {"eq": {"severity": "warning"}}, "target": {"eq": {"severity": "info"}},
     "equal": ["namespace", "alertname"]},
    {"source": {"eq": {"alertname": "InfoInhibitor"}}, "target": {"eq": {"severity": "info"}},
     "equal": ["namespace"]},
]
ROUTE = {
    "receiver": "null", "group_by": ["namespace"], "group_wait": "30s", "group_interval": "5m",
    "repeat_interval": "12h",
    "routes": [{"receiver": "null", "matchers": {"re": {"alertname": "InfoInhibitor|Watchdog"}}}],
}

# --- fixed values: long-term store ------------------------------------------------
RETENTION = {"raw": "30d", "5m": "30d", "1h": "10y"}
CONSISTENCY_DELAY = "30m"
DELETE_DELAY = "24h"
REPLICA_LABELS = ["replica", "prometheus_replica", "rule_replica"]
LOCAL_RETENTION_BYTES = 2048 * 1024 * 1024
LOCAL_RETENTION_TIME = "1h"
REMOTE_WRITE_BATCH = 1000
