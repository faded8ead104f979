"""Cluster-monitoring metric families derived by Spark from the ``events`` table.

Rule and dashboard packs need series named like the monitored system's
(containers, pods, nodes, API requests).  Each event becomes samples of those
families: its user is a pod (namespace, node and owner derived from the user
id), its type a container / CPU mode / API verb, its value the measurement.
Counters are running sums split by (series, day) (``series.running_sum``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import TS, VALUE, MetricFrame, to_ms
from ..operators.select import from_table
from ..operators.series import DEFAULT_BUCKET_MS, running_sum, running_sums
from ..sources.tables import table
from .rulegroup import DictSource

OWNER_KINDS = ["ReplicaSet", "DaemonSet", "StatefulSet", "Job"]
MODES = {"click": "user", "view": "idle", "purchase": "system", "signup": "iowait", "error": "steal"}
VERBS = {"click": "GET", "view": "LIST", "purchase": "POST", "signup": "PUT", "error": "DELETE"}
PHASES = {"click": "Running", "view": "Running", "purchase": "Running", "signup": "Pending", "error": "Failed"}
LE = ["0.05", "0.1", "0.25", "0.5", "1", "5", "10", "30", "+Inf"]


def _lookup(m: dict, c: Column) -> Column:
    return F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])[c]


# The events month is replayed compressed into 30 minutes (1/1440), so the rule
# windows as declared ([3m], [5m], for: 10m) see several samples per series.
T0 = 1_704_067_200_000          # 2024-01-01T00:00:00Z
TIME_SCALE = 1440
DAY = 86_400_000 // TIME_SCALE      # a day of the replay: counts, exact in any order, are summed day by day, so few series are many groups


def base(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    u = F.col("user_id")
    t = (F.lit(T0) + F.floor((to_ms("ts") - F.lit(T0)) / F.lit(TIME_SCALE))).cast("bigint")
    return e.select(
        "event_id", "event_type", "value", t.alias(TS), u.alias("uid"),
        F.concat(F.lit("pod-"), u.cast("string")).alias("pod"),
        F.concat(F.lit("ns-"), (u % 5).cast("string")).alias("namespace"),
        F.concat(F.lit("node-"), (u % 7).cast("string")).alias("node"),
        F.concat(F.lit("node-"), (u % 7).cast("string"), F.lit(":9100")).alias("instance"))


def _counter(d: DataFrame, labels: list[str], inc: Column, bucket_ms: int = DEFAULT_BUCKET_MS) -> MetricFrame:
    c = running_sum(d.select(*labels, "event_id", TS, inc.alias("_inc")), labels, TS, ["event_id"], F.col("_inc"), VALUE, bucket_ms=bucket_ms)
    return from_table(c.select(*labels, TS, VALUE), labels)


def bucket_counter(d: DataFrame, labels: list[str], observed: Column, bounds: list[str]) -> MetricFrame:
    """Cumulative ``le`` buckets of the observations: all bounds are summed in one sort of the events, then each event
    gives a sample a bound."""
    le = {f"_le{i}": F.when(F.col("_seen") <= F.lit(float("inf") if x == "+Inf" else float(x)), F.lit(1.0)).otherwise(F.lit(0.0)) for i, x in enumerate(bounds)}
    c = running_sums(d.select(*labels, "event_id", TS, observed.alias("_seen")), labels, TS, ["event_id"], le, bucket_ms=DAY)
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("le"), F.col(f"_le{i}").alias("n")) for i, x in enumerate(bounds)]))
    c = c.select(*labels, TS, each.alias("_x")).select(*labels, F.col("_x.le").alias("le"), TS, F.col("_x.n").alias(VALUE))
    return from_table(c, [*labels, "le"])


def families(spark: SparkSession, sf: str) -> DictSource:
    events = base(spark, sf)      # a plan; each family reads only the columns it needs
    b = lambda: events            # noqa: E731
    lit = F.lit

    def cpu_usage():
        d = b().select("*", lit("kubelet").alias("job"), lit("/metrics/cadvisor").alias("metrics_path"),
                       F.col("event_type").alias("container"),
                       F.when(F.col("event_type") == "error", lit("")).otherwise(
                           F.concat(lit("img/"), F.col("event_type"))).alias("image"))
        return _counter(d, ["job", "metrics_path", "namespace", "pod", "container", "image"], F.col("value") / 100)

    def mem(scale):
        def f():
            d = b().select(lit("kubelet").alias("job"), lit("/metrics/cadvisor").alias("metrics_path"), "namespace",
                           "pod", F.col("event_type").alias("container"),
                           F.when(F.col("event_type") == "error", lit("")).otherwise(
                               F.concat(lit("img/"), F.col("event_type"))).alias("image"),
                           TS, (F.col("value") * scale).alias(VALUE))
            return from_table(d, ["job", "metrics_path", "namespace", "pod", "container", "image"])
        return f

    def pod_info():
        d = b()
        pods = d.select(lit("kube-state-metrics").alias("job"), "namespace", "pod", "node", TS, lit(1.0).alias(VALUE))
        exporters = d.select(lit("kube-state-metrics").alias("job"), lit("monitoring").alias("namespace"),
                             F.concat(lit("node-exporter-"), (F.col("uid") % 7).cast("string")).alias("pod"),
                             "node", TS, lit(1.0).alias(VALUE))
        return from_table(pods.unionByName(exporters), ["job", "namespace", "pod", "node"])

    def pod_owner():
        kind = F.element_at(F.array(*[lit(k) for k in OWNER_KINDS]), (F.col("uid") % 4 + 1).cast("int"))
        d = b().select(lit("kube-state-metrics").alias("job"), "namespace", "pod", kind.alias("owner_kind"),
                       F.concat(F.lower(kind), lit("-"), (F.col("uid") % 11).cast("string")).alias("owner_name"),
                       TS, lit(1.0).alias(VALUE))
        return from_table(d, ["job", "namespace", "pod", "owner_kind", "owner_name"])

    def rs_owner():
        d = b().filter(F.col("uid") % 4 == 0).select(
            lit("kube-state-metrics").alias("job"), "namespace",
            F.concat(lit("replicaset-"), (F.col("uid") % 11).cast("string")).alias("replicaset"),
            lit("Deployment").alias("owner_kind"),
            F.concat(lit("deploy-"), (F.col("uid") % 11).cast("string")).alias("owner_name"), TS, lit(1.0).alias(VALUE))
        return from_table(d, ["job", "namespace", "replicaset", "owner_kind", "owner_name"])

    def phase():
        d = b().select(lit("kube-state-metrics").alias("job"), "namespace", "pod",
                       _lookup(PHASES, F.col("event_type")).alias("phase"), TS, lit(1.0).alias(VALUE))
        return from_table(d, ["job", "namespace", "pod", "phase"])

    def resources(mult):
        def f():
            res = F.explode(F.array(F.struct(lit("cpu").alias("r"), (F.col("value") / 200 * mult).alias("v")),
                                    F.struct(lit("memory").alias("r"), F.round(F.col("value") * 5e5 * mult).alias("v"))))
            d = b().select(lit("kube-state-metrics").alias("job"), "namespace", "pod",
                           F.col("event_type").alias("container"), TS, res.alias("_x"))
            d = d.select("job", "namespace", "pod", "container", F.col("_x.r").alias("resource"), TS,
                         F.col("_x.v").alias(VALUE))
            return from_table(d, ["job", "namespace", "pod", "container", "resource"])
        return f

    def node_cpu():
        d = b().select("*", lit("node-exporter").alias("job"), lit("monitoring").alias("namespace2"),
                       F.concat(lit("node-exporter-"), (F.col("uid") % 7).cast("string")).alias("pod2"),
                       (F.col("uid") % 4).cast("string").alias("cpu"),
                       _lookup(MODES, F.col("event_type")).alias("mode"))
        d = d.drop("namespace", "pod").withColumnRenamed("namespace2", "namespace").withColumnRenamed("pod2", "pod")
        return _counter(d, ["job", "namespace", "pod", "instance", "cpu", "mode"], F.col("value"))

    def node_mem(name_ok: bool, scale: float):
        def f():
            cond = (F.col("uid") % 7 != 0) if name_ok else (F.col("uid") % 7 == 0)
            # byte gauges hold whole bytes, so their sums are exact in any order
            d = b().filter(cond).select(lit("node-exporter").alias("job"), "instance", TS,
                                        F.round(F.col("value") * scale).alias(VALUE))
            return from_table(d, ["job", "instance"])
        return f

    def net(direction):
        def f():
            d = b().select(lit("node-exporter").alias("job"), "instance", lit("eth0").alias("device"), "event_id", TS,
                           F.col("value"))
            return _counter(d, ["job", "instance", "device"], F.col("value") * (1000 if direction == "rx" else 300))
        return f

    def up():
        # control-plane components report rarely, so that they are absent now and then
        e = F.col("event_id")
        job = (F.when(e % 997 == 0, lit("kube-scheduler")).when(e % 499 == 1, lit("kube-controller-manager")).when(e % 787 == 2, lit("apiserver"))
               .when(e % 10 == 3, lit("kube-proxy")).otherwise(F.concat(lit("job-"), (F.col("uid") % 3).cast("string"))))
        d = b().select(job.alias("job"), "namespace",
                       F.concat(lit("svc-"), (F.col("uid") % 3).cast("string")).alias("service"), "instance", "pod",
                       TS, F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias(VALUE))
        return from_table(d, ["job", "namespace", "service", "instance", "pod"])

    def api_total():
        d = b().select("*", lit("apiserver").alias("job"), _lookup(VERBS, F.col("event_type")).alias("verb"),
                       F.when(F.col("uid") % 10 == 0, lit("500")).when(F.col("uid") % 10 == 1, lit("404"))
                       .otherwise(lit("200")).alias("code"),
                       F.when(F.col("uid") % 2 == 0, lit("pods")).otherwise(lit("nodes")).alias("resource"))
        return _counter(d, ["job", "verb", "code", "resource"], lit(1.0), DAY)

    def _api_hist():
        d = b().select("*", lit("apiserver").alias("job"), _lookup(VERBS, F.col("event_type")).alias("verb"),
                       F.when(F.col("uid") % 3 == 0, lit("resource")).when(F.col("uid") % 3 == 1, lit("namespace"))
                       .otherwise(lit("cluster")).alias("scope"),
                       F.when(F.col("uid") % 13 == 0, lit("log")).otherwise(lit("")).alias("subresource"),
                       (F.col("value") / 50).alias("_lat"))
        return d

    def api_bucket():
        return bucket_counter(_api_hist(), ["job", "verb", "scope", "subresource"], F.col("_lat"), LE)

    def api_count():
        return _counter(_api_hist(), ["job", "verb", "scope", "subresource"], lit(1.0), DAY)

    def api_sum():
        return _counter(_api_hist(), ["job", "verb", "scope", "subresource"], F.col("_lat"))

    def pleg_bucket():
        return bucket_counter(b().select("*", lit("kubelet").alias("job")), ["job", "instance"], F.col("value") / 40, LE)

    def net_up():
        # link state per interface: down (0) on an error event; every fourth user is a veth pair
        dev = F.when(F.col("uid") % 4 == 3, F.concat(lit("veth"), (F.col("uid") % 5).cast("string"))) \
               .otherwise(F.concat(lit("eth"), (F.col("uid") % 2).cast("string")))
        d = b().select(lit("node-exporter").alias("job"), "instance", dev.alias("device"), TS,
                       F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias(VALUE))
        return from_table(d, ["job", "instance", "device"])

    def reloader_ok():
        # 1 when the sidecar's last reload succeeded: only purchase events report success
        d = b().select(lit("config-reloader").alias("job"), "namespace", "pod", TS,
                       F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias(VALUE))
        return from_table(d, ["job", "namespace", "pod"])

    def kubelet_node_name():
        d = b().select(lit("kubelet").alias("job"), lit("/metrics").alias("metrics_path"), "instance", "node", TS,
                       lit(1.0).alias(VALUE))
        return from_table(d, ["job", "metrics_path", "instance", "node"])

    return DictSource({
        "container_cpu_usage_seconds_total": cpu_usage,
        "container_memory_working_set_bytes": mem(1e6),
        "container_memory_rss": mem(8e5),
        "container_memory_cache": mem(2e5),
        "container_memory_swap": mem(1e4),
        "kube_pod_info": pod_info,
        "kube_pod_owner": pod_owner,
        "kube_replicaset_owner": rs_owner,
        "kube_pod_status_phase": phase,
        "kube_pod_container_resource_requests": resources(1.0),
        "kube_pod_container_resource_limits": resources(2.0),
        "node_cpu_seconds_total": node_cpu,
        "node_memory_MemAvailable_bytes": node_mem(True, 1e7),
        "node_memory_MemFree_bytes": node_mem(False, 4e6),
        "node_memory_Buffers_bytes": node_mem(False, 1e6),
        "node_memory_Cached_bytes": node_mem(False, 3e6),
        "node_memory_Slab_bytes": node_mem(False, 5e5),
        "node_network_receive_bytes_total": net("rx"),
        "node_network_transmit_bytes_total": net("tx"),
        "up": up,
        "apiserver_request_total": api_total,
        "apiserver_request_slo_duration_seconds_bucket": api_bucket,
        "apiserver_request_slo_duration_seconds_count": api_count,
        "apiserver_request_slo_duration_seconds_sum": api_sum,
        "kubelet_pleg_relist_duration_seconds_bucket": pleg_bucket,
        "kubelet_node_name": kubelet_node_name,
        "node_network_up": net_up,
        "reloader_last_reload_successful": reloader_ok,
    })
