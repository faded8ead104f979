"""Further metric families derived from ``events`` for the node, scheduler,
resource and system rule packs.

``EXTRA`` maps a family to its labels, kind and value; the same declaration
gives the Spark frame and the SQL of the oracle's source rows (expressions
that mean the same in both).  A counter is the running sum of its increments.
"""
from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import TS, VALUE
from ..operators.select import from_table
from .k8s_metrics import LE, T0, TIME_SCALE, _counter, base, bucket_counter
from .rulegroup import DictSource

_NODE = {"job": "'node-exporter'", "namespace": "'monitoring'", "pod": "concat('node-exporter-', cast(uid % 7 as string))",
         "instance": "concat('node-', cast(uid % 7 as string), ':9100')"}
_HOST = {"job": "'node-exporter'", "instance": "concat('node-', cast(uid % 7 as string), ':9100')"}
_DISK = "case uid % 3 when 0 then 'sda' when 1 then 'nvme0n1' else 'loop0' end"
_NIC = "case when uid % 5 = 0 then 'lo' else 'eth0' end"
_KSM = {"job": "'kube-state-metrics'"}
_NS = "concat('ns-', cast(uid % 5 as string))"
_POD = "concat('pod-', cast(uid as string))"
_SCHED = {"job": "'kube-scheduler'", "instance": "concat('cp-', cast(uid % 2 as string), ':10259')", "pod": "concat('kube-scheduler-', cast(uid % 2 as string))"}

_CTRL = {"job": "'prometheus-operator'", "namespace": "'monitoring'", "controller": "case uid % 3 when 0 then 'prometheus' when 1 then 'alertmanager' else 'thanos' end"}
_API = {"job": "'apiserver'", "instance": "concat('cp-', cast(uid % 2 as string), ':6443')"}
_SVC = {"name": "concat('v1.svc', cast(uid % 6 as string))", "namespace": _NS}

_NODE_OF = "concat('node-', cast(uid % 7 as string))"
_KUBELET = {"job": "'kubelet'", "metrics_path": "'/metrics'", "instance": "concat('node-', cast(uid % 7 as string), ':10250')"}
_PVC = {"namespace": _NS, "persistentvolumeclaim": "concat('pvc-', cast(uid % 10 as string))"}
_VOLUME = {"job": "'kubelet'", "metrics_path": "'/metrics'", **_PVC}
_LEFT = f"5e8 + floor(value) * 1e4 - (ts - {T0}) * (uid % 3) * 100"
_ROOM = "case uid % 10 when 0 then 3e10 when 1 then 4e9 when 2 then 4e9 when 4 then 4e9 when 5 then 3e10 else 1e9 end"


def _object(label: str) -> dict[str, str]:
    return _KSM | {"namespace": _NS, label: f"concat('{label[:3]}-', cast(uid % 10 as string))"}


def _less(*which: int) -> str:
    """Replicas of an object, one less for some objects."""
    return f"(uid % 10) % 3 + 3.0 - case when uid % 10 in ({', '.join(map(str, which))}) then 1 else 0 end"


_REPLICAS = "(uid % 10) % 3 + 3.0"
_UPDATED = "(uid % 10) % 3 + 3.0 - case when uid % 10 = 2 then 1 else 0 end + case when uid % 10 = 7 then event_id % 2 else 0 end"


def _one(cond: str) -> str:
    return f"case when {cond} then 1.0 else 0.0 end"


_FAILED = _one("event_type in ('error', 'signup') or uid % 3 = 1")

#: family -> (labels, kind, value, filter).  Kinds: gauge, counter, bucket (bounds LE), or bucket:bounds;
#: a bucket's value is the observation
EXTRA: dict[str, tuple[dict[str, str], str, str, str]] = {
    "node_load1": (_NODE, "gauge", "value / 16", "true"),
    "node_memory_MemTotal_bytes": (_HOST, "gauge", "8e9 + 1e9 * (uid % 7)", "true"),
    "node_vmstat_pgmajfault": (_NODE, "counter", "floor(value)", "true"),
    "node_disk_io_time_seconds_total": (_NODE | {"device": _DISK}, "counter", "value / 1024", "true"),
    "node_disk_io_time_weighted_seconds_total": (_NODE | {"device": _DISK}, "counter", "value / 512", "true"),
    "node_network_receive_drop_total": (_NODE | {"device": _NIC}, "counter", "case when event_type = 'error' then 1.0 else 0.0 end", "true"),
    "node_network_transmit_drop_total": (_NODE | {"device": _NIC}, "counter", "case when event_type = 'signup' then 2.0 else 0.0 end", "true"),
    "scheduler_e2e_scheduling_duration_seconds_bucket": (_SCHED, "bucket", "value / 40", "true"),
    "scheduler_scheduling_algorithm_duration_seconds_bucket": (_SCHED, "bucket", "value / 80", "true"),
    "scheduler_binding_duration_seconds_bucket": (_SCHED, "bucket", "value / 160", "true"),
    "namespace_cpu:kube_pod_container_resource_requests:sum": ({"namespace": _NS}, "gauge", "floor(value) / 8", "true"),
    "namespace_memory:kube_pod_container_resource_requests:sum": ({"namespace": _NS}, "gauge", "floor(value) * 1e8", "true"),
    "kube_node_status_allocatable": (_KSM | {"node": "concat('node-', cast(uid % 7 as string))", "resource": "case when uid % 2 = 0 then 'cpu' else 'memory' end"},
                                     "gauge", "case when uid % 2 = 0 then 8.0 else 4e9 end", "true"),
    "kube_resourcequota": (_KSM | {"namespace": _NS, "resource": "case when uid % 3 = 0 then 'requests.cpu' when uid % 3 = 1 then 'requests.memory' else 'pods' end",
                                   "type": "case when event_type in ('click', 'view', 'purchase') then 'used' else 'hard' end"},
                           "gauge", "case when event_type in ('click', 'view', 'purchase') then floor(value) else 24.0 + uid % 2 end", "true"),
    "container_cpu_cfs_throttled_periods_total": ({"namespace": _NS, "pod": _POD, "container": "case when event_type = 'error' then '' else event_type end"},
                                                  "counter", "floor(value / 3)", "true"),
    "container_cpu_cfs_periods_total": ({"namespace": _NS, "pod": _POD, "container": "case when event_type = 'error' then '' else event_type end"},
                                        "counter", "floor(value) + 1", "true"),
    "kubernetes_build_info": ({"job": "case when uid % 4 = 3 then 'coredns' else 'kubelet' end", "instance": "concat('node-', cast(uid % 7 as string), ':10250')",
                               "git_version": "concat('v1.', cast(20 + uid % 2 as string), '.', cast(uid % 3 as string), '-x', cast(uid % 5 as string))"}, "gauge", "1.0", "true"),
    "kube_state_metrics_list_total": (_KSM | {"result": "case when event_type = 'error' then 'error' else 'success' end"}, "counter", "1.0", "true"),
    "kube_state_metrics_watch_total": (_KSM | {"result": "case when event_type = 'error' and uid % 20 = 0 then 'error' else 'success' end"}, "counter", "1.0", "true"),
    "kube_state_metrics_total_shards": (_KSM | {"shard_ordinal": "cast(uid % 3 as string)"}, "gauge", "case when event_id % 97 = 0 then 4.0 else 3.0 end", "true"),
    "kube_state_metrics_shard_ordinal": (_KSM | {"shard_ordinal": "cast(uid % 3 as string)"}, "gauge", "cast(uid % 3 as double)", "event_id % 31 <> 0"),
    "prometheus_operator_list_operations_total": (_CTRL, "counter", "1.0", "true"),
    "prometheus_operator_list_operations_failed_total": (_CTRL, "counter", _FAILED, "true"),
    "prometheus_operator_watch_operations_total": (_CTRL, "counter", "1.0", "true"),
    "prometheus_operator_watch_operations_failed_total": (_CTRL, "counter", _one("event_type <> 'click' and uid % 3 <> 2"), "true"),
    "prometheus_operator_syncs": (_CTRL | {"status": "case when event_type = 'error' then 'failed' else 'ok' end"}, "gauge", "case when uid % 3 = 0 then 0.0 else floor(value) end", "true"),
    "prometheus_operator_reconcile_operations_total": (_CTRL, "counter", "1.0", "true"),
    "prometheus_operator_reconcile_errors_total": (_CTRL, "counter", _one("event_type = 'error' and uid % 3 <> 0"), "true"),
    "prometheus_operator_node_address_lookup_errors_total": (_CTRL, "counter", _one("event_type = 'error'"), "true"),
    "prometheus_operator_ready": (_CTRL, "gauge", _one("uid % 3 <> 2"), "true"),
    "prometheus_operator_managed_resources": (_CTRL | {"state": "case when event_type = 'view' then 'rejected' else 'selected' end"}, "gauge", "case when uid % 3 = 0 then 0.0 else 2.0 end", "true"),
    "apiserver_client_certificate_expiration_seconds_count": (_API, "counter", "1.0", "true"),
    "apiserver_client_certificate_expiration_seconds_bucket": (_API, "bucket:0,1800,86400,604800,2592000,+Inf", "value * 40000", "true"),
    "aggregator_unavailable_apiservice_total": (_SVC, "counter", _one("event_type = 'error'"), "true"),
    "aggregator_unavailable_apiservice": (_SVC, "gauge", _one("event_type = 'error'"), "true"),
    "apiserver_request_terminations_total": (_API, "counter", "case when event_type = 'error' then 2.0 else 0.0 end", "true"),
    "kube_node_status_condition": (_KSM | {"node": _NODE_OF, "condition": "case when uid % 2 = 0 then 'Ready' else 'DiskPressure' end", "status": "case when uid % 5 = 4 then 'false' else 'true' end"},
                                   "gauge", _one("event_type <> 'error' and uid % 7 <> 3"), "true"),
    "kube_node_spec_taint": (_KSM | {"node": _NODE_OF, "effect": "'NoSchedule'",
                                     "key": "case when event_id % 50 = 7 and uid % 2 = 0 then 'aws-node-termination-handler/spot-itn' else 'node.kubernetes.io/unreachable' end"},
                             "gauge", "1.0", "uid % 4 = 0"),
    "kube_node_status_capacity": (_KSM | {"node": _NODE_OF, "resource": "case when uid % 2 = 0 then 'pods' else 'cpu' end"}, "gauge", "case when uid % 7 = 5 then 1.0 else 10.0 + 2 * (uid % 7) end", "true"),
    "node_quantile:kubelet_pleg_relist_duration_seconds:histogram_quantile": (_KUBELET | {"quantile": "case when uid % 2 = 0 then '0.99' else '0.5' end"}, "gauge", "value / 4", "true"),
    "kubelet_pod_worker_duration_seconds_bucket": (_KUBELET, "bucket:0.5,5,30,60,120,+Inf", "value", "true"),
    "kubelet_certificate_manager_client_ttl_seconds": (_KUBELET, "gauge", "floor(value) * 9000", "true"),
    "kubelet_certificate_manager_server_ttl_seconds": (_KUBELET, "gauge", "floor(value) * 30000", "true"),
    "kubelet_certificate_manager_client_expiration_renew_errors": (_KUBELET, "counter", _one("event_type = 'error' and uid % 7 = 2"), "true"),
    "kubelet_server_expiration_renew_errors": (_KUBELET, "counter", _one("event_id % 500 = 3"), "true"),
    "kubelet_volume_stats_available_bytes": (_VOLUME, "gauge", _LEFT, "true"),
    "kubelet_volume_stats_capacity_bytes": (_VOLUME, "gauge", _ROOM, "true"),
    "kubelet_volume_stats_used_bytes": (_VOLUME, "gauge", "floor(value)", "true"),
    "kubelet_volume_stats_inodes_free": (_VOLUME, "gauge", f"floor(({_LEFT}) / 1000)", "true"),
    "kubelet_volume_stats_inodes": (_VOLUME, "gauge", f"({_ROOM}) / 800", "true"),
    "kubelet_volume_stats_inodes_used": (_VOLUME, "gauge", "floor(value / 2)", "true"),
    "kube_persistentvolumeclaim_access_mode": (_PVC | {"access_mode": "case when uid % 10 = 5 then 'ReadOnlyMany' else 'ReadWriteOnce' end"}, "gauge", "1.0", "true"),
    "kube_persistentvolumeclaim_labels": (_PVC | {"label_excluded_from_alerts": "case when uid % 10 = 2 then 'true' else '' end"}, "gauge", "1.0", "true"),
    "kube_persistentvolume_status_phase": (_KSM | {"persistentvolume": "concat('pv-', cast(uid % 10 as string))",
                                                   "phase": "case event_type when 'error' then 'Failed' when 'signup' then 'Pending' else 'Bound' end"}, "gauge", _one("uid % 3 <> 0"), "true"),
    "kube_deployment_status_observed_generation": (_object("deployment"), "gauge", "4.0 - case when uid % 10 = 3 then 1 else 0 end", "true"),
    "kube_deployment_metadata_generation": (_object("deployment"), "gauge", "4.0", "true"),
    "kube_deployment_spec_replicas": (_object("deployment"), "gauge", _REPLICAS, "true"),
    "kube_deployment_status_replicas_available": (_object("deployment"), "gauge", _less(2, 7), "true"),
    "kube_deployment_status_replicas_updated": (_object("deployment"), "gauge", _UPDATED, "true"),
    "kube_statefulset_status_replicas_ready": (_object("statefulset"), "gauge", _less(2, 7), "true"),
    "kube_statefulset_status_replicas": (_object("statefulset"), "gauge", _REPLICAS, "true"),
    "kube_statefulset_status_replicas_updated": (_object("statefulset"), "gauge", _UPDATED, "true"),
    "kube_statefulset_status_observed_generation": (_object("statefulset"), "gauge", "2.0 + case when uid % 10 = 4 then 1 else 0 end", "true"),
    "kube_statefulset_metadata_generation": (_object("statefulset"), "gauge", "2.0", "true"),
    "kube_statefulset_status_current_revision": (_object("statefulset") | {"revision": "'r1'"}, "gauge", "1.0", "true"),
    "kube_statefulset_status_update_revision": (_object("statefulset") | {"revision": "case when uid % 10 in (2, 7) then 'r2' else 'r1' end"}, "gauge", "1.0", "true"),
    "kube_statefulset_replicas": (_object("statefulset"), "gauge", _REPLICAS, "true"),
    "kube_daemonset_status_current_number_scheduled": (_object("daemonset"), "gauge", _less(1), "true"),
    "kube_daemonset_status_desired_number_scheduled": (_object("daemonset"), "gauge", _REPLICAS, "true"),
    "kube_daemonset_status_number_misscheduled": (_object("daemonset"), "gauge", "case when uid % 10 = 5 then 2.0 else 0.0 end", "true"),
    "kube_daemonset_status_updated_number_scheduled": (_object("daemonset"), "gauge", _UPDATED, "true"),
    "kube_daemonset_status_number_available": (_object("daemonset"), "gauge", _less(8), "true"),
    "kube_pod_container_status_waiting_reason": (_KSM | {"namespace": _NS, "pod": _POD, "container": "event_type",
                                                         "reason": "case when uid % 4 = 0 then 'CrashLoopBackOff' else 'ImagePullBackOff' end"}, "gauge", _one("uid % 9 < 3"), "true"),
    "kube_job_status_start_time": (_object("job_name"), "gauge", f"{T0 // 1000 - 42_000} + 300.0 * (uid % 10) - 2000", "true"),
    "kube_job_status_active": (_object("job_name"), "gauge", _one("uid % 10 < 7"), "true"),
    "kube_job_failed": (_object("job_name"), "gauge", _one("uid % 10 = 9"), "true"),
    "kube_horizontalpodautoscaler_status_desired_replicas": (_object("horizontalpodautoscaler"), "gauge", _less(1, 4, 6), "true"),
    "kube_horizontalpodautoscaler_status_current_replicas": (_object("horizontalpodautoscaler"), "gauge", "(uid % 10) % 3 + 3.0 + case when uid % 10 = 4 then event_id % 2 else 0 end", "true"),
    "kube_horizontalpodautoscaler_spec_min_replicas": (_object("horizontalpodautoscaler"), "gauge", "case when uid % 10 = 6 then 9.0 else 1.0 end", "true"),
    "kube_horizontalpodautoscaler_spec_max_replicas": (_object("horizontalpodautoscaler"), "gauge", "case when uid % 10 in (0, 3) then (uid % 10) % 3 + 3.0 else 10.0 end", "true"),
    "rest_client_requests_total": ({"job": "'kubelet'", "namespace": _NS, "instance": "concat('node-', cast(uid % 7 as string), ':10250')",
                                    "code": "case when event_type = 'error' then '503' when event_type = 'signup' then '404' else '200' end"}, "counter", "1.0", "true"),
}


def _bounds(kind: str) -> list[str]:
    return kind.partition(":")[2].split(",") if ":" in kind else LE


def extended(spark: SparkSession, sf: str, source: DictSource) -> DictSource:
    """source with the families of EXTRA."""
    events = base(spark, sf)

    def make(labels, kind, value, where):
        def family():
            d = events.filter(where)
            cols = [F.expr(e).alias(f"l_{n}") for n, e in labels.items()]
            d = d.select(*cols, "event_id", TS, F.expr(value).cast("double").alias("v"))
            d = d.select(*[F.col(f"l_{n}").alias(n) for n in labels], "event_id", TS, "v")
            if kind == "gauge":
                return from_table(d.select(*labels, TS, F.col("v").alias(VALUE)), list(labels))
            if kind.startswith("bucket"):
                return bucket_counter(d, list(labels), F.col("v"), _bounds(kind))
            return _counter(d, list(labels), F.col("v"))
        return family
    return source.with_families({n: make(*spec) for n, spec in EXTRA.items()})


def sql(name: str) -> tuple[str, list[str]]:
    """A family's rows in DuckDB and its labels."""
    labels, kind, value, where = EXTRA[name]
    rows = (f"(SELECT event_id, event_type, value, {T0} + (epoch_us(ts) // 1000 - {T0}) // {TIME_SCALE} AS ts, user_id AS uid FROM events)")
    cols = ", ".join(f"{e} AS {n}" for n, e in labels.items())
    src = f"(SELECT {cols}, event_id, ts, CAST({value} AS DOUBLE) AS v FROM {rows} WHERE {where})"
    names = list(labels)
    if kind == "gauge":
        return f"(SELECT {', '.join(names)}, ts, v AS value FROM {src})", names
    inc = "v"
    if kind.startswith("bucket"):
        les = ", ".join(f"('{x}')" for x in _bounds(kind))
        src = f"(SELECT * FROM {src} CROSS JOIN (VALUES {les}) b(le))"
        inc = "CASE WHEN v <= (CASE WHEN le = '+Inf' THEN 'inf'::DOUBLE ELSE CAST(le AS DOUBLE) END) THEN 1.0 ELSE 0.0 END"
        names.append("le")
    part = ", ".join(names)
    return (f"(SELECT {part}, ts, SUM(CAST(inc AS DOUBLE)) OVER (PARTITION BY {part} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value "
            f"FROM (SELECT {part}, ts, event_id, {inc} AS inc FROM {src}))"), names
