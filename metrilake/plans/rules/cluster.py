"""Rule packs: node-exporter.rules, kube-scheduler.rules, kubernetes-resources,
kubernetes-system, kubernetes-system-apiserver, kubernetes-system-kubelet,
kubernetes-storage, kubernetes-apps, kube-state-metrics and prometheus-operator."""
from __future__ import annotations

from ... import api as A
from ..rulegroup import Alert, Ctx, Record, RuleGroup

# Fixed values of the packs: job names, matchers, thresholds and durations.
NE = {"job": "node-exporter"}
KSM = {"job": "kube-state-metrics"}
DISKS = {"device": "(/dev/)?(mmcblk.p.+|nvme.+|rbd.+|sd.+|vd.+|xvd.+|dm-.+|dasd.+)"}
WAITING = {"mode": "idle|iowait|steal"}


def _num_cpu(c: Ctx):
    return A.aggregate(c.sel("node_cpu_seconds_total", eq={**NE, "mode": "idle"}), "count", without=["cpu", "mode"])


def _utilisation(c: Ctx):
    waiting = A.rate(c.raw("node_cpu_seconds_total", eq=NE, re=WAITING), "5m", c.grid)
    share = A.aggregate(A.aggregate(waiting, "sum", without=["mode"]), "avg", without=["cpu"])
    return A.scalar_op(share, "-", 1, scalar_left=True)


def _memory_used(c: Ctx):
    total = None
    for part in ("Buffers", "Cached", "MemFree", "Slab"):
        m = c.sel(f"node_memory_{part}_bytes", eq=NE)
        total = m if total is None else A.binop(total, m, "+")
    free = A.set_or(c.sel("node_memory_MemAvailable_bytes", eq=NE), total)
    return A.scalar_op(A.binop(free, c.sel("node_memory_MemTotal_bytes", eq=NE), "/"), "-", 1, scalar_left=True)


def _rate5m(name: str, without_device: bool = False, **match):
    def f(c: Ctx):
        r = A.rate(c.raw(name, eq=NE, **match), "5m", c.grid)
        return A.aggregate(r, "sum", without=["device"]) if without_device else r
    return f


def _net(name: str):
    return _rate5m(name, without_device=True, ne={"device": "lo"})


NODE_EXPORTER_RULES = RuleGroup("node-exporter.rules", "1m", [
    Record("instance:node_num_cpu:sum", _num_cpu),
    Record("instance:node_cpu_utilisation:rate5m", _utilisation),
    Record("instance:node_load1_per_cpu:ratio",
           lambda c: A.binop(c.sel("node_load1", eq=NE), c.sel("instance:node_num_cpu:sum", eq=NE), "/")),
    Record("instance:node_memory_utilisation:ratio", _memory_used),
    Record("instance:node_vmstat_pgmajfault:rate5m", _rate5m("node_vmstat_pgmajfault")),
    Record("instance_device:node_disk_io_time_seconds:rate5m", _rate5m("node_disk_io_time_seconds_total", re=DISKS)),
    Record("instance_device:node_disk_io_time_weighted_seconds:rate5m", _rate5m("node_disk_io_time_weighted_seconds_total", re=DISKS)),
    Record("instance:node_network_receive_bytes_excluding_lo:rate5m", _net("node_network_receive_bytes_total")),
    Record("instance:node_network_transmit_bytes_excluding_lo:rate5m", _net("node_network_transmit_bytes_total")),
    Record("instance:node_network_receive_drop_excluding_lo:rate5m", _net("node_network_receive_drop_total")),
    Record("instance:node_network_transmit_drop_excluding_lo:rate5m", _net("node_network_transmit_drop_total")),
])


def _scheduled(family: str):
    def f(c: Ctx):
        r = A.rate(c.raw(f"scheduler_{family}_duration_seconds_bucket", eq={"job": "kube-scheduler"}), "5m", c.grid)
        return A.aggregate(r, "sum", without=["instance", "pod"])
    return f


def _scheduler(family: str, q: float):
    return lambda c: A.histogram_quantile(c.shared(f"scheduler_{family}", _scheduled(family)), q)


SCHEDULER_FAMILIES = ("e2e_scheduling", "scheduling_algorithm", "binding")
KUBE_SCHEDULER = RuleGroup("kube-scheduler.rules", "1m", [
    Record(f"cluster_quantile:scheduler_{family}_duration_seconds:histogram_quantile", _scheduler(family, q), {"quantile": str(q)})
    for q in (0.99, 0.9, 0.5) for family in SCHEDULER_FAMILIES])


def _overcommit(resource: str):
    def f(c: Ctx):
        room = c.sel("kube_node_status_allocatable", eq={"resource": resource})
        spare = A.binop(A.aggregate(room, "sum"), A.aggregate(room, "max"), "-")
        asked = A.aggregate(c.sel(f"namespace_{resource}:kube_pod_container_resource_requests:sum"), "sum")
        return A.set_and(A.where_value(A.binop(asked, spare, "-"), ">", 0), A.where_value(spare, ">", 0))
    return f


def _quota_overcommit(resource: str):
    def f(c: Ctx):
        quota = c.sel("kube_resourcequota", eq={**KSM, "type": "hard"}, re={"resource": f"({resource}|requests.{resource})"})
        quota = A.aggregate(A.aggregate(quota, "min", without=["resource"]), "sum")
        room = A.aggregate(c.sel("kube_node_status_allocatable", eq={**KSM, "resource": resource}), "sum")
        return A.where_value(A.binop(quota, room, "/"), ">", 1.5)
    return f


def _quota_used(*conditions: tuple[str, float]):
    def f(c: Ctx):
        used = c.sel("kube_resourcequota", eq={**KSM, "type": "used"})
        hard = A.where_value(c.sel("kube_resourcequota", eq={**KSM, "type": "hard"}), ">", 0)
        share = A.binop(used, hard, "/", ignoring=["instance", "job", "type"])
        for op, x in conditions:
            share = A.where_value(share, op, x)
        return share
    return f


def _throttled(c: Ctx):
    by = ["container", "pod", "namespace"]
    hit = A.aggregate(A.increase(c.raw("container_cpu_cfs_throttled_periods_total", ne={"container": ""}), "5m", c.grid), "sum", by=by)
    return A.where_value(A.binop(hit, A.aggregate(A.increase(c.raw("container_cpu_cfs_periods_total"), "5m", c.grid), "sum", by=by), "/"), ">", 0.25)


KUBERNETES_RESOURCES = RuleGroup("kubernetes-resources", "1m", [
    Alert("KubeCPUOvercommit", _overcommit("cpu"), "10m", {"severity": "warning"}),
    Alert("KubeMemoryOvercommit", _overcommit("memory"), "10m", {"severity": "warning"}),
    Alert("KubeCPUQuotaOvercommit", _quota_overcommit("cpu"), "5m", {"severity": "warning"}),
    Alert("KubeMemoryQuotaOvercommit", _quota_overcommit("memory"), "5m", {"severity": "warning"}),
    Alert("KubeQuotaAlmostFull", _quota_used((">", 0.9), ("<", 1)), "15m", {"severity": "info"}),
    Alert("KubeQuotaFullyUsed", _quota_used(("==", 1)), "15m", {"severity": "info"}),
    Alert("KubeQuotaExceeded", _quota_used((">", 1)), "15m", {"severity": "warning"}),
    Alert("CPUThrottlingHigh", _throttled, "15m", {"severity": "info"}),
])


def _versions(c: Ctx):
    info = c.sel("kubernetes_build_info", nre={"job": "kube-dns|coredns"})
    info = A.label_replace(info, "git_version", "$1", "git_version", "(v[0-9]*.[0-9]*).*")
    kinds = A.aggregate(info, "count", by=["git_version", "cluster"])
    return A.where_value(A.aggregate(kinds, "count", by=["cluster"]), ">", 1)


def _client_errors(c: Ctx):
    by = ["cluster", "instance", "job", "namespace"]
    bad = A.aggregate(A.rate(c.raw("rest_client_requests_total", re={"code": "5.."}), "5m", c.grid), "sum", by=by)
    return A.where_value(A.binop(bad, A.aggregate(A.rate(c.raw("rest_client_requests_total"), "5m", c.grid), "sum", by=by), "/"), ">", 0.01)


KUBERNETES_SYSTEM = RuleGroup("kubernetes-system", "1m", [
    Alert("KubeVersionMismatch", _versions, "15m", {"severity": "warning"}),
    Alert("KubeClientErrors", _client_errors, "15m", {"severity": "warning"}),
])


def _share(part, whole, limit: float):
    def f(c: Ctx):
        return A.where_value(A.binop(part(c), whole(c), "/"), ">", limit)
    return f


def _summed(name: str, rng: str = "5m", by=None, **eq):
    return lambda c: A.aggregate(A.rate(c.raw(name, eq=eq), rng, c.grid), "sum", by=by)


def _total_shards(c: Ctx):
    return c.sel("kube_state_metrics_total_shards", eq=KSM)


def _shards_missing(c: Ctx):
    want = A.scalar_op(A.scalar_op(A.aggregate(_total_shards(c), "max"), "^", 2, scalar_left=True), "-", 1)
    have = A.aggregate(c.sel("kube_state_metrics_shard_ordinal", eq=KSM), "max", by=["shard_ordinal"])
    have = A.aggregate(A.scalar_op(have, "^", 2, scalar_left=True), "sum")
    return A.where_value(A.binop(want, have, "-"), "!=", 0)


KUBE_STATE_METRICS = RuleGroup("kube-state-metrics", "1m", [
    Alert("KubeStateMetricsListErrors", _share(_summed("kube_state_metrics_list_total", result="error", **KSM),
                                               _summed("kube_state_metrics_list_total", **KSM), 0.01), "15m", {"severity": "critical"}),
    Alert("KubeStateMetricsWatchErrors", _share(_summed("kube_state_metrics_watch_total", result="error", **KSM),
                                                _summed("kube_state_metrics_watch_total", **KSM), 0.01), "15m", {"severity": "critical"}),
    Alert("KubeStateMetricsShardingMismatch", lambda c: A.where_value(A.aggregate(_total_shards(c), "stdvar"), "!=", 0), "15m", {"severity": "critical"}),
    Alert("KubeStateMetricsShardsMissing", _shards_missing, "15m", {"severity": "critical"}),
])

OPERATOR = {"job": "prometheus-operator", "namespace": "monitoring"}
_BY = ["controller", "namespace"]


def _operator(name: str, rng: str = "5m"):
    return _summed(f"prometheus_operator_{name}", rng, by=_BY, **OPERATOR)


def _over(fn, name: str, rng: str = "5m", **eq):
    return lambda c: fn(c.raw(f"prometheus_operator_{name}", eq={**OPERATOR, **eq}), rng, c.grid)


PROMETHEUS_OPERATOR = RuleGroup("prometheus-operator", "1m", [
    Alert("PrometheusOperatorListErrors", _share(_operator("list_operations_failed_total", "10m"), _operator("list_operations_total", "10m"), 0.4),
          "15m", {"severity": "warning"}),
    Alert("PrometheusOperatorWatchErrors", _share(_operator("watch_operations_failed_total"), _operator("watch_operations_total"), 0.4),
          "15m", {"severity": "warning"}),
    Alert("PrometheusOperatorSyncFailed", lambda c: A.where_value(_over(A.min_over_time, "syncs", status="failed")(c), ">", 0), "10m", {"severity": "warning"}),
    Alert("PrometheusOperatorReconcileErrors", _share(_operator("reconcile_errors_total"), _operator("reconcile_operations_total"), 0.1),
          "10m", {"severity": "warning"}),
    Alert("PrometheusOperatorNodeLookupErrors",
          lambda c: A.where_value(A.rate(c.raw("prometheus_operator_node_address_lookup_errors_total", eq=OPERATOR), "5m", c.grid), ">", 0.1),
          "10m", {"severity": "warning"}),
    Alert("PrometheusOperatorNotReady", lambda c: A.aggregate(A.where_value(_over(A.max_over_time, "ready")(c), "==", 0), "min", by=_BY), "5m", {"severity": "warning"}),
    Alert("PrometheusOperatorRejectedResources", lambda c: A.where_value(_over(A.min_over_time, "managed_resources", state="rejected")(c), ">", 0),
          "5m", {"severity": "warning"}),
])

API = {"job": "apiserver"}


def _certificate(limit: float):
    def f(c: Ctx):
        used = A.where_value(c.sel("apiserver_client_certificate_expiration_seconds_count", eq=API), ">", 0)
        left = A.rate(c.raw("apiserver_client_certificate_expiration_seconds_bucket", eq=API), "5m", c.grid)
        left = A.histogram_quantile(A.aggregate(left, "sum", by=["job", "le"]), 0.01)
        return A.set_and(used, A.where_value(left, "<", limit), on=["job"])
    return f


def _api_errors(c: Ctx):
    n = A.increase(c.raw("aggregator_unavailable_apiservice_total"), "10m", c.grid)
    return A.where_value(A.aggregate(n, "sum", by=["name", "namespace", "cluster"]), ">", 4)


def _api_unavailable(c: Ctx):
    away = A.avg_over_time(c.raw("aggregator_unavailable_apiservice"), "10m", c.grid)
    up = A.scalar_op(A.aggregate(away, "max", by=["name", "namespace", "cluster"]), "-", 1, scalar_left=True)
    return A.where_value(A.scalar_op(up, "*", 100), "<", 85)


def _terminated(c: Ctx):
    ended = _summed("apiserver_request_terminations_total", "10m", **API)(c)
    return A.where_value(A.binop(ended, A.binop(_summed("apiserver_request_total", "10m", **API)(c), ended, "+"), "/"), ">", 0.2)


KUBERNETES_SYSTEM_APISERVER = RuleGroup("kubernetes-system-apiserver", "1m", [
    Alert("KubeClientCertificateExpiration", _certificate(604800), "0s", {"severity": "warning"}),
    Alert("KubeClientCertificateExpiration", _certificate(86400), "0s", {"severity": "critical"}),
    Alert("KubeAggregatedAPIErrors", _api_errors, "0s", {"severity": "warning"}),
    Alert("KubeAggregatedAPIDown", _api_unavailable, "5m", {"severity": "warning"}),
    Alert("KubeAPIDown", lambda c: A.absent(A.where_value(c.sel("up", eq=API), "==", 1), c.grid, API), "15m", {"severity": "critical"}),
    Alert("KubeAPITerminatedRequests", _terminated, "5m", {"severity": "warning"}),
])


READY = {"condition": "Ready", "status": "true"}
KUBELET = {"job": "kubelet", "metrics_path": "/metrics"}
LEAVING = "ToBeDeletedByClusterAutoscaler|cloud.google.com/impending-node-termination|aws-node-termination-handler/spot-itn"


def _unreachable(c: Ctx):
    gone = c.sel("kube_node_spec_taint", eq={**KSM, "key": "node.kubernetes.io/unreachable", "effect": "NoSchedule"})
    planned = c.sel("kube_node_spec_taint", eq=KSM, re={"key": LEAVING})
    return A.where_value(A.set_unless(gone, planned, ignoring=["key", "value"]), "==", 1)


def _too_many_pods(c: Ctx):
    one = ["instance", "pod", "namespace", "cluster"]
    running = A.where_value(c.sel("kube_pod_status_phase", eq={**KSM, "phase": "Running"}), "==", 1)
    on_node = A.binop(running, A.topk(c.sel("kube_pod_info", eq=KSM), 1, by=one), "*", on=one, group_left=["node"], check_unique=False)
    room = A.where_value(c.sel("kube_node_status_capacity", eq={**KSM, "resource": "pods"}), "!=", 1)
    by = ["cluster", "node"]
    return A.where_value(A.binop(A.aggregate(on_node, "count", by=by), A.aggregate(room, "max", by=by), "/"), ">", 0.95)


def _flapping(c: Ctx):
    n = A.changes(c.raw("kube_node_status_condition", eq=READY), "15m", c.grid)
    return A.where_value(A.aggregate(n, "sum", by=["cluster", "node"]), ">", 2)


def _startup_latency(c: Ctx):
    r = A.rate(c.raw("kubelet_pod_worker_duration_seconds_bucket", eq=KUBELET), "5m", c.grid)
    slow = A.histogram_quantile(A.aggregate(r, "sum", by=["cluster", "instance", "le"]), 0.99)
    return A.where_value(A.binop(slow, c.sel("kubelet_node_name", eq=KUBELET), "*", on=["cluster", "instance"], group_left=["node"]), ">", 60)


def _below(name: str, limit: float):
    return lambda c: A.where_value(c.sel(name), "<", limit)


def _grew(name: str):
    return lambda c: A.where_value(A.increase(c.raw(name), "5m", c.grid), ">", 0)


_TTL = "kubelet_certificate_manager_{}_ttl_seconds"
KUBERNETES_SYSTEM_KUBELET = RuleGroup("kubernetes-system-kubelet", "1m", [
    Alert("KubeNodeNotReady", lambda c: A.where_value(c.sel("kube_node_status_condition", eq={**KSM, **READY}), "==", 0), "15m", {"severity": "warning"}),
    Alert("KubeNodeUnreachable", _unreachable, "15m", {"severity": "warning"}),
    Alert("KubeletTooManyPods", _too_many_pods, "15m", {"severity": "info"}),
    Alert("KubeNodeReadinessFlapping", _flapping, "15m", {"severity": "warning"}),
    Alert("KubeletPlegDurationHigh",
          lambda c: A.where_value(c.sel("node_quantile:kubelet_pleg_relist_duration_seconds:histogram_quantile", eq={"quantile": "0.99"}), ">=", 10),
          "5m", {"severity": "warning"}),
    Alert("KubeletPodStartUpLatencyHigh", _startup_latency, "15m", {"severity": "warning"}),
    Alert("KubeletClientCertificateExpiration", _below(_TTL.format("client"), 604800), "0s", {"severity": "warning"}),
    Alert("KubeletClientCertificateExpiration", _below(_TTL.format("client"), 86400), "0s", {"severity": "critical"}),
    Alert("KubeletServerCertificateExpiration", _below(_TTL.format("server"), 604800), "0s", {"severity": "warning"}),
    Alert("KubeletServerCertificateExpiration", _below(_TTL.format("server"), 86400), "0s", {"severity": "critical"}),
    Alert("KubeletClientCertificateRenewalErrors", _grew("kubelet_certificate_manager_client_expiration_renew_errors"), "15m", {"severity": "warning"}),
    Alert("KubeletServerCertificateRenewalErrors", _grew("kubelet_server_expiration_renew_errors"), "15m", {"severity": "warning"}),
    Alert("KubeletDown", lambda c: A.absent(A.where_value(c.sel("up", eq={"job": "kubelet"}), "==", 1), c.grid, KUBELET), "15m", {"severity": "critical"}),
])


def _filling(left: str, room: str, used: str, limit: float, days: float = 0):
    """The claims whose share left is below the limit, that hold something, are
    writable and not excluded, and (with days) run out within them."""
    claim = ["namespace", "persistentvolumeclaim"]

    def f(c: Ctx):
        out = A.where_value(A.binop(c.sel(left, eq=KUBELET), c.sel(room, eq=KUBELET), "/"), "<", limit)
        out = A.set_and(out, A.where_value(c.sel(used, eq=KUBELET), ">", 0))
        if days:
            out = A.set_and(out, A.where_value(A.predict_linear(c.raw(left, eq=KUBELET), "6h", c.grid, days * 86_400), "<", 0))
        out = A.set_unless(out, A.where_value(c.sel("kube_persistentvolumeclaim_access_mode", eq={"access_mode": "ReadOnlyMany"}), "==", 1), on=claim)
        return A.set_unless(out, A.where_value(c.sel("kube_persistentvolumeclaim_labels", eq={"label_excluded_from_alerts": "true"}), "==", 1), on=claim)
    return f


_BYTES = tuple(f"kubelet_volume_stats_{x}_bytes" for x in ("available", "capacity", "used"))
_INODES = ("kubelet_volume_stats_inodes_free", "kubelet_volume_stats_inodes", "kubelet_volume_stats_inodes_used")
KUBERNETES_STORAGE = RuleGroup("kubernetes-storage", "1m", [
    Alert("KubePersistentVolumeFillingUp", _filling(*_BYTES, 0.03), "1m", {"severity": "critical"}),
    Alert("KubePersistentVolumeFillingUp", _filling(*_BYTES, 0.15, 4), "1h", {"severity": "warning"}),
    Alert("KubePersistentVolumeInodesFillingUp", _filling(*_INODES, 0.03), "1m", {"severity": "critical"}),
    Alert("KubePersistentVolumeInodesFillingUp", _filling(*_INODES, 0.15, 4), "1h", {"severity": "warning"}),
    Alert("KubePersistentVolumeErrors",
          lambda c: A.where_value(c.sel("kube_persistentvolume_status_phase", eq=KSM, re={"phase": "Failed|Pending"}), ">", 0),
          "5m", {"severity": "critical"}),
])


def _is(c: Ctx, name: str, **match):
    return c.sel(f"kube_{name}", eq=KSM, **match)


def _steady(c: Ctx, name: str, rng: str):
    return A.where_value(A.changes(c.raw(f"kube_{name}", eq=KSM), rng, c.grid), "==", 0)


def _compare(left: str, op: str, right: str):
    return lambda c: A.binop(_is(c, left), _is(c, right), op)


def _stuck(left: str, op: str, right: str, updated: str):
    return lambda c: A.set_and(_compare(left, op, right)(c), _steady(c, updated, "10m"))


def _not_ready(c: Ctx):
    by = ["namespace", "pod", "cluster"]
    waiting = A.aggregate(_is(c, "pod_status_phase", re={"phase": "Pending|Unknown"}), "max", by=by)
    owner = A.aggregate(c.sel("kube_pod_owner", ne={"owner_kind": "Job"}), "max", by=["namespace", "pod", "owner_kind", "cluster"])
    owned = A.binop(waiting, A.topk(owner, 1, by=by), "*", on=by, group_left=["owner_kind"], check_unique=False)
    return A.where_value(A.aggregate(owned, "sum", by=by), ">", 0)


def _not_rolled_out(c: Ctx):
    old = A.aggregate(A.set_unless(_is(c, "statefulset_status_current_revision"), _is(c, "statefulset_status_update_revision")), "max", without=["revision"])
    behind = A.binop(_is(c, "statefulset_replicas"), _is(c, "statefulset_status_replicas_updated"), "!=")
    return A.set_and(A.binop(old, behind, "*"), _steady(c, "statefulset_status_replicas_updated", "5m"))


def _daemonset_stuck(c: Ctx):
    def off(name: str):
        return A.binop(_is(c, f"daemonset_status_{name}"), _is(c, "daemonset_status_desired_number_scheduled"), "!=")
    odd = A.set_or(off("current_number_scheduled"), A.where_value(_is(c, "daemonset_status_number_misscheduled"), "!=", 0))
    odd = A.set_or(A.set_or(odd, off("updated_number_scheduled")), off("number_available"))
    return A.set_and(odd, _steady(c, "daemonset_status_updated_number_scheduled", "5m"))


def _container_waiting(c: Ctx):
    return A.where_value(A.aggregate(_is(c, "pod_container_status_waiting_reason"), "sum", by=["namespace", "pod", "container", "cluster"]), ">", 0)


def _not_scheduled(c: Ctx):
    missing = A.binop(_is(c, "daemonset_status_desired_number_scheduled"), _is(c, "daemonset_status_current_number_scheduled"), "-")
    return A.where_value(missing, ">", 0)


def _job_not_completed(c: Ctx):
    begun = A.set_and(_is(c, "job_status_start_time"), A.where_value(_is(c, "job_status_active"), ">", 0))
    begun = A.aggregate(begun, "max", by=["namespace", "job_name", "cluster"])
    return A.where_value(A.scalar_op(begun, "-", A.time_(c.spark, c.grid), scalar_left=True), ">", 43200)


def _hpa_mismatch(c: Ctx):
    now = "horizontalpodautoscaler_status_current_replicas"
    out = A.binop(_is(c, "horizontalpodautoscaler_status_desired_replicas"), _is(c, now), "!=")
    out = A.set_and(out, A.binop(_is(c, now), _is(c, "horizontalpodautoscaler_spec_min_replicas"), ">"))
    out = A.set_and(out, A.binop(_is(c, now), _is(c, "horizontalpodautoscaler_spec_max_replicas"), "<"))
    return A.set_and(out, _steady(c, now, "15m"))


WARNING = {"severity": "warning"}
KUBERNETES_APPS = RuleGroup("kubernetes-apps", "1m", [
    Alert("KubePodCrashLooping",
          lambda c: A.where_value(A.max_over_time(c.raw("kube_pod_container_status_waiting_reason", eq={**KSM, "reason": "CrashLoopBackOff"}), "5m", c.grid), ">=", 1),
          "15m", WARNING),
    Alert("KubePodNotReady", _not_ready, "15m", WARNING),
    Alert("KubeDeploymentGenerationMismatch", _compare("deployment_status_observed_generation", "!=", "deployment_metadata_generation"), "15m", WARNING),
    Alert("KubeDeploymentReplicasMismatch",
          _stuck("deployment_spec_replicas", ">", "deployment_status_replicas_available", "deployment_status_replicas_updated"), "15m", WARNING),
    Alert("KubeStatefulSetReplicasMismatch",
          _stuck("statefulset_status_replicas_ready", "!=", "statefulset_status_replicas", "statefulset_status_replicas_updated"), "15m", WARNING),
    Alert("KubeStatefulSetGenerationMismatch", _compare("statefulset_status_observed_generation", "!=", "statefulset_metadata_generation"), "15m", WARNING),
    Alert("KubeStatefulSetUpdateNotRolledOut", _not_rolled_out, "15m", WARNING),
    Alert("KubeDaemonSetRolloutStuck", _daemonset_stuck, "15m", WARNING),
    Alert("KubeContainerWaiting", _container_waiting, "1h", WARNING),
    Alert("KubeDaemonSetNotScheduled", _not_scheduled, "10m", WARNING),
    Alert("KubeDaemonSetMisScheduled", lambda c: A.where_value(_is(c, "daemonset_status_number_misscheduled"), ">", 0), "15m", WARNING),
    Alert("KubeJobNotCompleted", _job_not_completed, "0s", WARNING),
    Alert("KubeJobFailed", lambda c: A.where_value(_is(c, "job_failed"), ">", 0), "15m", WARNING),
    Alert("KubeHpaReplicasMismatch", _hpa_mismatch, "15m", WARNING),
    Alert("KubeHpaMaxedOut", _compare("horizontalpodautoscaler_status_current_replicas", "==", "horizontalpodautoscaler_spec_max_replicas"), "15m", WARNING),
])
