"""Rule packs: general, kube-prometheus-general, kube-prometheus-node-recording,
node, kubelet and k8s rule groups, written with the DataFrame operators.

A rule is a function of the evaluation context that composes the operators;
the names and numbers in it are the declared ones.
"""
from __future__ import annotations

from ... import api as A
from ...operators import alerts as AL
from ..rulegroup import Alert, Ctx, Record, RuleGroup

# Fixed values of the packs: rule, record, metric and label names, matchers,
# thresholds and durations.
KSM = {"job": "kube-state-metrics"}
CADVISOR = {"job": "kubelet", "metrics_path": "/metrics/cadvisor"}
BUSY = {"mode": "idle|iowait|steal"}


# ---------------------------------------------------------------- general.rules
def _target_down(c: Ctx):
    by = ["job", "namespace", "service"]
    up = c.sel("up")
    down = A.aggregate(A.where_value(up, "==", 0), "count", by=by)
    ratio = A.binop(down, A.aggregate(up, "count", by=by), "/")
    return A.where_value(A.scalar_op(ratio, "*", 100, scalar_left=True), ">", 10)


def _watchdog(c: Ctx):
    return A.vector(c.spark, c.grid, 1)


def _info_inhibitor(c: Ctx):
    info = A.where_value(c.sel("ALERTS", eq={"severity": "info"}), "==", 1)
    loud = A.where_value(c.sel("ALERTS", ne={"alertname": "InfoInhibitor"}, re={"severity": "warning|critical"},
                               eq={"alertstate": "firing"}), "==", 1)
    return A.set_unless(info, loud, on=["namespace"])


GENERAL = RuleGroup("general.rules", "1m", [
    Alert("TargetDown", _target_down, "10m", {"severity": "warning"}),
    Alert("Watchdog", _watchdog, "0s", {"severity": "none"}),
    Alert("InfoInhibitor", _info_inhibitor, "0s", {"severity": "none"}),
])

# ---------------------------------------------------------------- kube-prometheus-general.rules
KUBE_PROMETHEUS_GENERAL = RuleGroup("kube-prometheus-general.rules", "1m", [
    Record("count:up1", lambda c: A.aggregate(A.where_value(c.sel("up"), "==", 1), "count",
                                              without=["instance", "pod", "node"])),
    Record("count:up0", lambda c: A.aggregate(A.where_value(c.sel("up"), "==", 0), "count",
                                              without=["instance", "pod", "node"])),
])


# ---------------------------------------------------------------- kube-prometheus-node-recording.rules
def _cpu_busy(c: Ctx, rng: str):
    return A.rate(c.raw("node_cpu_seconds_total", nre=BUSY), rng, c.grid)


def _num_cpu(c: Ctx, by):
    return A.aggregate(A.aggregate(c.sel("node_cpu_seconds_total"), "sum", by=["instance", "cpu"]), "count", by=by)


NODE_RECORDING = RuleGroup("kube-prometheus-node-recording.rules", "1m", [
    Record("instance:node_cpu:rate:sum", lambda c: A.aggregate(_cpu_busy(c, "3m"), "sum", by=["instance"])),
    Record("instance:node_network_receive_bytes:rate:sum",
           lambda c: A.aggregate(A.rate(c.raw("node_network_receive_bytes_total"), "3m", c.grid), "sum", by=["instance"])),
    Record("instance:node_network_transmit_bytes:rate:sum",
           lambda c: A.aggregate(A.rate(c.raw("node_network_transmit_bytes_total"), "3m", c.grid), "sum", by=["instance"])),
    Record("instance:node_cpu:ratio",
           lambda c: A.binop(A.aggregate(_cpu_busy(c, "5m"), "sum", without=["cpu", "mode"]),
                             _num_cpu(c, ["instance"]), "/", on=["instance"], group_left=[])),
    Record("cluster:node_cpu:sum_rate5m", lambda c: A.aggregate(_cpu_busy(c, "5m"), "sum")),
    Record("cluster:node_cpu:ratio",
           lambda c: A.binop(c.sel("cluster:node_cpu:sum_rate5m"), _num_cpu(c, []), "/")),
])


# ---------------------------------------------------------------- node.rules
def _pod_info_dedup(c: Ctx):
    info = A.label_replace(c.sel("kube_pod_info", eq=KSM, ne={"node": ""}), "pod", "$1", "pod", "(.*)")
    return A.topk(A.aggregate(info, "max", by=["cluster", "node", "namespace", "pod"]), 1,
                  by=["cluster", "namespace", "pod"])


def _node_num_cpu(c: Ctx):
    info = A.topk(c.sel("node_namespace_pod:kube_pod_info:"), 1, by=["namespace", "pod"])
    j = A.binop(c.sel("node_cpu_seconds_total", eq={"job": "node-exporter"}), info, "*", on=["namespace", "pod"],
                group_left=["node"], check_unique=False)
    return A.aggregate(A.aggregate(j, "sum", by=["node", "cpu"]), "count", by=["cluster", "node"])


def _mem_available(c: Ctx):
    ne = {"job": "node-exporter"}
    parts = [c.sel(f"node_memory_{n}_bytes", eq=ne) for n in ("Buffers", "Cached", "MemFree", "Slab")]
    total = parts[0]
    for p in parts[1:]:
        total = A.binop(total, p, "+")
    return A.aggregate(A.set_or(c.sel("node_memory_MemAvailable_bytes", eq=ne), total), "sum", by=["cluster"])


def _cpu_ratio_rate5m(c: Ctx):
    busy = A.aggregate(A.rate(c.raw("node_cpu_seconds_total", eq={"job": "node-exporter"}, nre=BUSY), "5m", c.grid),
                       "sum")
    n = A.aggregate(A.aggregate(c.sel("node_cpu_seconds_total", eq={"job": "node-exporter"}), "sum",
                                by=["cluster", "instance", "cpu"]), "count")
    return A.binop(busy, n, "/")


NODE = RuleGroup("node.rules", "1m", [
    Record("node_namespace_pod:kube_pod_info:", _pod_info_dedup),
    Record("node:node_num_cpu:sum", _node_num_cpu),
    Record(":node_memory_MemAvailable_bytes:sum", _mem_available),
    Record("cluster:node_cpu:ratio_rate5m", _cpu_ratio_rate5m),
])


# ---------------------------------------------------------------- kubelet.rules
def _pleg(q: float):
    def f(c: Ctx):
        r = A.aggregate(A.rate(c.raw("kubelet_pleg_relist_duration_seconds_bucket"), "5m", c.grid), "sum",
                        by=["cluster", "instance", "le"])
        names = c.sel("kubelet_node_name", eq={"job": "kubelet", "metrics_path": "/metrics"})
        return A.histogram_quantile(A.binop(r, names, "*", on=["cluster", "instance"], group_left=["node"]), q)
    return f


KUBELET = RuleGroup("kubelet.rules", "1m", [
    Record("node_quantile:kubelet_pleg_relist_duration_seconds:histogram_quantile", _pleg(q), {"quantile": str(q)})
    for q in (0.99, 0.9, 0.5)
])


# ---------------------------------------------------------------- k8s.rules
def _pod_node(c: Ctx, by):
    return c.shared("pod's node by " + ", ".join(by),
                    lambda c: A.topk(A.aggregate(c.sel("kube_pod_info", ne={"node": ""}), "max", by=list(by) + ["node"]), 1, by=by))


def _cpu_irate(c: Ctx):
    by = ["cluster", "namespace", "pod"]
    cpu = A.aggregate(A.irate(c.raw("container_cpu_usage_seconds_total", eq=CADVISOR, ne={"image": ""}), "5m", c.grid),
                      "sum", by=by + ["container"])
    return A.binop(cpu, _pod_node(c, by), "*", on=by, group_left=["node"], check_unique=False)


def _mem(metric: str):
    def f(c: Ctx):
        by = ["namespace", "pod"]
        return A.binop(c.sel(metric, eq=CADVISOR, ne={"image": ""}), _pod_node(c, by), "*", on=by,
                       group_left=["node"], check_unique=False)
    return f


def _active(c: Ctx):
    return c.shared("active pods",
                    lambda c: A.aggregate(A.where_value(c.sel("kube_pod_status_phase", re={"phase": "Pending|Running"}), "==", 1),
                                          "max", by=["namespace", "pod", "cluster"]))


def _res_active(metric: str, resource: str):
    def f(c: Ctx):
        return A.binop(c.sel(metric, eq={"resource": resource, **KSM}), _active(c), "*",
                       on=["namespace", "pod", "cluster"], group_left=[])
    return f


def _res_sum(metric: str, resource: str):
    def f(c: Ctx):
        m = A.aggregate(c.sel(metric, eq={"resource": resource, **KSM}), "max",
                        by=["namespace", "pod", "container", "cluster"])
        j = A.binop(m, _active(c), "*", on=["namespace", "pod", "cluster"], group_left=[])
        return A.aggregate(A.aggregate(j, "sum", by=["namespace", "pod", "cluster"]), "sum", by=["namespace", "cluster"])
    return f


def _owner_rs(c: Ctx):
    own = A.label_replace(c.sel("kube_pod_owner", eq={**KSM, "owner_kind": "ReplicaSet"}), "replicaset", "$1",
                          "owner_name", "(.*)")
    rs = A.topk(A.aggregate(c.sel("kube_replicaset_owner", eq=KSM), "max", by=["replicaset", "namespace", "owner_name"]),
                1, by=["replicaset", "namespace"])
    j = A.binop(own, rs, "*", on=["replicaset", "namespace"], group_left=["owner_name"], check_unique=False)
    return A.aggregate(A.label_replace(j, "workload", "$1", "owner_name", "(.*)"), "max",
                       by=["cluster", "namespace", "workload", "pod"])


def _owner(kind: str):
    def f(c: Ctx):
        o = c.sel("kube_pod_owner", eq={**KSM, "owner_kind": kind})
        return A.aggregate(A.label_replace(o, "workload", "$1", "owner_name", "(.*)"), "max",
                           by=["cluster", "namespace", "workload", "pod"])
    return f


K8S = RuleGroup("k8s.rules", "1m", [
    Record("node_namespace_pod_container:container_cpu_usage_seconds_total:sum_irate", _cpu_irate),
    Record("node_namespace_pod_container:container_memory_working_set_bytes", _mem("container_memory_working_set_bytes")),
    Record("node_namespace_pod_container:container_memory_rss", _mem("container_memory_rss")),
    Record("node_namespace_pod_container:container_memory_cache", _mem("container_memory_cache")),
    Record("node_namespace_pod_container:container_memory_swap", _mem("container_memory_swap")),
    Record("cluster:namespace:pod_memory:active:kube_pod_container_resource_requests",
           _res_active("kube_pod_container_resource_requests", "memory")),
    Record("namespace_memory:kube_pod_container_resource_requests:sum",
           _res_sum("kube_pod_container_resource_requests", "memory")),
    Record("cluster:namespace:pod_cpu:active:kube_pod_container_resource_requests",
           _res_active("kube_pod_container_resource_requests", "cpu")),
    Record("namespace_cpu:kube_pod_container_resource_requests:sum", _res_sum("kube_pod_container_resource_requests", "cpu")),
    Record("cluster:namespace:pod_memory:active:kube_pod_container_resource_limits",
           _res_active("kube_pod_container_resource_limits", "memory")),
    Record("namespace_memory:kube_pod_container_resource_limits:sum", _res_sum("kube_pod_container_resource_limits", "memory")),
    Record("cluster:namespace:pod_cpu:active:kube_pod_container_resource_limits",
           _res_active("kube_pod_container_resource_limits", "cpu")),
    Record("namespace_cpu:kube_pod_container_resource_limits:sum", _res_sum("kube_pod_container_resource_limits", "cpu")),
    Record("namespace_workload_pod:kube_pod_owner:relabel", _owner_rs, {"workload_type": "deployment"}),
    Record("namespace_workload_pod:kube_pod_owner:relabel", _owner("DaemonSet"), {"workload_type": "daemonset"}),
    Record("namespace_workload_pod:kube_pod_owner:relabel", _owner("StatefulSet"), {"workload_type": "statefulset"}),
    Record("namespace_workload_pod:kube_pod_owner:relabel", _owner("Job"), {"workload_type": "job"}),
])

GROUPS = [GENERAL, KUBE_PROMETHEUS_GENERAL, NODE_RECORDING, NODE, KUBELET, K8S]  # + the apiserver packs below


# ---------------------------------------------------------------- kube-apiserver-histogram.rules
API = {"job": "apiserver"}
READ, WRITE = "LIST|GET", "POST|PUT|PATCH|DELETE"
NOT_STREAMING = {"subresource": "proxy|attach|log|exec|portforward"}


def _api_p99(verbs: str):
    def f(c: Ctx):
        b = c.raw("apiserver_request_slo_duration_seconds_bucket", eq=API, re={"verb": verbs}, nre=NOT_STREAMING)
        s = A.aggregate(A.rate(b, "5m", c.grid), "sum", by=["cluster", "le", "resource"])
        return A.where_value(A.histogram_quantile(s, 0.99), ">", 0)
    return f


APISERVER_HISTOGRAM = RuleGroup("kube-apiserver-histogram.rules", "3m", [
    Record("cluster_quantile:apiserver_request_slo_duration_seconds:histogram_quantile", _api_p99(READ),
           {"quantile": "0.99", "verb": "read"}),
    Record("cluster_quantile:apiserver_request_slo_duration_seconds:histogram_quantile", _api_p99(WRITE),
           {"quantile": "0.99", "verb": "write"}),
])


# ---------------------------------------------------------------- kube-apiserver-burnrate.rules
def _burnrate(window: str, read: bool):
    verbs = READ if read else WRITE
    by = ["cluster"]

    def f(c: Ctx):
        def srate(metric, eq=None, re=None, nre=None):
            m = c.counted(metric, "15s", eq={**API, **(eq or {})}, re={"verb": verbs, **(re or {})}, nre=nre)
            return A.aggregate(A.rate(m, window, c.grid), "sum", by=by)
        bucket = "apiserver_request_slo_duration_seconds_bucket"
        count = srate("apiserver_request_slo_duration_seconds_count", nre=NOT_STREAMING)
        if read:
            fast = A.default_zero(srate(bucket, eq={"le": "1"}, re={"scope": "resource|"}, nre=NOT_STREAMING), c.grid)
            fast = A.binop(fast, srate(bucket, eq={"scope": "namespace", "le": "5"}, nre=NOT_STREAMING), "+")
            fast = A.binop(fast, srate(bucket, eq={"scope": "cluster", "le": "30"}, nre=NOT_STREAMING), "+")
        else:
            fast = srate(bucket, eq={"le": "1"}, nre=NOT_STREAMING)
        errors = srate("apiserver_request_total", re={"code": "5.."})
        bad = A.binop(A.binop(count, fast, "-"), errors, "+")
        return A.binop(bad, srate("apiserver_request_total"), "/")
    return f


BURN_WINDOWS = ("1d", "1h", "2h", "30m", "3d", "5m", "6h")
APISERVER_BURNRATE = RuleGroup("kube-apiserver-burnrate.rules", "1m", [
    Record(f"apiserver_request:burnrate{w}", _burnrate(w, read), {"verb": "read" if read else "write"})
    for read in (True, False) for w in BURN_WINDOWS
])


# ---------------------------------------------------------------- kube-apiserver-slos
def _burn_alert(long: str, short: str, factor: float):
    def f(c: Ctx):
        return AL.burn_rate_alert(A.aggregate(c.sel(f"apiserver_request:burnrate{long}"), "sum"),
                                  A.aggregate(c.sel(f"apiserver_request:burnrate{short}"), "sum"),
                                  factor, 0.01, "KubeAPIErrorBudgetBurn")
    return f


APISERVER_SLOS = RuleGroup("kube-apiserver-slos", "1m", [
    Alert("KubeAPIErrorBudgetBurn", _burn_alert("1h", "5m", 14.4), "2m",
          {"long": "1h", "severity": "critical", "short": "5m"}),
    Alert("KubeAPIErrorBudgetBurn", _burn_alert("6h", "30m", 6.0), "15m",
          {"long": "6h", "severity": "critical", "short": "30m"}),
    Alert("KubeAPIErrorBudgetBurn", _burn_alert("1d", "2h", 3.0), "1h",
          {"long": "1d", "severity": "warning", "short": "2h"}),
    Alert("KubeAPIErrorBudgetBurn", _burn_alert("3d", "6h", 1.0), "3h",
          {"long": "3d", "severity": "warning", "short": "6h"}),
])


# ---------------------------------------------------------------- kubernetes-system-{kube-proxy,controller-manager,scheduler}
def _component_down(job: str):
    def f(c: Ctx):
        return A.absent(A.where_value(c.sel("up", eq={"job": job}), "==", 1), c.grid, {"job": job})
    return f


SYSTEM_COMPONENTS = RuleGroup("kubernetes-system-components", "1m", [
    Alert("KubeProxyDown", _component_down("kube-proxy"), "15m", {"severity": "critical"}),
    Alert("KubeControllerManagerDown", _component_down("kube-controller-manager"), "15m", {"severity": "critical"}),
    Alert("KubeSchedulerDown", _component_down("kube-scheduler"), "15m", {"severity": "critical"}),
])


# ---------------------------------------------------------------- node-network
NODE_NETWORK = RuleGroup("node-network", "1m", [
    Alert("NodeNetworkInterfaceFlapping",
          lambda c: A.where_value(A.changes(c.raw("node_network_up", eq={"job": "node-exporter"},
                                                  nre={"device": "veth.+"}), "2m", c.grid), ">", 2),
          "2m", {"severity": "warning"}),
])


# ---------------------------------------------------------------- config-reloaders
CONFIG_RELOADERS = RuleGroup("config-reloaders", "1m", [
    Alert("ConfigReloaderSidecarErrors",
          lambda c: A.where_value(A.max_over_time(c.raw("reloader_last_reload_successful", re={"namespace": ".+"}),
                                                  "5m", c.grid), "==", 0),
          "10m", {"severity": "warning"}),
])
