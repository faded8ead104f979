"""Registered queries of the node, scheduler, resource and system rule packs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import TS, VALUE, Grid, duration_ms
from . import k8s_metrics as K
from . import node_cluster_metrics as N
from . import sqlgen as S
from .catalog import hq_sql, rnd
from .catalog_rules import END, START
from .rulegroup import run_group, run_groups
from .rules import cluster as R
from .rules import core as RC

QUERIES, SQL = {}, {}
G = Grid.range(START, END, "1m")
M5 = 300_000


def _source(spark, sf, group):
    return N.extended(spark, sf, K.families(spark, sf))


def _records(name, group):
    def q(spark, sf):
        r = run_group(spark, group, _source(spark, sf, group), START, END, write=True).records
        return r.df.select(*r.labels, TS, rnd(F.col(VALUE), 6).alias(VALUE))
    q.__doc__ = f"Recording rules of group '{group.name}' over the derived cluster metrics."
    QUERIES[name] = q


def _alerts(name, group, *others, write=False):
    def q(spark, sf):
        res = run_groups(spark, [group, *others], _source(spark, sf, group), START, END, write=write)[group.name]
        return res.alerts.select(*res.alert_labels, TS, rnd(F.col(VALUE), 6).alias(VALUE), "state", "active_at")
    q.__doc__ = f"Alerting rules of group '{group.name}' with their for-state."
    QUERIES[name] = q


def _inst(name: str, where: str = "true") -> str:
    src, labels = N.sql(name)
    return S.instant(f"(SELECT * FROM {src} WHERE {where})", labels, G, M5)


def _rate(name: str, where: str = "true", per_second: bool = True) -> str:
    src, labels = N.sql(name)
    return S.extrapolated(f"(SELECT * FROM {src} WHERE {where})", labels, G, M5, per_second=per_second)


def _node_exporter_sql() -> str:
    from .catalog_rules import _NCPU, _NCPU_L, _net_sql, _NET_L
    lab = "job, namespace, pod, instance"
    ncpu = f"(SELECT {lab}, ts, CAST(COUNT(*) AS DOUBLE) AS value FROM {S.instant(f'(SELECT * FROM {_NCPU} WHERE mode = {chr(39)}idle{chr(39)})', _NCPU_L, G, M5)} GROUP BY ALL)"
    waiting = S.extrapolated(f"(SELECT * FROM {_NCPU} WHERE mode IN ('idle', 'iowait', 'steal'))", _NCPU_L, G, M5)
    used = (f"(SELECT {lab}, ts, 1 - AVG(value) AS value FROM (SELECT {lab}, cpu, ts, SUM(value) AS value FROM {waiting} GROUP BY ALL) GROUP BY ALL)")

    def mem(scale, own):
        src = (f"(SELECT 'node-exporter' AS job, 'node-' || CAST(user_id % 7 AS VARCHAR) || ':9100' AS instance, "
               f"{K.T0} + (epoch_us(ts) // 1000 - {K.T0}) // {K.TIME_SCALE} AS ts, ROUND(value * {scale}) AS value FROM events "
               f"WHERE user_id % 7 {'<>' if own else '='} 0)")
        return S.instant(src, ["job", "instance"], G, M5)
    free = (f"(SELECT job, instance, ts, value FROM {mem(1e7, True)} UNION ALL SELECT b.job, b.instance, b.ts, b.value + c.value + f.value + s.value "
            f"FROM {mem(1e6, False)} b JOIN {mem(3e6, False)} c USING (instance, ts) JOIN {mem(4e6, False)} f USING (instance, ts) JOIN {mem(5e5, False)} s USING (instance, ts))")
    disks = "regexp_full_match(device, '(/dev/)?(mmcblk.p.+|nvme.+|rbd.+|sd.+|vd.+|xvd.+|dm-.+|dasd.+)')"

    def net(src, labels):
        left = [x for x in labels if x != "device"]
        none = ", ".join("'' AS " + x for x in ("namespace", "pod") if x not in left)
        inner = f"(SELECT {', '.join(left)}, ts, SUM(value) AS value FROM {src} GROUP BY ALL)"
        return f"SELECT job, {none + ', ' if none else 'namespace, pod, '}instance, '' AS device, ts, value FROM {inner}"
    drop = {d: net(_rate(f"node_network_{d}_drop_total", "device <> 'lo'"), N.sql(f"node_network_{d}_drop_total")[1]) for d in ("receive", "transmit")}
    nic = {d: net(S.extrapolated(f"(SELECT * FROM {_net_sql(k)} WHERE device <> 'lo')", _NET_L, G, M5), _NET_L) for d, k in (("receive", 1000), ("transmit", 300))}
    plain = f"SELECT {lab}, '' AS device, ts, value FROM"
    parts = {
        "instance:node_num_cpu:sum": f"{plain} {ncpu}",
        "instance:node_cpu_utilisation:rate5m": f"{plain} {used}",
        "instance:node_load1_per_cpu:ratio": f"SELECT l.job, l.namespace, l.pod, l.instance, '' AS device, l.ts, l.value / n.value AS value FROM {_inst('node_load1')} l "
                                             f"JOIN {ncpu} n USING (job, namespace, pod, instance, ts)",
        "instance:node_memory_utilisation:ratio": f"SELECT f.job, '' AS namespace, '' AS pod, f.instance, '' AS device, f.ts, 1 - f.value / t.value AS value FROM {free} f "
                                                  f"JOIN {_inst('node_memory_MemTotal_bytes')} t USING (job, instance, ts)",
        "instance:node_vmstat_pgmajfault:rate5m": f"{plain} {_rate('node_vmstat_pgmajfault')}",
        "instance_device:node_disk_io_time_seconds:rate5m": f"SELECT {lab}, device, ts, value FROM {_rate('node_disk_io_time_seconds_total', disks)}",
        "instance_device:node_disk_io_time_weighted_seconds:rate5m": f"SELECT {lab}, device, ts, value FROM {_rate('node_disk_io_time_weighted_seconds_total', disks)}",
        "instance:node_network_receive_bytes_excluding_lo:rate5m": nic["receive"],
        "instance:node_network_transmit_bytes_excluding_lo:rate5m": nic["transmit"],
        "instance:node_network_receive_drop_excluding_lo:rate5m": drop["receive"],
        "instance:node_network_transmit_drop_excluding_lo:rate5m": drop["transmit"],
    }
    return " UNION ALL ".join(f"SELECT '{n}' AS __name__, job, namespace, pod, instance, device, ts, ROUND(value, 6) AS value FROM ({q})" for n, q in parts.items())


def _scheduler_sql() -> str:
    parts = []
    for q in (0.99, 0.9, 0.5):
        for family in R.SCHEDULER_FAMILIES:
            summed = f"(SELECT job, le, ts, SUM(value) AS value FROM {_rate(f'scheduler_{family}_duration_seconds_bucket')} GROUP BY ALL)"
            parts.append(f"SELECT 'cluster_quantile:scheduler_{family}_duration_seconds:histogram_quantile' AS __name__, job, '{q}' AS quantile, ts, "
                         f"ROUND(value, 6) AS value FROM {hq_sql(summed, ['job'], q)}")
    return " UNION ALL ".join(parts)


def _held_sql(parts: list[tuple[str, str, str, str]], labels: list[str]) -> str:
    """parts: alert name, severity, for, SQL of (some labels, ts, value)."""
    rows = []
    for name, severity, for_, sql in parts:
        rows.append(f"SELECT '{name}' AS alertname, '{severity}' AS severity, {duration_ms(for_)} AS for_ms, {', '.join([*labels, 'ts', 'value'])} FROM ({sql})")
    ids = ", ".join(["alertname", "severity", *labels])
    return f"""WITH a AS ({" UNION ALL ".join(rows)}),
r AS (SELECT *, CASE WHEN LAG(ts) OVER (PARTITION BY {ids} ORDER BY ts) = ts - {G.step} THEN 0 ELSE 1 END AS fresh FROM a),
i AS (SELECT *, SUM(fresh) OVER (PARTITION BY {ids} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r),
s AS (SELECT *, MIN(ts) OVER (PARTITION BY {ids}, run) AS active_at FROM i)
SELECT {ids}, ts, ROUND(value, 6) AS value, CASE WHEN ts - active_at >= for_ms THEN 'firing' ELSE 'pending' END AS state, active_at FROM s"""


def _resources_sql() -> str:
    labels = ["namespace", "resource", "container", "pod"]

    def wide(sql: str, have: list[str]) -> str:
        return "SELECT " + ", ".join(x if x in have else f"'' AS {x}" for x in labels) + f", ts, value FROM ({sql})"
    parts = []
    for res, name in (("cpu", "KubeCPUOvercommit"), ("memory", "KubeMemoryOvercommit")):
        spare = f"(SELECT ts, SUM(value) - MAX(value) AS value FROM {_inst('kube_node_status_allocatable', f'resource = {chr(39)}{res}{chr(39)}')} GROUP BY ts)"
        asked = f"(SELECT ts, SUM(value) AS value FROM {_inst(f'namespace_{res}:kube_pod_container_resource_requests:sum')} GROUP BY ts)"
        parts.append((name, "warning", "10m", wide(f"SELECT ts, a.value - s.value AS value FROM {asked} a JOIN {spare} s USING (ts) WHERE a.value - s.value > 0 AND s.value > 0", [])))
    for res, name in (("cpu", "KubeCPUQuotaOvercommit"), ("memory", "KubeMemoryQuotaOvercommit")):
        hard = _inst("kube_resourcequota", f"type = 'hard' AND resource IN ('{res}', 'requests.{res}')")
        quota = f"(SELECT ts, SUM(value) AS value FROM (SELECT job, namespace, type, ts, MIN(value) AS value FROM {hard} GROUP BY ALL) GROUP BY ts)"
        room = f"(SELECT ts, SUM(value) AS value FROM {_inst('kube_node_status_allocatable', f'resource = {chr(39)}{res}{chr(39)}')} GROUP BY ts)"
        parts.append((name, "warning", "5m", wide(f"SELECT ts, q.value / r.value AS value FROM {quota} q JOIN {room} r USING (ts) WHERE q.value / r.value > 1.5", [])))
    share = (f"(SELECT namespace, resource, ts, u.value / h.value AS value FROM {_inst('kube_resourcequota', 'type = ' + chr(39) + 'used' + chr(39))} u "
             f"JOIN {_inst('kube_resourcequota', 'type = ' + chr(39) + 'hard' + chr(39))} h USING (namespace, resource, ts) WHERE h.value > 0)")
    for name, severity, cond in (("KubeQuotaAlmostFull", "info", "value > 0.9 AND value < 1"), ("KubeQuotaFullyUsed", "info", "value = 1"), ("KubeQuotaExceeded", "warning", "value > 1")):
        parts.append((name, severity, "15m", wide(f"SELECT * FROM {share} WHERE {cond}", ["namespace", "resource"])))
    by = "container, pod, namespace"
    hit = f"(SELECT {by}, ts, SUM(value) AS value FROM {_rate('container_cpu_cfs_throttled_periods_total', 'container <> ' + chr(39) * 2, per_second=False)} GROUP BY ALL)"
    allp = f"(SELECT {by}, ts, SUM(value) AS value FROM {_rate('container_cpu_cfs_periods_total', per_second=False)} GROUP BY ALL)"
    parts.append(("CPUThrottlingHigh", "info", "15m", wide(f"SELECT {by}, ts, h.value / p.value AS value FROM {hit} h JOIN {allp} p USING ({by}, ts) WHERE h.value / p.value > 0.25",
                                                          ["container", "pod", "namespace"])))
    return _held_sql(parts, labels)


def _general_sql() -> str:
    """TargetDown, Watchdog and, over the states of these and of the resource alerts, InfoInhibitor."""
    from .catalog_rules import _GRID, _UP_I
    labels = ["job", "namespace", "service", "alertstate", "resource", "container", "pod"]

    def wide(*have: str) -> str:
        return ", ".join(x if x in have else f"'' AS {x}" for x in labels) + ", ts, value"
    down = (f"(SELECT job, namespace, service, ts, 100 * (COUNT(*) FILTER (WHERE value = 0) / COUNT(*)) AS value FROM {_UP_I} GROUP BY job, namespace, service, ts)")
    first = [("TargetDown", "warning", "10m", f"SELECT {wide('job', 'namespace', 'service')} FROM {down} WHERE value > 10"),
             ("Watchdog", "none", "0s", f"SELECT {wide()} FROM (SELECT ts, 1.0 AS value FROM {_GRID})")]
    states = f"SELECT namespace, resource, container, pod, severity, state, ts FROM ({_resources_sql()})"
    loud = (f"SELECT namespace, ts FROM ({states}) WHERE severity IN ('warning', 'critical') AND state = 'firing' "
            f"UNION ALL SELECT namespace, ts FROM ({_held_sql(first[:1], labels)}) WHERE state = 'firing'")
    info = (f"SELECT *, state AS alertstate, 1.0 AS value FROM ({states}) WHERE severity = 'info' AND (namespace, ts) NOT IN (SELECT (namespace, ts) FROM ({loud}))")
    return _held_sql([*first, ("InfoInhibitor", "none", "0s", f"SELECT {wide('namespace', 'alertstate', 'resource', 'container', 'pod')} FROM ({info})")], labels)


def _system_sql() -> str:
    info = _inst("kubernetes_build_info", "NOT regexp_full_match(job, 'kube-dns|coredns')")
    kinds = f"(SELECT COUNT(DISTINCT regexp_replace(git_version, '^(v[0-9]*.[0-9]*).*$', '\\1')) AS n, ts FROM {info} GROUP BY ts)"
    by = "instance, job, namespace"
    bad = f"(SELECT {by}, ts, SUM(value) AS value FROM {_rate('rest_client_requests_total', 'code LIKE ' + chr(39) + '5__' + chr(39))} GROUP BY ALL)"
    every = f"(SELECT {by}, ts, SUM(value) AS value FROM {_rate('rest_client_requests_total')} GROUP BY ALL)"
    return _held_sql([
        ("KubeVersionMismatch", "warning", "15m", f"SELECT '' AS cluster, '' AS instance, '' AS job, '' AS namespace, ts, CAST(n AS DOUBLE) AS value FROM {kinds} WHERE n > 1"),
        ("KubeClientErrors", "warning", "15m", f"SELECT '' AS cluster, {by}, ts, b.value / e.value AS value FROM {bad} b JOIN {every} e USING ({by}, ts) WHERE b.value / e.value > 0.01"),
    ], ["cluster", "instance", "job", "namespace"])


def _ratio(part: str, whole: str, limit: float, by: str = "") -> str:
    """part / whole above a limit; both are sums of rates by some labels."""
    key = f"{by}, ts" if by else "ts"
    summed = [f"(SELECT {key}, SUM(value) AS value FROM {x} GROUP BY ALL)" for x in (part, whole)]
    return f"SELECT {key}, p.value / w.value AS value FROM {summed[0]} p JOIN {summed[1]} w USING ({key}) WHERE p.value / w.value > {limit}"


def _wide(labels: list[str]):
    def f(sql: str, *have: str, **fixed: str) -> str:
        cols = [x if x in have else f"'{fixed.get(x, '')}' AS {x}" for x in labels]
        return f"SELECT {', '.join(cols)}, ts, value FROM ({sql})"
    return f


def _rate10(name: str) -> str:
    src, labels = N.sql(name)
    return S.extrapolated(src, labels, G, 600_000)


def _state_metrics_sql() -> str:
    parts = [(f"KubeStateMetrics{kind}Errors", "critical", "15m",
              _ratio(_rate(f"kube_state_metrics_{kind.lower()}_total", "result = 'error'"), _rate(f"kube_state_metrics_{kind.lower()}_total"), 0.01))
             for kind in ("List", "Watch")]
    total, ordinal = _inst("kube_state_metrics_total_shards"), _inst("kube_state_metrics_shard_ordinal")
    parts.append(("KubeStateMetricsShardingMismatch", "critical", "15m", f"SELECT * FROM (SELECT ts, VAR_POP(value) AS value FROM {total} GROUP BY ts) WHERE value <> 0"))
    have = f"(SELECT ts, SUM(m) AS value FROM (SELECT shard_ordinal, ts, pow(2, MAX(value)) AS m FROM {ordinal} GROUP BY ALL) GROUP BY ts)"
    parts.append(("KubeStateMetricsShardsMissing", "critical", "15m",
                  f"SELECT ts, t.m - h.value AS value FROM (SELECT ts, pow(2, MAX(value)) - 1 AS m FROM {total} GROUP BY ts) t JOIN {have} h USING (ts) WHERE t.m - h.value <> 0"))
    return _held_sql(parts, [])


def _operator_sql() -> str:
    from .catalog import _over_time_sql
    wide = _wide(["controller", "namespace", "job", "status", "label_state"])
    by = "controller, namespace"

    def fam(name):
        return f"prometheus_operator_{name}"

    def over(name, where, f):
        src, labels = N.sql(fam(name))
        return _over_time_sql(f"(SELECT * FROM {src} WHERE {where})", labels, G, M5, f)
    ready = over("ready", "true", "MAX(value)")
    two = ["controller", "namespace"]
    return _held_sql([
        ("PrometheusOperatorListErrors", "warning", "15m", wide(_ratio(_rate10(fam("list_operations_failed_total")), _rate10(fam("list_operations_total")), 0.4, by), *two)),
        ("PrometheusOperatorWatchErrors", "warning", "15m", wide(_ratio(_rate(fam("watch_operations_failed_total")), _rate(fam("watch_operations_total")), 0.4, by), *two)),
        ("PrometheusOperatorSyncFailed", "warning", "10m", wide(f"SELECT * FROM {over('syncs', 'status = ' + chr(39) + 'failed' + chr(39), 'MIN(value)')} WHERE value > 0", *two, "job", "status")),
        ("PrometheusOperatorReconcileErrors", "warning", "10m", wide(_ratio(_rate(fam("reconcile_errors_total")), _rate(fam("reconcile_operations_total")), 0.1, by), *two)),
        ("PrometheusOperatorNodeLookupErrors", "warning", "10m", wide(f"SELECT * FROM {_rate(fam('node_address_lookup_errors_total'))} WHERE value > 0.1", *two, "job")),
        ("PrometheusOperatorNotReady", "warning", "5m", wide(f"SELECT {by}, ts, MIN(value) AS value FROM {ready} WHERE value = 0 GROUP BY ALL", *two)),
        ("PrometheusOperatorRejectedResources", "warning", "5m",
         wide(f"SELECT *, state AS label_state FROM {over('managed_resources', 'state = ' + chr(39) + 'rejected' + chr(39), 'MIN(value)')} WHERE value > 0", *two, "job", "label_state")),
    ], ["controller", "namespace", "job", "status", "label_state"])


def _apiserver_sql() -> str:
    from .catalog import _over_time_sql
    from .catalog_rules import _API_TL, _API_TOTAL, _GRID, _UP_I
    labels = ["job", "instance", "name", "namespace", "cluster"]
    wide = _wide(labels)
    used = f"(SELECT * FROM {_inst('apiserver_client_certificate_expiration_seconds_count')} WHERE value > 0)"
    bucket = f"(SELECT job, le, ts, SUM(value) AS value FROM {_rate('apiserver_client_certificate_expiration_seconds_bucket')} GROUP BY ALL)"
    left = hq_sql(bucket, ["job"], 0.01)
    parts = [("KubeClientCertificateExpiration", severity, "0s", wide(f"SELECT u.* FROM {used} u SEMI JOIN (SELECT * FROM {left} WHERE value < {limit}) l USING (job, ts)", "job", "instance"))
             for severity, limit in (("warning", 604800), ("critical", 86400))]
    src, have = N.sql("aggregator_unavailable_apiservice_total")
    errors = f"(SELECT name, namespace, ts, SUM(value) AS value FROM {S.extrapolated(src, have, G, 600_000, per_second=False)} GROUP BY ALL)"
    parts.append(("KubeAggregatedAPIErrors", "warning", "0s", wide(f"SELECT * FROM {errors} WHERE value > 4", "name", "namespace")))
    src, have = N.sql("aggregator_unavailable_apiservice")
    away = f"(SELECT name, namespace, ts, (1 - MAX(value)) * 100 AS value FROM {_over_time_sql(src, have, G, 600_000, 'AVG(value)')} GROUP BY ALL)"
    parts.append(("KubeAggregatedAPIDown", "warning", "5m", wide(f"SELECT * FROM {away} WHERE value < 85", "name", "namespace")))
    parts.append(("KubeAPIDown", "critical", "15m",
                  wide(f"SELECT g.ts, 1.0::DOUBLE AS value FROM {_GRID} g WHERE g.ts NOT IN (SELECT ts FROM {_UP_I} WHERE job = 'apiserver' AND value = 1)", job="apiserver")))
    ended = f"(SELECT ts, SUM(value) AS value FROM {_rate10('apiserver_request_terminations_total')} GROUP BY ts)"
    every = f"(SELECT ts, SUM(value) AS value FROM {S.extrapolated(_API_TOTAL, _API_TL, G, 600_000)} GROUP BY ts)"
    parts.append(("KubeAPITerminatedRequests", "warning", "5m",
                  wide(f"SELECT ts, e.value / (a.value + e.value) AS value FROM {ended} e JOIN {every} a USING (ts) WHERE e.value / (a.value + e.value) > 0.2")))
    return _held_sql(parts, labels)


def _kubelet_sql() -> str:
    from .catalog import _changes_sql
    from .catalog_rules import _BASE, _GRID, _UP_I
    labels = ["cluster", "job", "node", "condition", "status", "key", "effect", "instance", "metrics_path", "quantile"]
    wide = _wide(labels)
    quote = lambda x: "'" + x + "'"
    cond = _inst("kube_node_status_condition", "condition = 'Ready' AND status = 'true'")
    parts = [("KubeNodeNotReady", "warning", "15m", wide(f"SELECT * FROM {cond} WHERE value = 0", "job", "node", "condition", "status"))]
    gone = _inst("kube_node_spec_taint", "key = 'node.kubernetes.io/unreachable' AND effect = 'NoSchedule'")
    planned = _inst("kube_node_spec_taint", f"regexp_full_match(key, {quote(R.LEAVING)})")
    parts.append(("KubeNodeUnreachable", "warning", "15m",
                  wide(f"SELECT * FROM {gone} WHERE value = 1 AND (job, node, effect, ts) NOT IN (SELECT (job, node, effect, ts) FROM {planned})", "job", "node", "key", "effect")))
    phase = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.PHASES.items()) + " END"
    pods = f"(SELECT DISTINCT 'ns-' || CAST(uid % 5 AS VARCHAR) AS namespace, 'pod-' || CAST(uid AS VARCHAR) AS pod, 'node-' || CAST(uid % 7 AS VARCHAR) AS node, {phase} AS phase, g.ts " \
           f"FROM {_BASE} b JOIN {_GRID} g ON b.ts > g.ts - {M5} AND b.ts <= g.ts)"
    room = f"(SELECT node, ts, MAX(value) AS value FROM {_inst('kube_node_status_capacity', 'resource = ' + quote('pods'))} WHERE value <> 1 GROUP BY ALL)"
    parts.append(("KubeletTooManyPods", "info", "15m",
                  wide(f"SELECT node, ts, n / value AS value FROM (SELECT node, ts, COUNT(*) AS n FROM {pods} WHERE phase = 'Running' GROUP BY ALL) JOIN {room} USING (node, ts) WHERE n / value > 0.95", "node")))
    src, have = N.sql("kube_node_status_condition")
    ready = f"(SELECT * FROM {src} WHERE condition = 'Ready' AND status = 'true')"
    flaps = f"(SELECT node, ts, SUM(value) AS value FROM {_changes_sql(ready, have, G, 900_000)} GROUP BY ALL)"
    parts.append(("KubeNodeReadinessFlapping", "warning", "15m", wide(f"SELECT * FROM {flaps} WHERE value > 2", "node")))
    pleg = _inst("node_quantile:kubelet_pleg_relist_duration_seconds:histogram_quantile", "quantile = '0.99'")
    parts.append(("KubeletPlegDurationHigh", "warning", "5m", wide(f"SELECT * FROM {pleg} WHERE value >= 10", "job", "instance", "metrics_path", "quantile")))
    bucket = f"(SELECT instance, le, ts, SUM(value) AS value FROM {_rate('kubelet_pod_worker_duration_seconds_bucket')} GROUP BY ALL)"
    name = (f"(SELECT DISTINCT 'node-' || CAST(uid % 7 AS VARCHAR) || ':9100' AS instance, 'node-' || CAST(uid % 7 AS VARCHAR) AS node, g.ts "
            f"FROM {_BASE} b JOIN {_GRID} g ON b.ts > g.ts - {M5} AND b.ts <= g.ts)")
    parts.append(("KubeletPodStartUpLatencyHigh", "warning", "15m",
                  wide(f"SELECT instance, node, ts, value FROM {hq_sql(bucket, ['instance'], 0.99)} JOIN {name} USING (instance, ts) WHERE value > 60", "instance", "node")))
    own = ["job", "instance", "metrics_path"]
    for who, title in (("client", "Client"), ("server", "Server")):
        for severity, limit in (("warning", 604800), ("critical", 86400)):
            parts.append((f"Kubelet{title}CertificateExpiration", severity, "0s",
                          wide(f"SELECT * FROM {_inst(f'kubelet_certificate_manager_{who}_ttl_seconds')} WHERE value < {limit}", *own)))
    for family, title in (("kubelet_certificate_manager_client_expiration_renew_errors", "Client"), ("kubelet_server_expiration_renew_errors", "Server")):
        parts.append((f"Kubelet{title}CertificateRenewalErrors", "warning", "15m", wide(f"SELECT * FROM {_rate(family, per_second=False)} WHERE value > 0", *own)))
    parts.append(("KubeletDown", "critical", "15m",
                  wide(f"SELECT g.ts, 1.0::DOUBLE AS value FROM {_GRID} g WHERE g.ts NOT IN (SELECT ts FROM {_UP_I} WHERE job = 'kubelet' AND value = 1)", job="kubelet", metrics_path="/metrics")))
    return _held_sql(parts, labels)


def _storage_sql() -> str:
    from .catalog import _regr_sql
    labels = ["job", "metrics_path", "namespace", "persistentvolumeclaim", "persistentvolume", "phase"]
    wide = _wide(labels)
    claim = "namespace, persistentvolumeclaim, ts"
    own = ["job", "metrics_path", "namespace", "persistentvolumeclaim"]
    ro = f"SELECT ({claim}) FROM {_inst('kube_persistentvolumeclaim_access_mode')} WHERE access_mode = 'ReadOnlyMany' AND value = 1"
    out = f"SELECT ({claim}) FROM {_inst('kube_persistentvolumeclaim_labels')} WHERE label_excluded_from_alerts = 'true' AND value = 1"
    parts = []
    for name, (left, room, used) in (("KubePersistentVolumeFillingUp", R._BYTES), ("KubePersistentVolumeInodesFillingUp", R._INODES)):
        share = (f"(SELECT l.job, l.metrics_path, l.namespace, l.persistentvolumeclaim, l.ts, l.value / r.value AS value FROM {_inst(left)} l JOIN {_inst(room)} r "
                 f"USING (namespace, persistentvolumeclaim, ts) JOIN {_inst(used)} u USING (namespace, persistentvolumeclaim, ts) WHERE u.value > 0)")
        keep = f"({claim}) NOT IN ({ro}) AND ({claim}) NOT IN ({out})"
        src, have = N.sql(left)
        soon = f"SELECT ({claim}) FROM {_regr_sql(src, have, G, 21_600_000, 'slope * 345600 + icpt')} WHERE value < 0"
        parts.append((name, "critical", "1m", wide(f"SELECT * FROM {share} WHERE value < 0.03 AND {keep}", *own)))
        parts.append((name, "warning", "1h", wide(f"SELECT * FROM {share} WHERE value < 0.15 AND {keep} AND ({claim}) IN ({soon})", *own)))
    parts.append(("KubePersistentVolumeErrors", "critical", "5m",
                  wide(f"SELECT * FROM {_inst('kube_persistentvolume_status_phase')} WHERE phase IN ('Failed', 'Pending') AND value > 0", "job", "persistentvolume", "phase")))
    return _held_sql(parts, labels)


_alerts("r_kubernetes_system_kubelet", R.KUBERNETES_SYSTEM_KUBELET)
_alerts("r_kubernetes_storage", R.KUBERNETES_STORAGE)
SQL["r_kubernetes_system_kubelet"] = _kubelet_sql()
SQL["r_kubernetes_storage"] = _storage_sql()
def _apps_sql() -> str:
    from .catalog import _changes_sql, _over_time_sql
    from .catalog_rules import _BASE, _GRID
    labels = ["cluster", "job", "namespace", "pod", "container", "reason", "deployment", "statefulset", "daemonset", "job_name", "horizontalpodautoscaler"]
    wide = _wide(labels)

    def of(name):
        return f"kube_{name}"

    def compare(kind, left, op, right, more=""):
        return f"(SELECT l.job, l.namespace, l.{kind}, l.ts, l.value FROM {_inst(of(left))} l JOIN {_inst(of(right))} r USING (namespace, {kind}, ts) WHERE l.value {op} r.value{more})"

    def steady(kind, name, rng):
        src, have = N.sql(of(name))
        return f"(namespace, {kind}, ts) IN (SELECT (namespace, {kind}, ts) FROM {_changes_sql(src, have, G, rng)} WHERE value = 0)"

    def add(name, for_, sql, *have):
        parts.append((name, "warning", for_, wide(sql, *have)))
    parts: list = []
    src, have = N.sql("kube_pod_container_status_waiting_reason")
    crash = _over_time_sql(f"(SELECT * FROM {src} WHERE reason = 'CrashLoopBackOff')", have, G, M5, "MAX(value)")
    add("KubePodCrashLooping", "15m", f"SELECT * FROM {crash} WHERE value >= 1", "job", "namespace", "pod", "container", "reason")
    pending = ", ".join(f"'{k}'" for k, v in K.PHASES.items() if v in ("Pending", "Unknown"))
    pods = (f"(SELECT DISTINCT 'ns-' || CAST(uid % 5 AS VARCHAR) AS namespace, 'pod-' || CAST(uid AS VARCHAR) AS pod, g.ts, 1.0::DOUBLE AS value "
            f"FROM {_BASE} b JOIN {_GRID} g ON b.ts > g.ts - {M5} AND b.ts <= g.ts WHERE event_type IN ({pending}) AND uid % 4 <> 3)")
    add("KubePodNotReady", "15m", f"SELECT * FROM {pods}", "namespace", "pod")
    own = ("job", "namespace")
    add("KubeDeploymentGenerationMismatch", "15m",
        f"SELECT * FROM {compare('deployment', 'deployment_status_observed_generation', '<>', 'deployment_metadata_generation')}", *own, "deployment")
    add("KubeDeploymentReplicasMismatch", "15m", f"SELECT * FROM {compare('deployment', 'deployment_spec_replicas', '>', 'deployment_status_replicas_available')} "
        f"WHERE {steady('deployment', 'deployment_status_replicas_updated', 600_000)}", *own, "deployment")
    add("KubeStatefulSetReplicasMismatch", "15m", f"SELECT * FROM {compare('statefulset', 'statefulset_status_replicas_ready', '<>', 'statefulset_status_replicas')} "
        f"WHERE {steady('statefulset', 'statefulset_status_replicas_updated', 600_000)}", *own, "statefulset")
    add("KubeStatefulSetGenerationMismatch", "15m",
        f"SELECT * FROM {compare('statefulset', 'statefulset_status_observed_generation', '<>', 'statefulset_metadata_generation')}", *own, "statefulset")
    old = f"(SELECT * FROM {_inst('kube_statefulset_status_current_revision')} ANTI JOIN {_inst('kube_statefulset_status_update_revision')} USING (namespace, statefulset, revision, ts))"
    add("KubeStatefulSetUpdateNotRolledOut", "15m", f"SELECT b.* FROM {compare('statefulset', 'statefulset_replicas', '<>', 'statefulset_status_replicas_updated')} b "
        f"SEMI JOIN {old} USING (namespace, statefulset, ts) WHERE {steady('statefulset', 'statefulset_status_replicas_updated', M5)}", *own, "statefulset")
    want = "daemonset_status_desired_number_scheduled"
    off = [compare("daemonset", "daemonset_status_current_number_scheduled", "<>", want),
           f"(SELECT * FROM {_inst('kube_daemonset_status_number_misscheduled')} WHERE value <> 0)",
           compare("daemonset", "daemonset_status_updated_number_scheduled", "<>", want), compare("daemonset", "daemonset_status_number_available", "<>", want)]
    any_ = " UNION ALL ".join(f"SELECT job, namespace, daemonset, ts, value, {i} AS place FROM {x}" for i, x in enumerate(off))
    add("KubeDaemonSetRolloutStuck", "15m", f"SELECT * FROM (SELECT job, namespace, daemonset, ts, arg_min(value, place) AS value FROM ({any_}) GROUP BY ALL) "
        f"WHERE {steady('daemonset', 'daemonset_status_updated_number_scheduled', M5)}", *own, "daemonset")
    waiting = f"(SELECT namespace, pod, container, ts, SUM(value) AS value FROM {_inst('kube_pod_container_status_waiting_reason')} GROUP BY ALL)"
    add("KubeContainerWaiting", "1h", f"SELECT * FROM {waiting} WHERE value > 0", "namespace", "pod", "container")
    add("KubeDaemonSetNotScheduled", "10m", f"SELECT w.job, w.namespace, w.daemonset, w.ts, w.value - n.value AS value FROM {_inst(of(want))} w "
        f"JOIN {_inst('kube_daemonset_status_current_number_scheduled')} n USING (namespace, daemonset, ts) WHERE w.value - n.value > 0", *own, "daemonset")
    add("KubeDaemonSetMisScheduled", "15m", f"SELECT * FROM {_inst('kube_daemonset_status_number_misscheduled')} WHERE value > 0", *own, "daemonset")
    begun = (f"(SELECT s.namespace, s.job_name, s.ts, s.ts / 1000.0 - s.value AS value FROM {_inst('kube_job_status_start_time')} s "
             f"JOIN {_inst('kube_job_status_active')} a USING (namespace, job_name, ts) WHERE a.value > 0)")
    add("KubeJobNotCompleted", "0s", f"SELECT * FROM {begun} WHERE value > 43200", "namespace", "job_name")
    add("KubeJobFailed", "15m", f"SELECT * FROM {_inst('kube_job_failed')} WHERE value > 0", *own, "job_name")
    hpa, now = "horizontalpodautoscaler", "horizontalpodautoscaler_status_current_replicas"
    low, high = (f"(namespace, {hpa}, ts) IN (SELECT (namespace, {hpa}, ts) FROM {compare(hpa, now, op, f'{hpa}_spec_{x}_replicas')})" for op, x in ((">", "min"), ("<", "max")))
    add("KubeHpaReplicasMismatch", "15m", f"SELECT * FROM {compare(hpa, f'{hpa}_status_desired_replicas', '<>', now)} WHERE {low} AND {high} AND {steady(hpa, now, 900_000)}", *own, hpa)
    add("KubeHpaMaxedOut", "15m", f"SELECT * FROM {compare(hpa, now, '=', f'{hpa}_spec_max_replicas')}", *own, hpa)
    return _held_sql(parts, labels)


_alerts("r_general_alerts", RC.GENERAL, R.KUBERNETES_RESOURCES)
SQL["r_general_alerts"] = _general_sql()
_alerts("r_kubernetes_apps", R.KUBERNETES_APPS, write=True)
SQL["r_kubernetes_apps"] = _apps_sql()
_alerts("r_kube_state_metrics", R.KUBE_STATE_METRICS)
_alerts("r_prometheus_operator", R.PROMETHEUS_OPERATOR)
_alerts("r_kubernetes_system_apiserver", R.KUBERNETES_SYSTEM_APISERVER)
SQL["r_kube_state_metrics"] = _state_metrics_sql()
SQL["r_prometheus_operator"] = _operator_sql()
SQL["r_kubernetes_system_apiserver"] = _apiserver_sql()
_records("r_node_exporter_rules", R.NODE_EXPORTER_RULES)
_records("r_kube_scheduler", R.KUBE_SCHEDULER)
_alerts("r_kubernetes_resources", R.KUBERNETES_RESOURCES)
_alerts("r_kubernetes_system", R.KUBERNETES_SYSTEM)
SQL["r_node_exporter_rules"] = _node_exporter_sql()
SQL["r_kube_scheduler"] = _scheduler_sql()
SQL["r_kubernetes_resources"] = _resources_sql()
SQL["r_kubernetes_system"] = _system_sql()
