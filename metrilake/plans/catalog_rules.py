"""Registered rule-pack queries (G1 and the R-* packs).

Each pack runs its rule group over the cluster metric families derived from
``events`` (time-compressed, see ``k8s_metrics``) on a 1m grid and returns the
recorded series (``__name__`` + labels) or the alert instances with state.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import TS, VALUE, Grid
from . import k8s_metrics as K
from . import sqlgen as S
from .catalog import rnd
from .rulegroup import run_group, run_groups
from .rules import core as RC

QUERIES, SQL = {}, {}
START, END = "2024-01-01T00:05:00", "2024-01-01T00:30:00"


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _records(group, write=False):
    def q(spark, sf):
        res = run_group(spark, group, K.families(spark, sf), START, END, write=write)
        r = res.records
        return r.df.select(*r.labels, TS, rnd(F.col(VALUE), 6).alias(VALUE))
    q.__doc__ = f"Recording rules of group '{group.name}' over the derived cluster metrics."
    return q


def _alerts(group):
    def q(spark, sf):
        res = run_group(spark, group, K.families(spark, sf), START, END)
        return res.alerts.select(*res.alert_labels, TS, rnd(F.col(VALUE), 6).alias(VALUE), "state", "active_at")
    q.__doc__ = f"Alerting rules of group '{group.name}' with their for-state."
    return q


_UP = f"""(SELECT CASE WHEN event_id % 997 = 0 THEN 'kube-scheduler' WHEN event_id % 499 = 1 THEN 'kube-controller-manager'
  WHEN event_id % 787 = 2 THEN 'apiserver'
  WHEN event_id % 10 = 3 THEN 'kube-proxy' ELSE 'job-' || CAST(user_id % 3 AS VARCHAR) END AS job, 'ns-' || CAST(user_id % 5 AS VARCHAR) AS namespace,
  'svc-' || CAST(user_id % 3 AS VARCHAR) AS service,
  {K.T0} + (epoch_us(ts) // 1000 - {K.T0}) // {K.TIME_SCALE} AS ts,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS value, user_id FROM events)"""
_GRID = ("(SELECT CAST(1704067500000 + i * 60000 AS BIGINT) AS ts FROM range(0, 26) r(i))")
_UP_I = f"""(SELECT u.job, u.namespace, u.service, u.user_id, g.ts, MAX(struct_pack(t := u.ts, v := u.value)).v AS value
  FROM {_UP} u JOIN {_GRID} g ON u.ts > g.ts - 300000 AND u.ts <= g.ts GROUP BY ALL)"""


@register("r_kube_prometheus_general", f"""
SELECT 'count:up1' AS __name__, job, namespace, service, ts, CAST(COUNT(*) AS DOUBLE) AS value FROM {_UP_I}
WHERE value = 1 GROUP BY ALL
UNION ALL
SELECT 'count:up0', job, namespace, service, ts, CAST(COUNT(*) AS DOUBLE) FROM {_UP_I} WHERE value = 0 GROUP BY ALL""")
def q_r_kube_prometheus_general(spark, sf):
    """``count without(instance, pod, node) (up == 1 / 0)`` as recorded series (G1)."""
    return _records(RC.KUBE_PROMETHEUS_GENERAL)(spark, sf)


# ---- DuckDB twin of the node-exporter families and the node-recording rules
_GR = Grid.range(START, END, "1m")
_BASE = (f"(SELECT event_id, event_type, value, {K.T0} + (epoch_us(ts) // 1000 - {K.T0}) // {K.TIME_SCALE} AS ts, "
         f"user_id AS uid FROM events)")
_MODE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.MODES.items()) + " END"
_NCPU_L = ["job", "namespace", "pod", "instance", "cpu", "mode"]
_NCPU = f"""(SELECT {", ".join(_NCPU_L)}, ts, SUM(inc) OVER (PARTITION BY {", ".join(_NCPU_L)} ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM (
  SELECT 'node-exporter' AS job, 'monitoring' AS namespace, 'node-exporter-' || CAST(uid % 7 AS VARCHAR) AS pod,
         'node-' || CAST(uid % 7 AS VARCHAR) || ':9100' AS instance, CAST(uid % 4 AS VARCHAR) AS cpu, {_MODE} AS mode,
         ts, event_id, value AS inc FROM {_BASE}))"""
_BUSY = f"(SELECT * FROM {_NCPU} WHERE NOT regexp_full_match(mode, 'idle|iowait|steal'))"
_NET_L = ["job", "instance", "device"]


def _net_sql(mult):
    return f"""(SELECT job, instance, device, ts, SUM(inc) OVER (PARTITION BY job, instance, device ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM (
  SELECT 'node-exporter' AS job, 'node-' || CAST(uid % 7 AS VARCHAR) || ':9100' AS instance, 'eth0' AS device,
         ts, event_id, value * {mult} AS inc FROM {_BASE}))"""


def _node_recording_sql():
    r5 = S.agg(S.extrapolated(_BUSY, _NCPU_L, _GR, 300_000), "sum", [])
    ncpu_i = S.agg(S.agg(S.instant(_NCPU, _NCPU_L, _GR, 300_000), "sum", ["instance", "cpu"]), "count", ["instance"])
    ncpu = S.agg(S.agg(S.instant(_NCPU, _NCPU_L, _GR, 300_000), "sum", ["instance", "cpu"]), "count", [])
    r4l = S.agg(S.extrapolated(_BUSY, _NCPU_L, _GR, 300_000), "sum", ["job", "namespace", "pod", "instance"])
    parts = [
        ("instance:node_cpu:rate:sum",
         f"SELECT instance, '' AS job, '' AS namespace, '' AS pod, ts, value FROM "
         f"{S.agg(S.extrapolated(_BUSY, _NCPU_L, _GR, 180_000), 'sum', ['instance'])}"),
        ("instance:node_network_receive_bytes:rate:sum",
         f"SELECT instance, '', '', '', ts, value FROM "
         f"{S.agg(S.extrapolated(_net_sql(1000), _NET_L, _GR, 180_000), 'sum', ['instance'])}"),
        ("instance:node_network_transmit_bytes:rate:sum",
         f"SELECT instance, '', '', '', ts, value FROM "
         f"{S.agg(S.extrapolated(_net_sql(300), _NET_L, _GR, 180_000), 'sum', ['instance'])}"),
        ("instance:node_cpu:ratio",
         f"SELECT l.instance, l.job, l.namespace, l.pod, l.ts, l.value / r.value FROM {r4l} l JOIN {ncpu_i} r "
         f"ON l.instance = r.instance AND l.ts = r.ts"),
        ("cluster:node_cpu:sum_rate5m", f"SELECT '', '', '', '', ts, value FROM {r5}"),
        ("cluster:node_cpu:ratio",
         f"SELECT '', '', '', '', l.ts, l.value / r.value FROM {r5} l JOIN {ncpu} r ON l.ts = r.ts"),
    ]
    body = " UNION ALL ".join(f"SELECT '{n}' AS __name__, * FROM ({q})" for n, q in parts)
    return f"SELECT __name__, instance, job, namespace, pod, ts, ROUND(value, 6) AS value FROM ({body})"


register("r_node_recording", _node_recording_sql())(_records(RC.NODE_RECORDING))
def _node_sql():
    info = f"""(SELECT 'kube-state-metrics' AS job, 'ns-' || CAST(uid % 5 AS VARCHAR) AS namespace,
         'pod-' || CAST(uid AS VARCHAR) AS pod, 'node-' || CAST(uid % 7 AS VARCHAR) AS node, ts, 1.0 AS value FROM {_BASE}
       UNION ALL
       SELECT 'kube-state-metrics', 'monitoring', 'node-exporter-' || CAST(uid % 7 AS VARCHAR),
         'node-' || CAST(uid % 7 AS VARCHAR), ts, 1.0 FROM {_BASE})"""
    ii = S.instant(f"(SELECT * FROM {info} WHERE node <> '')", ["job", "namespace", "pod", "node"], _GR, 300_000)
    mx = f"(SELECT node, namespace, pod, ts, MAX(value) AS value FROM {ii} GROUP BY ALL)"
    r1 = (f"(SELECT node, namespace, pod, ts, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY namespace, pod, ts "
          f"ORDER BY value DESC, node) AS rn FROM {mx}) WHERE rn = 1)")
    ncpu = S.instant(_NCPU, _NCPU_L, _GR, 300_000)
    j = f"(SELECT r.node, c.cpu, c.ts, c.value * r.value AS value FROM {ncpu} c JOIN {r1} r USING (namespace, pod, ts))"
    r2 = f"(SELECT node, ts, CAST(COUNT(*) AS DOUBLE) AS value FROM (SELECT node, cpu, ts FROM {j} GROUP BY ALL) GROUP BY ALL)"

    def mem(cond, scale):
        v = f"(SELECT 'node-exporter' AS job, 'node-' || CAST(uid % 7 AS VARCHAR) || ':9100' AS instance, ts, ROUND(value * {scale}) AS value FROM {_BASE} WHERE {cond})"
        return S.instant(v, ["job", "instance"], _GR, 300_000)
    avail = mem("uid % 7 <> 0", 1e7)
    bu, ca, fr, sl = (mem("uid % 7 = 0", x) for x in (1e6, 3e6, 4e6, 5e5))
    total = (f"(SELECT b.job, b.instance, b.ts, ((b.value + c.value) + f.value) + s.value AS value FROM {bu} b "
             f"JOIN {ca} c USING (job, instance, ts) JOIN {fr} f USING (job, instance, ts) JOIN {sl} s USING (job, instance, ts))")
    either = (f"(SELECT * FROM {avail} UNION ALL SELECT * FROM {total} t WHERE NOT EXISTS "
              f"(SELECT 1 FROM {avail} a WHERE a.job = t.job AND a.instance = t.instance AND a.ts = t.ts))")
    r3 = S.agg(either, "sum", [])
    busy = S.agg(S.extrapolated(_BUSY, _NCPU_L, _GR, 300_000), "sum", [])
    cnt = S.agg(S.agg(ncpu, "sum", ["instance", "cpu"]), "count", [])
    r4 = f"(SELECT l.ts, l.value / r.value AS value FROM {busy} l JOIN {cnt} r ON l.ts = r.ts)"
    parts = [
        ("node_namespace_pod:kube_pod_info:", f"SELECT node, namespace, pod, ts, value FROM {r1}"),
        ("node:node_num_cpu:sum", f"SELECT node, '', '', ts, value FROM {r2}"),
        (":node_memory_MemAvailable_bytes:sum", f"SELECT '', '', '', ts, value FROM {r3}"),
        ("cluster:node_cpu:ratio_rate5m", f"SELECT '', '', '', ts, value FROM {r4}"),
    ]
    body = " UNION ALL ".join(f"SELECT '{n}' AS __name__, * FROM ({q})" for n, q in parts)
    return f"SELECT __name__, '' AS cluster, node, namespace, pod, ts, ROUND(value, 6) AS value FROM ({body})"


register("r_node", _node_sql())(_records(RC.NODE))
def _kubelet_sql():
    from .catalog import hq_sql
    inf = "'inf'::DOUBLE"
    les = ", ".join(f"('{x}', {inf if x == '+Inf' else x})" for x in K.LE)
    pleg = f"""(SELECT job, instance, le, ts, SUM(inc) OVER (PARTITION BY job, instance, le ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM (
  SELECT 'kubelet' AS job, 'node-' || CAST(uid % 7 AS VARCHAR) || ':9100' AS instance, b.le, ts, event_id,
         CASE WHEN value / 40 <= b.ub THEN 1.0 ELSE 0.0 END AS inc
  FROM {_BASE} JOIN (VALUES {les}) b(le, ub) ON TRUE))"""
    names = (f"(SELECT 'kubelet' AS job, '/metrics' AS metrics_path, 'node-' || CAST(uid % 7 AS VARCHAR) || ':9100' "
             f"AS instance, 'node-' || CAST(uid % 7 AS VARCHAR) AS node, ts, 1.0 AS value FROM {_BASE})")
    r = S.agg(S.extrapolated(pleg, ["job", "instance", "le"], _GR, 300_000), "sum", ["instance", "le"])
    n = S.instant(names, ["job", "metrics_path", "instance", "node"], _GR, 300_000)
    j = (f"(SELECT r.instance, n.node, r.le, r.ts, r.value * n.value AS value FROM {r} r JOIN {n} n "
         f"ON r.instance = n.instance AND r.ts = n.ts)")
    parts = [f"SELECT '{q}' AS quantile, * FROM {hq_sql(j, ['instance', 'node'], q)}" for q in (0.99, 0.9, 0.5)]
    return (f"SELECT 'node_quantile:kubelet_pleg_relist_duration_seconds:histogram_quantile' AS __name__, "
            f"'' AS cluster, instance, node, quantile, ts, ROUND(value, 6) AS value FROM ({' UNION ALL '.join(parts)})")


register("r_kubelet", _kubelet_sql())(_records(RC.KUBELET))
def _k8s_sql():
    from .catalog import _irate_sql
    img = "CASE WHEN event_type = 'error' THEN '' ELSE 'img/' || event_type END"
    cad_l = ["job", "metrics_path", "namespace", "pod", "container", "image"]
    cols = (f"'kubelet' AS job, '/metrics/cadvisor' AS metrics_path, 'ns-' || CAST(uid % 5 AS VARCHAR) AS namespace, "
            f"'pod-' || CAST(uid AS VARCHAR) AS pod, event_type AS container, {img} AS image")
    cpu = (f"(SELECT {S.cols(cad_l)}, ts, SUM(inc) OVER (PARTITION BY {S.cols(cad_l)} ORDER BY ts, event_id "
           f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM "
           f"(SELECT {cols}, ts, event_id, value / 100 AS inc FROM {_BASE}))")
    info = f"""(SELECT 'ns-' || CAST(uid % 5 AS VARCHAR) AS namespace, 'pod-' || CAST(uid AS VARCHAR) AS pod,
         'node-' || CAST(uid % 7 AS VARCHAR) AS node, ts, 1.0 AS value FROM {_BASE}
       UNION ALL SELECT 'monitoring', 'node-exporter-' || CAST(uid % 7 AS VARCHAR), 'node-' || CAST(uid % 7 AS VARCHAR),
         ts, 1.0 FROM {_BASE})"""
    ii = S.instant(info, ["namespace", "pod", "node"], _GR, 300_000)
    podnode = (f"(SELECT namespace, pod, node, ts, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY namespace, pod, ts "
               f"ORDER BY value DESC, node) AS rn FROM (SELECT namespace, pod, node, ts, MAX(value) AS value FROM {ii} "
               f"GROUP BY ALL)) WHERE rn = 1)")
    parts = []
    # sum_irate
    ir = f"(SELECT namespace, pod, container, t AS ts, SUM(value) AS value FROM ({_irate_sql(f'(SELECT * FROM {cpu} WHERE image <> {chr(39)}{chr(39)})', cad_l, _GR, 300_000)}) x(job, metrics_path, namespace, pod, container, image, t, value) GROUP BY namespace, pod, container, t)"
    parts.append(("node_namespace_pod_container:container_cpu_usage_seconds_total:sum_irate",
                  f"SELECT c.namespace, c.pod, c.container, p.node, '' AS job, '' AS metrics_path, '' AS image, '' AS resource, "
                  f"'' AS workload, '' AS workload_type, c.ts, c.value * p.value AS value FROM {ir} c JOIN {podnode} p "
                  f"USING (namespace, pod, ts)"))
    for name, scale in (("working_set_bytes", 1e6), ("rss", 8e5), ("cache", 2e5), ("swap", 1e4)):
        g = S.instant(f"(SELECT {cols}, ts, value * {scale} AS value FROM {_BASE} WHERE event_type <> 'error')",
                      cad_l, _GR, 300_000)
        parts.append((f"node_namespace_pod_container:container_memory_{name}",
                      f"SELECT m.namespace, m.pod, m.container, p.node, m.job, m.metrics_path, m.image, '', '', '', m.ts, "
                      f"m.value * p.value FROM {g} m JOIN {podnode} p USING (namespace, pod, ts)"))
    phase = ("CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.PHASES.items()) + " END")
    ph = S.instant(f"(SELECT 'ns-' || CAST(uid % 5 AS VARCHAR) AS namespace, 'pod-' || CAST(uid AS VARCHAR) AS pod, "
                   f"{phase} AS phase, ts, 1.0 AS value FROM {_BASE})", ["namespace", "pod", "phase"], _GR, 300_000)
    active = (f"(SELECT namespace, pod, ts, MAX(value) AS value FROM {ph} WHERE regexp_full_match(phase, 'Pending|Running') "
              f"AND value = 1 GROUP BY ALL)")
    for kind, mult in (("requests", 1.0), ("limits", 2.0)):
        for res, expr in (("memory", f"ROUND(value * 5e5 * {mult})"), ("cpu", f"value / 200 * {mult}")):
            g = S.instant(f"(SELECT 'kube-state-metrics' AS job, 'ns-' || CAST(uid % 5 AS VARCHAR) AS namespace, "
                          f"'pod-' || CAST(uid AS VARCHAR) AS pod, event_type AS container, '{res}' AS resource, ts, "
                          f"{expr} AS value FROM {_BASE})", ["job", "namespace", "pod", "container", "resource"],
                          _GR, 300_000)
            parts.append((f"cluster:namespace:pod_{res}:active:kube_pod_container_resource_{kind}",
                          f"SELECT g.namespace, g.pod, g.container, '', g.job, '', '', g.resource, '', '', g.ts, "
                          f"g.value * a.value FROM {g} g JOIN {active} a USING (namespace, pod, ts)"))
            mx = f"(SELECT namespace, pod, container, ts, MAX(value) AS value FROM {g} GROUP BY ALL)"
            j = f"(SELECT m.namespace, m.pod, m.ts, m.value * a.value AS value FROM {mx} m JOIN {active} a USING (namespace, pod, ts))"
            sm = f"(SELECT namespace, ts, SUM(v) AS value FROM (SELECT namespace, pod, ts, SUM(value) AS v FROM {j} GROUP BY ALL) GROUP BY ALL)"
            parts.append((f"namespace_{res}:kube_pod_container_resource_{kind}:sum",
                          f"SELECT namespace, '', '', '', '', '', '', '', '', '', ts, value FROM {sm}"))
    kinds = "CASE uid % 4 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(K.OWNER_KINDS)) + " END"
    own = S.instant(f"(SELECT namespace, pod, owner_kind, lower(owner_kind) || '-' || CAST(uid % 11 AS VARCHAR) AS owner_name, "
                    f"ts, 1.0 AS value FROM (SELECT *, 'ns-' || CAST(uid % 5 AS VARCHAR) AS namespace, "
                    f"'pod-' || CAST(uid AS VARCHAR) AS pod, {kinds} AS owner_kind FROM {_BASE}))",
                    ["namespace", "pod", "owner_kind", "owner_name"], _GR, 300_000)
    rs = S.instant(f"(SELECT 'ns-' || CAST(uid % 5 AS VARCHAR) AS namespace, 'replicaset-' || CAST(uid % 11 AS VARCHAR) "
                   f"AS replicaset, 'deploy-' || CAST(uid % 11 AS VARCHAR) AS owner_name, ts, 1.0 AS value FROM {_BASE} "
                   f"WHERE uid % 4 = 0)", ["namespace", "replicaset", "owner_name"], _GR, 300_000)
    rs1 = (f"(SELECT namespace, replicaset, owner_name, ts, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "
           f"namespace, replicaset, ts ORDER BY value DESC, owner_name) AS rn FROM (SELECT namespace, replicaset, owner_name, "
           f"ts, MAX(value) AS value FROM {rs} GROUP BY ALL)) WHERE rn = 1)")
    dep = (f"(SELECT o.namespace, r.owner_name AS workload, o.pod, o.ts, MAX(o.value * r.value) AS value FROM {own} o "
           f"JOIN {rs1} r ON o.owner_name = r.replicaset AND o.namespace = r.namespace AND o.ts = r.ts "
           f"WHERE o.owner_kind = 'ReplicaSet' GROUP BY ALL)")
    parts.append(("namespace_workload_pod:kube_pod_owner:relabel",
                  f"SELECT namespace, pod, '', '', '', '', '', '', workload, 'deployment', ts, value FROM {dep}"))
    for kind in ("DaemonSet", "StatefulSet", "Job"):
        o = (f"(SELECT namespace, owner_name AS workload, pod, ts, MAX(value) AS value FROM {own} "
             f"WHERE owner_kind = '{kind}' GROUP BY ALL)")
        parts.append(("namespace_workload_pod:kube_pod_owner:relabel",
                      f"SELECT namespace, pod, '', '', '', '', '', '', workload, '{kind.lower()}', ts, value FROM {o}"))
    body = " UNION ALL ".join(f"SELECT '{n}' AS __name__, * FROM ({q})" for n, q in parts)
    return ("SELECT __name__, '' AS cluster, namespace, pod, container, node, job, metrics_path, image, resource, "
            f"workload, workload_type, ts, ROUND(value, 6) AS value FROM ({body})")


register("r_k8s", _k8s_sql())(_records(RC.K8S, write=True))


register("r_apiserver_histogram")(_records(RC.APISERVER_HISTOGRAM))
register("r_apiserver_burnrate")(_records(RC.APISERVER_BURNRATE, write=True))


def q_r_apiserver_slos(spark, sf):
    """Multi-window multi-burn-rate SLO alerts that read the records of the burn-rate group."""
    res = run_groups(spark, [RC.APISERVER_SLOS, RC.APISERVER_BURNRATE], K.families(spark, sf), START, END)["kube-apiserver-slos"]
    return res.alerts.select(*res.alert_labels, TS, rnd(F.col(VALUE), 6).alias(VALUE), "state", "active_at")


register("r_apiserver_slos")(q_r_apiserver_slos)


# ---- DuckDB twins of the API-server families and the histogram / burn-rate packs
_VERB = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.VERBS.items()) + " END"
_API_H = f"""(SELECT 'apiserver' AS job, {_VERB} AS verb,
    CASE uid % 3 WHEN 0 THEN 'resource' WHEN 1 THEN 'namespace' ELSE 'cluster' END AS scope,
    CASE WHEN uid % 13 = 0 THEN 'log' ELSE '' END AS subresource, value / 50 AS lat, ts, event_id FROM {_BASE})"""
_API_BL = ["job", "verb", "scope", "subresource", "le"]
_API_CL = ["job", "verb", "scope", "subresource"]
_API_TL = ["job", "verb", "code", "resource"]


def _running(src, labels, inc):
    return (f"(SELECT {S.cols(labels)}, ts, SUM({inc}) OVER (PARTITION BY {S.cols(labels)} ORDER BY ts, event_id "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {src})")


_INF = "'inf'::DOUBLE"
_API_BUCKET = _running(
    f"(SELECT h.*, b.le, b.ub FROM {_API_H} h JOIN (VALUES "
    + ", ".join(f"('{x}', {_INF if x == '+Inf' else x})" for x in K.LE) + ") b(le, ub) ON TRUE)",
    _API_BL, "CASE WHEN lat <= ub THEN 1.0 ELSE 0.0 END")
_API_COUNT = _running(_API_H, _API_CL, "1.0")
_API_TOTAL = _running(
    f"(SELECT 'apiserver' AS job, {_VERB} AS verb, CASE uid % 10 WHEN 0 THEN '500' WHEN 1 THEN '404' ELSE '200' END AS code, "
    f"CASE WHEN uid % 2 = 0 THEN 'pods' ELSE 'nodes' END AS resource, ts, event_id FROM {_BASE})", _API_TL, "1.0")
_NOT_STREAMING = "NOT regexp_full_match(subresource, 'proxy|attach|log|exec|portforward')"


def _apiserver_histogram_sql():
    from .catalog import hq_sql
    g3 = Grid.range(START, END, "3m")
    parts = []
    for verbs, tag in (("LIST|GET", "read"), ("POST|PUT|PATCH|DELETE", "write")):
        src = f"(SELECT * FROM {_API_BUCKET} WHERE regexp_full_match(verb, '{verbs}') AND {_NOT_STREAMING})"
        s = f"(SELECT '' AS resource, le, ts, value FROM {S.agg(S.extrapolated(src, _API_BL, g3, 300_000), 'sum', ['le'])})"
        parts.append(f"SELECT '{tag}' AS verb, ts, value FROM {hq_sql(s, ['resource'], 0.99)} WHERE value > 0")
    return ("SELECT 'cluster_quantile:apiserver_request_slo_duration_seconds:histogram_quantile' AS __name__, "
            "'' AS cluster, '' AS resource, '0.99' AS quantile, verb, ts, ROUND(value, 6) AS value FROM ("
            + " UNION ALL ".join(parts) + ")")


def _apiserver_burnrate_sql():
    from ..frame import duration_ms
    parts = []
    for read, verbs in ((True, "LIST|GET"), (False, "POST|PUT|PATCH|DELETE")):
        for w in RC.BURN_WINDOWS:
            wm = duration_ms(w)
            vf = f"regexp_full_match(verb, '{verbs}')"

            def srate(src, labels, cond):
                return S.agg(S.extrapolated(f"(SELECT * FROM {src} WHERE {vf} AND {cond})", labels, _GR, wm), "sum", [])
            count = srate(_API_COUNT, _API_CL, _NOT_STREAMING)
            if read:
                le1 = srate(_API_BUCKET, _API_BL, f"le = '1' AND regexp_full_match(scope, 'resource|') AND {_NOT_STREAMING}")
                le1 = f"(SELECT * FROM {le1} UNION ALL SELECT g.ts, 0.0 FROM {S.grid(_GR)} g WHERE g.ts NOT IN (SELECT ts FROM {le1}))"
                ns5 = srate(_API_BUCKET, _API_BL, f"scope = 'namespace' AND le = '5' AND {_NOT_STREAMING}")
                cl30 = srate(_API_BUCKET, _API_BL, f"scope = 'cluster' AND le = '30' AND {_NOT_STREAMING}")
                fast = (f"(SELECT a.ts, (a.value + b.value) + c.value AS value FROM {le1} a JOIN {ns5} b USING (ts) "
                        f"JOIN {cl30} c USING (ts))")
            else:
                fast = srate(_API_BUCKET, _API_BL, f"le = '1' AND {_NOT_STREAMING}")
            errors = srate(_API_TOTAL, _API_TL, "regexp_full_match(code, '5..')")
            total = srate(_API_TOTAL, _API_TL, "TRUE")
            parts.append(
                f"SELECT 'apiserver_request:burnrate{w}' AS __name__, '{'read' if read else 'write'}' AS verb, c.ts, "
                f"((c.value - f.value) + e.value) / t.value AS value FROM {count} c JOIN {fast} f USING (ts) "
                f"JOIN {errors} e USING (ts) JOIN {total} t USING (ts)")
    return ("SELECT __name__, '' AS cluster, verb, ts, ROUND(value, 6) AS value FROM ("
            + " UNION ALL ".join(parts) + ")")


SQL["r_apiserver_histogram"] = _apiserver_histogram_sql()
SQL["r_apiserver_burnrate"] = _apiserver_burnrate_sql()


def _apiserver_slos_sql():
    burn = _apiserver_burnrate_sql().replace("ROUND(value, 6) AS value", "value")
    rules = [("1h", "5m", 14.4, 120_000, "critical"), ("6h", "30m", 6.0, 900_000, "critical"),
             ("1d", "2h", 3.0, 3_600_000, "warning"), ("3d", "6h", 1.0, 10_800_000, "warning")]
    sums = f"(SELECT __name__, ts, SUM(value) AS value FROM ({burn}) GROUP BY __name__, ts)"
    parts = []
    for lw, sw, f, for_ms, sev in rules:
        thr = f * 0.01
        parts.append(
            f"SELECT 'KubeAPIErrorBudgetBurn' AS alertname, '{lw}' AS long, '{sev}' AS severity, '{sw}' AS short, "
            f"{for_ms} AS for_ms, l.ts, l.value FROM {sums} l JOIN {sums} s ON l.ts = s.ts "
            f"WHERE l.__name__ = 'apiserver_request:burnrate{lw}' AND s.__name__ = 'apiserver_request:burnrate{sw}' "
            f"AND l.value > {thr} AND s.value > {thr}")
    ids = "alertname, long, severity, short"
    return f"""WITH a AS ({" UNION ALL ".join(parts)}),
k AS (SELECT *, (ts - {_GR.start}) // {_GR.step} AS k FROM a),
r AS (SELECT *, CASE WHEN LAG(k) OVER (PARTITION BY {ids} ORDER BY k) = k - 1 THEN 0 ELSE 1 END AS nr FROM k),
i AS (SELECT *, SUM(nr) OVER (PARTITION BY {ids} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM r)
SELECT {ids}, ts, ROUND(value, 6) AS value,
  CASE WHEN ts - MIN(ts) OVER (PARTITION BY {ids}, isl) >= for_ms THEN 'firing' ELSE 'pending' END AS state,
  MIN(ts) OVER (PARTITION BY {ids}, isl) AS active_at FROM i"""


SQL["r_apiserver_slos"] = _apiserver_slos_sql()


def _components_down_sql():
    parts = [f"SELECT '{a}' AS alertname, '{j}' AS job, 'critical' AS severity, g.ts, 1.0 AS value FROM {_GRID} g "
             f"WHERE g.ts NOT IN (SELECT ts FROM {_UP_I} WHERE job = '{j}' AND value = 1)"
             for a, j in (("KubeProxyDown", "kube-proxy"), ("KubeControllerManagerDown", "kube-controller-manager"),
                          ("KubeSchedulerDown", "kube-scheduler"))]
    ids = "alertname, job, severity"
    return f"""WITH a AS ({" UNION ALL ".join(parts)}),
k AS (SELECT *, (ts - {_GR.start}) // {_GR.step} AS k FROM a),
r AS (SELECT *, CASE WHEN LAG(k) OVER (PARTITION BY {ids} ORDER BY k) = k - 1 THEN 0 ELSE 1 END AS nr FROM k),
i AS (SELECT *, SUM(nr) OVER (PARTITION BY {ids} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM r)
SELECT {ids}, ts, value,
  CASE WHEN ts - MIN(ts) OVER (PARTITION BY {ids}, isl) >= 900000 THEN 'firing' ELSE 'pending' END AS state,
  MIN(ts) OVER (PARTITION BY {ids}, isl) AS active_at FROM i"""


register("r_system_components_down", _components_down_sql())(_alerts(RC.SYSTEM_COMPONENTS))


def _node_network_sql():
    from .catalog import _changes_sql
    up = (f"(SELECT 'node-exporter' AS job, 'node-' || CAST(uid % 7 AS VARCHAR) || ':9100' AS instance, "
          f"CASE WHEN uid % 4 = 3 THEN 'veth' || CAST(uid % 5 AS VARCHAR) ELSE 'eth' || CAST(uid % 2 AS VARCHAR) END "
          f"AS device, ts, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS value FROM {_BASE})")
    src = f"(SELECT * FROM {up} WHERE NOT regexp_full_match(device, 'veth.+'))"
    ch = _changes_sql(src, ["job", "instance", "device"], _GR, 120_000)
    ids = "alertname, job, instance, device, severity"
    return f"""WITH a AS (SELECT 'NodeNetworkInterfaceFlapping' AS alertname, job, instance, device, 'warning' AS severity,
                        ts, value FROM {ch} WHERE value > 2),
k AS (SELECT *, (ts - {_GR.start}) // {_GR.step} AS k FROM a),
r AS (SELECT *, CASE WHEN LAG(k) OVER (PARTITION BY {ids} ORDER BY k) = k - 1 THEN 0 ELSE 1 END AS nr FROM k),
i AS (SELECT *, SUM(nr) OVER (PARTITION BY {ids} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM r)
SELECT {ids}, ts, ROUND(value, 6) AS value,
  CASE WHEN ts - MIN(ts) OVER (PARTITION BY {ids}, isl) >= 120000 THEN 'firing' ELSE 'pending' END AS state,
  MIN(ts) OVER (PARTITION BY {ids}, isl) AS active_at FROM i"""


register("r_node_network", _node_network_sql())(_alerts(RC.NODE_NETWORK))


def _config_reloaders_sql():
    from .catalog import _over_time_sql
    ok = (f"(SELECT 'config-reloader' AS job, 'ns-' || CAST(uid % 5 AS VARCHAR) AS namespace, "
          f"'pod-' || CAST(uid AS VARCHAR) AS pod, ts, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS value "
          f"FROM {_BASE})")
    mx = _over_time_sql(f"(SELECT * FROM {ok} WHERE regexp_full_match(namespace, '.+'))", ["job", "namespace", "pod"],
                        _GR, 300_000, "MAX(value)")
    ids = "alertname, job, namespace, pod, severity"
    return f"""WITH a AS (SELECT 'ConfigReloaderSidecarErrors' AS alertname, job, namespace, pod, 'warning' AS severity,
                        ts, value FROM {mx} WHERE value = 0),
k AS (SELECT *, (ts - {_GR.start}) // {_GR.step} AS k FROM a),
r AS (SELECT *, CASE WHEN LAG(k) OVER (PARTITION BY {ids} ORDER BY k) = k - 1 THEN 0 ELSE 1 END AS nr FROM k),
i AS (SELECT *, SUM(nr) OVER (PARTITION BY {ids} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM r)
SELECT {ids}, ts, ROUND(value, 6) AS value,
  CASE WHEN ts - MIN(ts) OVER (PARTITION BY {ids}, isl) >= 600000 THEN 'firing' ELSE 'pending' END AS state,
  MIN(ts) OVER (PARTITION BY {ids}, isl) AS active_at FROM i"""


register("r_config_reloaders", _config_reloaders_sql())(_alerts(RC.CONFIG_RELOADERS))
