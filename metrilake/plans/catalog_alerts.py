"""Registered queries for alerting."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import api as A
from ..frame import TS, VALUE, MetricFrame
from ..operators import alerts as AL
from ..sources import tables as T
from . import configs as C
from . import sqlgen as S
from .catalog import G6H, out

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


NL = ["namespace", "user_id", "event_type"]
AL_LABELS = ["alertname"] + NL + ["severity"]
THRESHOLDS = (("critical", 400), ("warning", 250), ("info", 100))


def value_alerts(spark, sf) -> MetricFrame:
    """``Value`` alert at three severities: gauge above 400 / 250 / 100."""
    g = A.instant(T.m_gauge_ns(spark, sf), G6H, "1d")
    parts = [AL.alert(A.where_value(g, ">", thr), "Value", {"severity": sev}) for sev, thr in THRESHOLDS]
    d = parts[0].df
    for p in parts[1:]:
        d = d.unionByName(p.df)
    return MetricFrame(d, parts[0].labels)


_IG = S.instant(S.view("m_gauge_ns"), NL, G6H, 86_400_000)
_ALERTS_SQL = " UNION ALL ".join(
    f"SELECT 'Value' AS alertname, namespace, user_id, event_type, '{sev}' AS severity, ts, value FROM {_IG} "
    f"WHERE value > {thr}" for sev, thr in THRESHOLDS)


def _held_sql(for_ms):
    ids = ", ".join(AL_LABELS)
    return f"""(WITH a AS ({_ALERTS_SQL}),
k AS (SELECT *, (ts - {G6H.start}) // {G6H.step} AS k FROM a),
r AS (SELECT *, CASE WHEN LAG(k) OVER (PARTITION BY {ids} ORDER BY k) = k - 1 THEN 0 ELSE 1 END AS nr FROM k),
i AS (SELECT *, SUM(nr) OVER (PARTITION BY {ids} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM r)
SELECT {ids}, ts, value, MIN(ts) OVER (PARTITION BY {ids}, isl) AS active_at,
  CASE WHEN ts - MIN(ts) OVER (PARTITION BY {ids}, isl) >= {for_ms} THEN 'firing' ELSE 'pending' END AS state FROM i)"""


HELD = _held_sql(43_200_000)


def held_alerts(spark, sf):
    return AL.hold(value_alerts(spark, sf), "12h", G6H)


@register("e2_hold_for", f"SELECT * FROM {HELD}")
def q_e2_hold_for(spark, sf):
    """Threshold alerts (E1) held for 12h: pending → firing after an unbroken run."""
    return held_alerts(spark, sf)


@register("e3_alerts_series", f"""
SELECT 'ALERTS' AS __name__, alertname, severity, state AS alertstate, ts, CAST(COUNT(*) AS DOUBLE) AS value
FROM {HELD} GROUP BY ALL""")
def q_e3_alerts_series(spark, sf):
    """``count by (alertname, severity, alertstate) (ALERTS)``."""
    s = AL.alerts_series(held_alerts(spark, sf), AL_LABELS)
    c = A.aggregate(s, "count", by=["alertname", "severity", "alertstate"])
    return c.df.select(F.lit("ALERTS").alias("__name__"), *c.labels, TS, VALUE)


def _inhibit_sql():
    h = HELD
    return f"""(SELECT * FROM {h} t WHERE NOT (
  (t.severity IN ('warning', 'info') AND EXISTS (SELECT 1 FROM {h} s WHERE s.state = 'firing' AND s.severity = 'critical'
     AND s.namespace = t.namespace AND s.alertname = t.alertname AND s.ts = t.ts))
  OR (t.severity = 'info' AND EXISTS (SELECT 1 FROM {h} s WHERE s.state = 'firing' AND s.severity = 'warning'
     AND s.namespace = t.namespace AND s.alertname = t.alertname AND s.ts = t.ts))))"""


@register("e6_inhibit", f"SELECT * FROM {_inhibit_sql()}")
def q_e6_inhibit(spark, sf):
    """Inhibition with the deployment's three rules."""
    return AL.inhibit(held_alerts(spark, sf), C.INHIBIT_RULES, AL_LABELS)


def _group_sql(slot: int, repeat: int) -> str:
    return f"""
WITH f AS (SELECT 'null' AS receiver, 'namespace=' || namespace AS group_key, ts // {slot} AS slot,
                  alertname, namespace, user_id, event_type, severity FROM {HELD} WHERE state = 'firing'),
g AS (SELECT receiver, group_key, slot, COUNT(DISTINCT (alertname, namespace, user_id, event_type, severity)) AS alerts,
             list_sort(list(DISTINCT (alertname, namespace, user_id, event_type, severity))) AS dig FROM f GROUP BY ALL),
l AS (SELECT *, LAG(slot) OVER w AS ps, LAG(dig) OVER w AS pd FROM g WINDOW w AS (PARTITION BY receiver, group_key ORDER BY slot)),
c AS (SELECT *, (ps IS NULL OR ps <> slot - 1) AS new_run, (ps IS NULL OR ps <> slot - 1 OR pd <> dig) AS changed FROM l),
m AS (SELECT *, MAX(CASE WHEN changed THEN slot END) OVER (PARTITION BY receiver, group_key ORDER BY slot
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lc FROM c)
SELECT receiver, group_key, slot * {slot} + CASE WHEN new_run THEN 30000 ELSE 0 END AS notify_ts, alerts,
       CASE WHEN changed THEN 'update' ELSE 'repeat' END AS kind
FROM m WHERE changed OR ((slot - lc) * {slot} > 0 AND ((slot - lc) * {slot}) % {repeat} = 0)"""


@register("e7_e8_route_group", _group_sql(21_600_000, 86_400_000))
def q_e7_e8_route_group(spark, sf):
    """Route tree (E7) then notification grouping by namespace."""
    r = AL.route(held_alerts(spark, sf), C.ROUTE)
    return AL.group_notifications(r, AL_LABELS, "6h", "1d", C.ROUTE["group_wait"])


@register("e8_group_daily", _group_sql(86_400_000, 172_800_000))
def q_e8_group_daily(spark, sf):
    """Daily groups over 6-hourly evaluations: an instance seen several times in a slot counts once."""
    return AL.group_notifications(AL.route(held_alerts(spark, sf), C.ROUTE), AL_LABELS, "1d", "2d", C.ROUTE["group_wait"])


@register("e9_resolve", f"""
WITH f AS (SELECT * FROM {HELD} WHERE state = 'firing'),
n AS (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY {", ".join(AL_LABELS)} ORDER BY ts) <= 43200000 THEN 0 ELSE 1 END AS nw FROM f),
i AS (SELECT *, SUM(nw) OVER (PARTITION BY {", ".join(AL_LABELS)} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inc FROM n)
SELECT {", ".join(AL_LABELS)}, MIN(ts) AS starts_at, MAX(ts) + 43200000 AS ends_at, COUNT(*) AS evaluations
FROM i GROUP BY {", ".join(AL_LABELS)}, inc""")
def q_e9_resolve(spark, sf):
    """Incidents: resolved after 12h without a firing evaluation."""
    return AL.resolve(held_alerts(spark, sf), AL_LABELS, "12h")


@register("e10_mute", f"""
SELECT * FROM {HELD} WHERE NOT (isodow(make_timestamp(ts * 1000)) IN (6, 7)
  OR (hour(make_timestamp(ts * 1000)) * 60 + minute(make_timestamp(ts * 1000)) < 360))""")
def q_e10_mute(spark, sf):
    """Mute weekends and 00:00–06:00 UTC."""
    return AL.mute(held_alerts(spark, sf), [{"weekdays": [5, 6]}, {"times": [("00:00", "06:00")]}])


_SHIFT = 32 * 86_400_000      # January's alerts, moved into the leap February and the first days of March


@register("e10_mute_calendar", f"""
WITH h AS (SELECT * REPLACE (ts + {_SHIFT} AS ts, active_at + {_SHIFT} AS active_at) FROM {HELD}), c AS (SELECT *, make_timestamp(ts * 1000) AS t FROM h)
SELECT * EXCLUDE (t) FROM c WHERE NOT (
  (CAST(t AS DATE) IN (DATE '2024-02-28', DATE '2024-02-29')) OR (day(t) BETWEEN 1 AND 3 AND isodow(t) <= 5)
  OR (month(t) = 2 AND day(t) BETWEEN 10 AND 20 AND (hour(t) < 8 OR hour(t) >= 20)))""")
def q_e10_mute_calendar(spark, sf):
    """Mute the last two days of a leap February, the first three days of any month if they are working days, and nights
    between its 10th and its tenth day from the end (E10)."""
    h = held_alerts(spark, sf).withColumns({TS: F.col(TS) + F.lit(_SHIFT), "active_at": F.col("active_at") + F.lit(_SHIFT)})
    return AL.mute(h, [{"days_of_month": [(-2, -1)], "months": [2], "years": [(2024, 2025)]}, {"days_of_month": [(1, 3)], "weekdays": [(0, 4)]},
                       {"days_of_month": [(10, -10)], "months": [(2, 2)], "times": [("00:00", "08:00"), ("20:00", "24:00")]}])


@register("e11_watchdog", S.final(
    f"(SELECT 'Watchdog' AS alertname, 'none' AS severity, g.ts, 1.0 AS value FROM {S.grid(G6H)} g "
    f"WHERE EXISTS (SELECT 1 FROM events))", ["alertname", "severity"]))
def q_e11_watchdog(spark, sf):
    """Dead-man switch, gated on the events table being readable."""
    ev = A.aggregate(A.instant(T.m_counter(spark, sf), G6H, "30d"), "count")
    return out(A.set_and(AL.watchdog(spark, G6H), ev, on=[]))


def _burn_sql():
    lng = S.extrapolated(S.view("m_counter"), ["event_type"], G6H, 172_800_000)
    sht = S.extrapolated(S.view("m_counter"), ["event_type"], G6H, 21_600_000)
    return (f"SELECT 'ValueBurn' AS alertname, l.event_type, 'warning' AS severity, l.ts, ROUND(l.value, 6) AS value "
            f"FROM {lng} l WHERE l.value > 0.02 AND EXISTS (SELECT 1 FROM {sht} s WHERE s.event_type = l.event_type "
            f"AND s.ts = l.ts AND s.value > 0.02)")


@register("e4_burn_rate", _burn_sql())
def q_e4_burn_rate(spark, sf):
    """Multi-window burn rate: rate[2d] and rate[6h] both above 2 × 0.01."""
    c = T.m_counter(spark, sf)
    a = AL.burn_rate_alert(A.rate(c, "2d", G6H), A.rate(c, "6h", G6H), 2, 0.01, "ValueBurn", {"severity": "warning"})
    return out(a)


def _availability_sql():
    inc = S.extrapolated(S.view("m_counter"), ["event_type"], G6H, 21_600_000, per_second=False)
    avg = f"(SELECT event_type, t AS ts, AVG(value) AS value FROM (SELECT i.event_type, g.ts AS t, i.value FROM {inc} i " \
          f"JOIN {S.grid(G6H)} g ON i.ts BETWEEN g.ts - 604800000 AND g.ts) GROUP BY event_type, t)"
    return (f"SELECT e.ts, ROUND(1 - e.value / a.value, 6) AS value FROM "
            f"(SELECT ts, SUM(value) * 28 AS value FROM {avg} WHERE event_type = 'error' GROUP BY ts) e JOIN "
            f"(SELECT ts, SUM(value) * 28 AS value FROM {avg} GROUP BY ts) a ON e.ts = a.ts")


@register("e5_availability", _availability_sql())
def q_e5_availability(spark, sf):
    """Error-budget availability from recorded 6h increases averaged over 7d (E5):
    ``1 - sum(increase_err) / sum(increase_all)`` with the ×(7d/6h) scale."""
    inc = A.increase(T.m_counter(spark, sf), "6h", G6H)
    long = A.scalar_op(A.avg_over_time(inc, "7d", G6H), "*", 28)
    err = A.aggregate(A.select(long, eq={"event_type": "error"}), "sum")
    allv = A.aggregate(long, "sum")
    return out(A.scalar_op(A.binop(err, allv, "/"), "-", 1, scalar_left=True))
