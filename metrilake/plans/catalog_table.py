"""Registered queries for dashboard table operators (D*), sorts (O*) and
annotation functions (F*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import api as A
from ..frame import TS, VALUE, Grid, MetricFrame, epoch_ms
from ..functions import humanize as H
from ..operators import table as TB
from ..operators.sort import desc_order, numbered, table_order
from ..sources import exposition
from ..sources import tables as T
from . import fixtures as X
from . import sqlgen as S
from .catalog import SQRT2, rnd, G1D, G6H, out

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


GL = ["event_type", "user_id"]
ET = ["event_type"]
T_MID = "2024-01-15T12:00:00"
GI = Grid.instant(T_MID)
_I6 = S.instant(S.view("m_gauge"), GL, G6H, 86_400_000)
_II = S.instant(S.view("m_gauge"), GL, GI, 86_400_000)


@register("d1_query_range", S.final(S.agg(S.instant(S.view("m_counter_reset"), ET, Grid.range(
    "2024-01-03", "2024-01-20", "4h"), 86_400_000), "sum", []), []))
def q_d1_query_range(spark, sf):
    """Range query over a 4h step grid."""
    c = T.m_counter_reset(spark, sf)
    return out(TB.query_range(lambda g: A.aggregate(A.instant(c, g, "1d"), "sum"), "2024-01-03", "2024-01-20", "4h"))


@register("d2_query_instant", S.final(S.agg(_II, "sum", ET), ET))
def q_d2_query_instant(spark, sf):
    """Instant table query at one time."""
    g = T.m_gauge(spark, sf)
    return out(TB.query_instant(lambda gr: A.aggregate(A.instant(g, gr, "1d"), "sum", by=ET), T_MID))


_SUM = S.agg(_I6, "sum", ET)
_SUM7 = S.agg(f"(SELECT event_type, user_id, ts, value * 1.4142135623730951 AS value FROM {_I6})", "sum", ET)
_CNT = S.agg(_I6, "count", ET)
_MERGED = (f"(SELECT COALESCE(a.event_type, b.event_type) AS event_type, COALESCE(a.ts, b.ts) AS ts, "
           f"a.value AS value_A, b.value AS value_B FROM {_SUM7} a FULL JOIN {_CNT} b "
           f"ON a.event_type = b.event_type AND a.ts = b.ts)")


def merged(spark, sf):
    g = A.instant(T.m_gauge(spark, sf), G6H, "1d")
    g7 = A.scalar_op(g, "*", SQRT2)    # scaled by sqrt(2): the mean never sits on a rounding tie
    return TB.merge({"A": A.aggregate(g7, "sum", by=ET), "B": A.aggregate(g, "count", by=ET)})


@register("d4_d5_merge_calc", f"""
SELECT event_type, ts, ROUND(value_A, 6) AS value_A, value_B, ROUND(value_A / value_B, 6) AS mean FROM {_MERGED}""")
def q_d4_d5_merge_calc(spark, sf):
    """Queries A and B merged on shared labels and time (D4), then a calculated field."""
    d = TB.calc(merged(spark, sf), "mean", "value_A", "/", "value_B")
    return d.select("event_type", TS, rnd("value_A", 6).alias("value_A"), "value_B",
                    rnd("mean", 6).alias("mean"))


@register("d3_d6_group_last_organize", f"""
SELECT event_type AS "Event", ROUND(arg_max(value_A, ts) FILTER (WHERE value_A IS NOT NULL), 6) AS "Total",
       arg_max(value_B, ts) FILTER (WHERE value_B IS NOT NULL) AS "Series"
FROM {_MERGED} GROUP BY event_type""")
def q_d3_d6_group_last_organize(spark, sf):
    """``groupBy`` with lastNotNull (D3), then organize: rename and order."""
    d = TB.group_last(merged(spark, sf).withColumn(TS, F.col(TS)), ["event_type"], ["value_A", "value_B"])
    d = d.withColumn("value_A", rnd("value_A", 6))
    return TB.organize(d, order=["event_type", "value_A", "value_B"],
                       rename={"event_type": "Event", "value_A": "Total", "value_B": "Series"})


@register("d7_labels_to_fields", """
SELECT CASE WHEN user_id % 10 = 0 THEN '' ELSE 'pod-' || CAST(user_id AS VARCHAR) END AS pod,
       '/kubepods/' || CAST(user_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS ts, value FROM events""")
def q_d7_labels_to_fields(spark, sf):
    """Label map entries to table fields."""
    d = exposition.read_exposition(X.exposition_lines(spark, sf))
    return TB.labels_to_fields(d, ["pod", "id"]).select("pod", "id", "ts", "value")


_I6_7 = f"(SELECT event_type, user_id, ts, value * 1.4142135623730951 AS value FROM {_I6})"
for _how, _f in (("avg", "AVG(value)"), ("min", "MIN(value)"), ("max", "MAX(value)"), ("lastNotNull", "arg_max(value, ts)")):
    def _mk(how):
        def q(spark, sf):
            mf = A.scalar_op(A.instant(T.m_gauge(spark, sf), G6H, "1d"), "*", SQRT2)
            d = TB.reduce_series(mf, how)
            return d.select(*GL, rnd(VALUE, 6).alias(VALUE))
        q.__doc__ = f"Single-stat reduce '{how}' of every series over the range (D8)."
        return q
    register(f"d8_reduce_{_how}", f"SELECT event_type, user_id, ROUND({_f}, 6) AS value FROM {_I6_7} GROUP BY ALL")(_mk(_how))


_P5 = S.instant(S.view("m_gauge", "event_type = 'purchase'"), GL, G6H, 43_200_000)
_FULL = (f"(SELECT s.event_type, s.user_id, g.ts FROM (SELECT DISTINCT event_type, user_id FROM {_P5}) s, "
         f"{S.grid(G6H)} g)")


@register("d9_fill_zero", f"""
SELECT f.event_type, f.user_id, f.ts, ROUND(COALESCE(p.value, 0), 6) AS value FROM {_FULL} f
LEFT JOIN {_P5} p ON p.event_type = f.event_type AND p.user_id = f.user_id AND p.ts = f.ts""")
def q_d9_fill_zero(spark, sf):
    """Gap policy 'null as zero' over the grid."""
    mf = A.instant(A.select(T.m_gauge(spark, sf), eq={"event_type": "purchase"}), G6H, "12h")
    return out(TB.fill_gaps(mf, G6H, "zero"))


@register("d9_fill_connected", f"""
SELECT * FROM (SELECT f.event_type, f.user_id, f.ts, ROUND(LAST_VALUE(p.value IGNORE NULLS) OVER (PARTITION BY
  f.event_type, f.user_id ORDER BY f.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value FROM {_FULL} f
LEFT JOIN {_P5} p ON p.event_type = f.event_type AND p.user_id = f.user_id AND p.ts = f.ts) WHERE value IS NOT NULL""")
def q_d9_fill_connected(spark, sf):
    """Gap policy 'connected': carry the last value forward."""
    mf = A.instant(A.select(T.m_gauge(spark, sf), eq={"event_type": "purchase"}), G6H, "12h")
    return out(TB.fill_gaps(mf, G6H, "connected"))


@register("d10_stack", f"""
SELECT event_type, ts, ROUND(SUM(CASE WHEN event_type = 'error' THEN -value ELSE value END) OVER (PARTITION BY ts
  ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value FROM {_SUM}""")
def q_d10_stack(spark, sf):
    """Stacked series with errors drawn negative."""
    s = A.aggregate(A.instant(T.m_gauge(spark, sf), G6H, "1d"), "sum", by=ET)
    return out(TB.stack(s, negative_y="error", on="event_type"))


_NSG = S.instant(S.view("m_gauge_ns"), ["namespace", "user_id", "event_type"], G6H, 86_400_000)


@register("d11_per_value", S.final(S.agg(_NSG, "sum", ["namespace"]), ["namespace"]))
def q_d11_per_value(spark, sf):
    """A panel repeated per namespace as one grouped job."""
    mf = A.instant(T.m_gauge_ns(spark, sf), G6H, "1d")
    return out(TB.per_value(A.aggregate, mf, "sum", [], "namespace"))


@register("d12_chained_values", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM events WHERE 'ns-' || CAST(user_id % 5 AS VARCHAR) = 'ns-1'
  AND event_type IN ('click', 'view')""")
def q_d12_chained_values(spark, sf):
    """User variable that depends on the namespace and event-type variables."""
    return TB.chained_values(T.m_gauge_ns(spark, sf), "user_id", namespace="ns-1", event_type=["click", "view"])


@register("o1_sort_desc", "SELECT event_type, ts, ROUND(value, 6) AS value, row_number() OVER (ORDER BY ts, value DESC, event_type) AS row "
          f"FROM {S.agg(_I6, 'sum', ET)}")
def q_o1_sort_desc(spark, sf):
    """``sort_desc(sum by (event_type) (...))`` (O1)."""
    s = A.aggregate(A.instant(T.m_gauge(spark, sf), G6H, "1d"), "sum", by=ET)
    d = numbered(s.df, desc_order(s))
    return d.select(*ET, TS, rnd(VALUE, 6).alias(VALUE), "row")


@register("o3_table_sort", "SELECT *, row_number() OVER (ORDER BY value DESC, event_type, user_id) AS row FROM "
          f"(SELECT event_type, user_id, ROUND(MAX(value), 6) AS value FROM {_I6} GROUP BY ALL)")
def q_o3_table_sort(spark, sf):
    """Table sorted by a column, descending, then by name (O3)."""
    d = TB.reduce_series(A.instant(T.m_gauge(spark, sf), G6H, "1d"), "max").withColumn(VALUE, rnd(VALUE, 6))
    return numbered(d, table_order([(VALUE, True), ("event_type", False), ("user_id", False)]))


TEMPLATE = ('User {{ $labels.user_id }} ({{ $labels.event_type }}) at {{ $value | humanizePercentage }} '
            'raw {{ printf "%.2f" $value }} si {{ $value | humanize }} for {{ $value | humanizeDuration }} '
            'v={{ $value }}')


def _go_g4(x):
    return f"printf('%.4g', {x})"


_F_SQL = f"""
WITH a AS (SELECT event_type, user_id, ts, value / 7 AS v FROM {_II} WHERE value > 50),
b AS (SELECT *, LEAST(FLOOR(LOG10(ABS(v)) / 3), 8)::INT AS up, LEAST(CEIL(-LOG10(ABS(v)) / 3), 8)::INT AS dn,
             CAST(FLOOR(ABS(v)) AS BIGINT) AS d FROM a)
SELECT event_type, user_id, ts,
  'User ' || user_id || ' (' || event_type || ') at ' || {_go_g4('v * 100')} || '% raw ' || printf('%.2f', v) ||
  ' si ' || CASE WHEN ABS(v) >= 1 THEN {_go_g4('v / POWER(1000, up)')} || ['', 'k', 'M', 'G', 'T', 'P', 'E', 'Z', 'Y'][up + 1]
                 ELSE {_go_g4('v * POWER(1000, dn)')} || ['', 'm', 'u', 'n', 'p', 'f', 'a', 'z', 'y'][dn + 1] END ||
  ' for ' || CASE WHEN ABS(v) >= 1 THEN CASE WHEN d // 86400 <> 0 THEN printf('%dd %dh %dm %ds', d // 86400, (d // 3600) % 24, (d // 60) % 60, d % 60)
       WHEN (d // 3600) % 24 <> 0 THEN printf('%dh %dm %ds', (d // 3600) % 24, (d // 60) % 60, d % 60)
       WHEN (d // 60) % 60 <> 0 THEN printf('%dm %ds', (d // 60) % 60, d % 60) ELSE {_go_g4('v')} || 's' END
       ELSE {_go_g4('v * 1000')} || 'ms' END ||
  ' v=' || CASE WHEN v = FLOOR(v) AND ABS(v) < 1e6 THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE printf('%.15g', v) END
  AS description FROM b"""


@register("f1_render_annotations", _F_SQL)
def q_f1_render_annotations(spark, sf):
    """Alert annotation templates with $labels, $value, printf and the humanize family."""
    mf = A.where_value(A.instant(T.m_gauge(spark, sf), GI, "1d"), ">", 50)
    d = mf.df.withColumn(VALUE, F.col(VALUE) / 7)
    return d.select(*GL, TS, H.render(TEMPLATE).alias("description"))


@register("f5_legend", f"SELECT event_type || ':' || user_id AS series, ts, ROUND(value, 6) AS value FROM {_II}")
def q_f5_legend(spark, sf):
    """Legend format ``{{event_type}}:{{user_id}}`` as the series name."""
    mf = A.instant(T.m_gauge(spark, sf), GI, "1d")
    return mf.df.select(H.legend("{{event_type}}:{{user_id}}").alias("series"), TS, rnd(VALUE, 6).alias(VALUE))
