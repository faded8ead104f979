"""Registered queries: one per operator of the inventory, each paired with an
independent DuckDB SQL text (``sqlgen``) for the correctness gate.

Every query reads the given tables (through the metric views in
``sources.tables``) in full; results are (labels…, ts, value) with values
rounded to 6 digits on both sides.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api as A
from ..frame import TS, VALUE, Grid, MetricFrame, duration_ms
from ..sources import tables as T
from . import sqlgen as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Evaluation grids over the events month (2024-01) and the lineitem years.
G6H = Grid.range("2024-01-02T00:00:00", "2024-01-31T00:00:00", "6h")
G1D = Grid.range("2024-01-02T00:00:00", "2024-01-31T00:00:00", "1d")
GWEEK = Grid.range("1995-01-01T00:00:00", "2001-12-02T00:00:00", "7d")
LB = duration_ms("1d")      # lookback for the sparse event series
D1, D2, D3 = duration_ms("1d"), duration_ms("2d"), duration_ms("3d")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def rnd(c, digits: int = 6):
    """Presentation rounding for the result tables: ``round(x·10^d) / 10^d``
    (the scaled product is rounded, as the SQL side does)."""
    c = F.col(c) if isinstance(c, str) else c
    k = float(10 ** digits)
    return F.round(c * F.lit(k)) / F.lit(k)


def out(mf: MetricFrame, digits: int = 6) -> DataFrame:
    return mf.df.select(*mf.labels, TS, rnd(F.col(VALUE), digits).alias(VALUE))


GL = ["event_type", "user_id"]   # gauge labels
SQRT2 = 1.4142135623730951        # irrational scale: keeps averages off exact decimal rounding ties
ET = ["event_type"]


def _inst(mf, g=G6H, lb="1d"):
    return A.instant(mf, g, lb)


# ---------------------------------------------------------------- range functions
@register("w1_rate_sum_by", S.final(S.agg(S.extrapolated(S.view("m_user_counter"), GL, G6H, D2), "sum", ET), ET))
def q_w1_rate_sum_by(spark, sf):
    """sum by (event_type) (rate(counter[2d])) – the flagship query."""
    return out(A.aggregate(A.rate(T.m_user_counter(spark, sf), "2d", G6H), "sum", by=ET))


@register("w1_rate_resets", S.final(S.extrapolated(S.view("m_counter_reset"), ET, G6H, D1), ET))
def q_w1_rate_resets(spark, sf):
    return out(A.rate(T.m_counter_reset(spark, sf), "1d", G6H))


@register("w3_increase", S.final(S.extrapolated(S.view("m_counter_reset"), ET, G6H, D1, per_second=False), ET))
def q_w3_increase(spark, sf):
    return out(A.increase(T.m_counter_reset(spark, sf), "1d", G6H))


def _irate_sql(src, labels, g, rng):
    lc = S.cols(labels)
    w = S.windowed(src, labels, g, rng, with_prev=True)
    a = (f"(SELECT {lc}, t, arg_max(value, ts) AS lv, MAX(ts) AS lt, arg_max(pv, ts) AS pv, arg_max(pt, ts) AS pt "
         f"FROM {w} GROUP BY {lc}, t)")
    return (f"(SELECT {lc}, t AS ts, (CASE WHEN lv < pv THEN lv ELSE lv - pv END) / ((lt - pt) / 1000.0) AS value "
            f"FROM {a} WHERE pt >= t - {rng} AND lt > pt)")


@register("w2_irate", S.final(_irate_sql(S.view("m_counter_reset"), ET, G6H, D1), ET))
def q_w2_irate(spark, sf):
    return out(A.irate(T.m_counter_reset(spark, sf), "1d", G6H))


def _regr_sql(src, labels, g, rng, expr):
    lc = S.cols(labels)
    w = S.windowed(src, labels, g, rng)
    return (f"(SELECT {lc}, t AS ts, {expr} AS value FROM (SELECT {lc}, t, COUNT(*) AS n, "
            f"REGR_SLOPE(value, (ts - t) / 1000.0) AS slope, REGR_INTERCEPT(value, (ts - t) / 1000.0) AS icpt "
            f"FROM {w} GROUP BY {lc}, t) WHERE n >= 2)")


@register("w4_deriv", S.final(_regr_sql(S.view("m_counter"), ET, G6H, D1, "slope"), ET, 4))
def q_w4_deriv(spark, sf):
    return out(A.deriv(T.m_counter(spark, sf), "1d", G6H), 4)


@register("w5_predict_linear", S.final(_regr_sql(S.view("m_counter"), ET, G6H, D1, "slope * 3600 + icpt"), ET, 2))
def q_w5_predict_linear(spark, sf):
    return out(A.predict_linear(T.m_counter(spark, sf), "1d", G6H, 3600), 2)


def _changes_sql(src, labels, g, rng):
    lc = S.cols(labels)
    w = S.windowed(src, labels, g, rng, with_prev=True)
    return (f"(SELECT {lc}, t AS ts, CAST(SUM(CASE WHEN pt >= t - {rng} AND value <> pv THEN 1 ELSE 0 END) AS DOUBLE) "
            f"AS value FROM {w} GROUP BY {lc}, t)")


@register("w6_changes", S.final(_changes_sql(S.view("m_state"), ["user_id"], G1D, D3), ["user_id"]))
def q_w6_changes(spark, sf):
    return out(A.changes(T.m_state(spark, sf), "3d", G1D))


def _over_time_sql(src, labels, g, rng, f):
    lc = S.cols(labels)
    w = S.windowed(src, labels, g, rng)
    return f"(SELECT {lc}, t AS ts, {f} AS value FROM {w} GROUP BY {lc}, t)"


_G7 = "(SELECT event_type, user_id, ts, value * 1.4142135623730951 AS value FROM " + S.view("m_gauge") + ")"
for _fn, _f in (("avg", "AVG(value)"), ("max", "MAX(value)"), ("min", "MIN(value)"), ("last", "arg_max(value, ts)")):
    def _mk(fn):
        def q(spark, sf):
            g = T.m_gauge(spark, sf)
            if fn == "avg":   # see a_avg_by: keep averages off exact rounding ties
                g = g.with_df(g.df.withColumn(VALUE, F.col(VALUE) * SQRT2))
            return out(A.over_time(g, fn, "1d", G1D))
        return q
    src = _G7 if _fn == "avg" else S.view("m_gauge")
    register(f"w_{_fn}_over_time", S.final(_over_time_sql(src, GL, G1D, D1, _f), GL))(_mk(_fn))


def _subquery_sql():
    # max_over_time(rate(m_counter[1d])[2d:6h]) at daily steps
    inner = A.subquery_grid(G1D, "2d", "6h")
    r = S.extrapolated(S.view("m_counter"), ET, inner, D1)
    return S.final(_over_time_sql(r, ET, G1D, D2, "MAX(value)"), ET)


@register("w11_subquery", _subquery_sql())
def q_w11_subquery(spark, sf):
    c = T.m_counter(spark, sf)
    res = A.subquery(lambda g: A.rate(c, "1d", g), "2d", "6h", G1D, A.max_over_time)
    return out(res)


@register("w13_monotonic", S.final(
    "(SELECT event_type, ts, value + COALESCE(SUM(CASE WHEN value < pv THEN pv ELSE 0 END) OVER "
    "(PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS value "
    "FROM (SELECT *, LAG(value) OVER (PARTITION BY event_type ORDER BY ts) AS pv FROM "
    + S.view("m_counter_reset") + "))", ET, 4))
def q_w13_monotonic(spark, sf):
    return out(A.monotonic(T.m_counter_reset(spark, sf)), 4)


# ---------------------------------------------------------------- selectors
@register("j10_instant", S.final(S.instant(S.view("m_gauge"), GL, G6H, LB), GL))
def q_j10_instant(spark, sf):
    return out(_inst(T.m_gauge(spark, sf)))


@register("p1_select_eq", S.final(S.instant(S.view("m_gauge", "event_type = 'purchase' AND user_id <> '7'"),
                                            GL, G1D, LB), GL))
def q_p1_select_eq(spark, sf):
    mf = A.select(T.m_gauge(spark, sf), eq={"event_type": "purchase"}, ne={"user_id": "7"})
    return out(_inst(mf, G1D))


@register("p2_select_re", S.final(S.instant(S.view(
    "m_gauge", "regexp_full_match(event_type, 'click|vi.*') AND NOT regexp_full_match(user_id, '1.*')"),
    GL, G1D, LB), GL))
def q_p2_select_re(spark, sf):
    mf = A.select(T.m_gauge(spark, sf), re={"event_type": "click|vi.*"}, nre={"user_id": "1.*"})
    return out(_inst(mf, G1D))


@register("p2_select_empty_match", S.final(S.instant(S.view(
    "m_gauge", "regexp_full_match(COALESCE('', ''), 'x|')"), GL, G1D, LB), GL))
def q_p2_select_empty_match(spark, sf):
    """``cluster=~"x|"`` on a label the series lack: absent ≡ "" matches."""
    mf = A.select(T.m_gauge(spark, sf), re={"cluster": "x|"})
    return out(_inst(mf.with_df(mf.df.drop("cluster"), GL), G1D))


_IG = S.instant(S.view("m_gauge"), GL, G1D, LB)


@register("p4_arith", S.final(f"(SELECT event_type, user_id, ts, POWER(2, value / 100) * 8 - 1 AS value FROM {_IG})", GL))
def q_p4_arith(spark, sf):
    mf = _inst(T.m_gauge(spark, sf), G1D)
    return out(A.scalar_op(A.scalar_op(A.binop(2, A.scalar_op(mf, "/", 100), "^"), "*", 8), "-", 1))


@register("p5_compare", S.final(f"(SELECT * FROM {_IG} WHERE value > 100)", GL))
def q_p5_compare(spark, sf):
    return out(A.where_value(_inst(T.m_gauge(spark, sf), G1D), ">", 100))


@register("p6_chain", S.final(f"(SELECT * FROM {_IG} WHERE value > 50 AND value < 200)", GL))
def q_p6_chain(spark, sf):
    return out(A.where_value(A.where_value(_inst(T.m_gauge(spark, sf), G1D), ">", 50), "<", 200))


_IS = S.instant(S.view("m_state"), ["user_id"], G1D, LB)


@register("p7_bool", S.final(f"(SELECT user_id, ts, CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END AS value FROM {_IS})",
                             ["user_id"]))
def q_p7_bool(spark, sf):
    return out(A.compare_bool(_inst(T.m_state(spark, sf), G1D), "==", 0))


@register("p9_label_replace", S.final(
    f"(SELECT event_type, user_id, CASE WHEN regexp_full_match(event_type, '(c|v)(.*)') "
    f"THEN regexp_replace(event_type, '^(c|v)(.*)$', '\\2-\\1') ELSE '' END AS kind, ts, value FROM {_IG})",
    GL + ["kind"]))
def q_p9_label_replace(spark, sf):
    return out(A.label_replace(_inst(T.m_gauge(spark, sf), G1D), "kind", "$2-$1", "event_type", "(c|v)(.*)"))


@register("p10_time", S.final(f"(SELECT event_type, ts, ts / 1000.0 - value AS value FROM "
                              f"{S.instant(S.view('m_counter'), ET, G6H, LB)})", ET, 3))
def q_p10_time(spark, sf):
    mf = _inst(T.m_counter(spark, sf))
    return out(A.binop(A.time_(spark, G6H), mf, "-"), 3)


@register("p11_vector", S.final(f"(SELECT ts, 1.0 AS value FROM {S.grid(G6H)})", []))
def q_p11_vector(spark, sf):
    # vector(1) or the events' absence: the grid comes from the session, the
    # join to events keeps it data-driven: ``vector(1) and on() count(events)``
    ev = _inst(T.m_counter(spark, sf), G6H, "30d")
    return out(A.set_and(A.vector(spark, G6H, 1), A.aggregate(ev, "count"), on=[]))


_PC = S.instant(S.view('m_counter', "event_type = 'purchase'"), ET, G1D, LB)


@register("p12_scalar", S.final(
    f"(SELECT i.event_type, i.user_id, i.ts, i.value / s.value AS value FROM {_IG} i JOIN "
    f"(SELECT ts, CASE WHEN COUNT(*) = 1 THEN MAX(value) ELSE 'nan'::DOUBLE END AS value FROM "
    f"{_PC} GROUP BY ts) s ON i.ts = s.ts "
    f"WHERE i.event_type = 'purchase')", GL, 9))
def q_p12_scalar(spark, sf):
    g = _inst(A.select(T.m_gauge(spark, sf), eq={"event_type": "purchase"}), G1D)
    c = _inst(A.select(T.m_counter(spark, sf), eq={"event_type": "purchase"}), G1D)
    return out(A.binop(g, A.scalar(c, G1D), "/"), 9)


@register("p13_clamp_min", S.final(f"(SELECT event_type, user_id, ts, GREATEST(value - 100, 0) AS value FROM {_IG})", GL))
def q_p13_clamp_min(spark, sf):
    return out(A.clamp_min(A.scalar_op(_inst(T.m_gauge(spark, sf), G1D), "-", 100), 0))


@register("p14_ceil", S.final(f"(SELECT event_type, user_id, ts, CAST(CEIL(value) AS DOUBLE) AS value FROM {_IG})", GL))
def q_p14_ceil(spark, sf):
    return out(A.ceil(_inst(T.m_gauge(spark, sf), G1D)))


# ---------------------------------------------------------------- aggregations
_I6 = S.instant(S.view("m_gauge"), GL, G6H, LB)
_I6_7 = f"(SELECT event_type, user_id, ts, value * 1.4142135623730951 AS value FROM {_I6})"
for _op in ("sum", "avg", "min", "max", "count", "stdvar"):
    # averages of 2-decimal values can sit exactly on a rounding tie; an irrational scale avoids that
    def _mk(op):
        def q(spark, sf):
            g = _inst(T.m_gauge(spark, sf))
            return out(A.aggregate(A.scalar_op(g, "*", SQRT2) if op == "avg" else g, op, by=ET))
        return q
    register(f"a_{_op}_by", S.final(S.agg(_I6_7 if _op == "avg" else _I6, _op, ET), ET))(_mk(_op))


@register("a1_sum_without", S.final(S.agg(_I6, "sum", ["user_id"]), ["user_id"]))
def q_a1_sum_without(spark, sf):
    return out(A.aggregate(_inst(T.m_gauge(spark, sf)), "sum", without=["event_type"]))


@register("a1_sum_global", S.final(S.agg(_I6, "sum", []), []))
def q_a1_sum_global(spark, sf):
    return out(A.aggregate(_inst(T.m_gauge(spark, sf)), "sum"))


@register("a7_count_values", S.final(
    f"(SELECT CAST(CAST(value AS BIGINT) AS VARCHAR) AS state, ts, CAST(COUNT(*) AS DOUBLE) AS value FROM {_IS} "
    f"GROUP BY 1, ts)", ["state"]))
def q_a7_count_values(spark, sf):
    return out(A.count_values(_inst(T.m_state(spark, sf), G1D), "state"))


def _topk_sql(k):
    return S.final(f"(SELECT event_type, user_id, ts, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY "
                   f"event_type, ts ORDER BY value DESC, event_type, user_id) AS rn FROM {_I6}) WHERE rn <= {k})", GL)


@register("a8_topk3", _topk_sql(3))
def q_a8_topk3(spark, sf):
    return out(A.topk(_inst(T.m_gauge(spark, sf)), 3, by=ET))


@register("a8_topk1", _topk_sql(1))
def q_a8_topk1(spark, sf):
    return out(A.topk(_inst(T.m_gauge(spark, sf)), 1, by=ET))


@register("a10_nested_count", S.final(S.agg(S.agg(_I6, "sum", GL), "count", ET), ET))
def q_a10_nested_count(spark, sf):
    inner = A.aggregate(_inst(T.m_gauge(spark, sf)), "sum", by=GL)
    return out(A.aggregate(inner, "count", by=ET))


HL = ["l_returnflag", "l_linestatus"]


def hq_sql(src: str, labels, q) -> str:
    """``histogram_quantile(q, src)`` in SQL; ``src`` has ``labels…, le, ts, value``.
    Returns ``(labels…, ts, value)`` (unrounded)."""
    L = list(labels)
    lc, part = S.cols(L), ", ".join(["ts"] + L)
    eq = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in L + ["ts"])
    # buckets with bounds; duplicate bounds merged; counts made monotone
    b = (f"(SELECT {lc}, ts, CASE WHEN le = '+Inf' THEN 'inf'::DOUBLE ELSE CAST(le AS DOUBLE) END AS ub, "
         f"SUM(value) AS c FROM {src} GROUP BY ALL)")
    m = (f"(SELECT *, MAX(c) OVER (PARTITION BY {part} ORDER BY ub ROWS BETWEEN UNBOUNDED PRECEDING "
         f"AND CURRENT ROW) AS mc, ROW_NUMBER() OVER (PARTITION BY {part} ORDER BY ub) AS i, "
         f"COUNT(*) OVER (PARTITION BY {part}) AS nb, MAX(ub) OVER (PARTITION BY {part}) AS top "
         f"FROM {b})")
    tot = f"(SELECT {lc}, ts, MAX(mc) AS total FROM {m} GROUP BY ALL)"
    j = (f"(SELECT m.*, t.total, {q} * t.total AS rank, LAG(m.ub) OVER w AS pub, LAG(m.mc) OVER w AS pmc "
         f"FROM {m} m JOIN {tot} t USING ({lc}, ts) "
         f"WINDOW w AS (PARTITION BY {', '.join('m.' + x for x in L + ['ts'])} ORDER BY m.ub))")
    pick = (f"(SELECT {lc}, ts, arg_min(i, i) FILTER (WHERE mc >= rank AND i < nb) AS bi, "
            f"MAX(nb) AS nb, MAX(total) AS total, MAX(top) AS top, MAX(rank) AS rank FROM {j} GROUP BY ALL)")
    return (f"(SELECT {', '.join('p.' + x for x in L)}, p.ts, CASE WHEN p.top <> 'inf'::DOUBLE OR p.nb < 2 "
            f"OR p.total = 0 THEN 'nan'::DOUBLE "
            f"WHEN p.bi IS NULL THEN (SELECT ub FROM {j} x WHERE {eq('x', 'p')} AND x.i = p.nb - 1) "
            f"ELSE (SELECT CASE WHEN x.i = 1 AND x.ub <= 0 THEN x.ub ELSE COALESCE(x.pub, 0) + (x.ub - COALESCE(x.pub, 0)) "
            f"* ((p.rank - COALESCE(x.pmc, 0)) / (x.mc - COALESCE(x.pmc, 0))) END FROM {j} x WHERE "
            f"{eq('x', 'p')} AND x.i = p.bi) END AS value FROM {pick} p)")


def _hq_sql(q):
    inst = S.instant(S.view("m_bucket"), HL + ["le"], GWEEK, duration_ms("31d"))
    return S.final(hq_sql(inst, HL, q), HL)


@register("a11_histogram_quantile", _hq_sql(0.9))
def q_a11_histogram_quantile(spark, sf):
    return out(A.histogram_quantile(A.instant(T.m_bucket(spark, sf), GWEEK, "31d"), 0.9))


@register("a11_histogram_quantile_p50", _hq_sql(0.5))
def q_a11_histogram_quantile_p50(spark, sf):
    return out(A.histogram_quantile(A.instant(T.m_bucket(spark, sf), GWEEK, "31d"), 0.5))


_P7 = S.view('m_gauge', "event_type = 'purchase' AND user_id = '7'")


@register("a13_absent", S.final(
    f"(SELECT 'purchase' AS event_type, '7' AS user_id, g.ts, 1.0 AS value FROM {S.grid(G6H)} g WHERE NOT EXISTS "
    f"(SELECT 1 FROM {_P7} s "
    f"WHERE s.ts > g.ts - 300000 AND s.ts <= g.ts))", GL))
def q_a13_absent(spark, sf):
    sel = A.select(T.m_gauge(spark, sf), eq={"event_type": "purchase", "user_id": "7"})
    return out(A.absent(A.instant(sel, G6H, "5m"), G6H, {"event_type": "purchase", "user_id": "7"}))


# ---------------------------------------------------------------- vector matching
_IC = S.instant(S.view("m_counter"), ET, G6H, LB)
_ICR = S.instant(S.view("m_counter_reset"), ET, G6H, LB)


@register("j1_one_to_one", S.final(
    f"(SELECT a.event_type, a.ts, CASE WHEN b.value = 0 THEN 'nan'::DOUBLE ELSE a.value / b.value END AS value "
    f"FROM {_ICR} a JOIN {_IC} b ON a.event_type = b.event_type AND a.ts = b.ts)", ET, 9))
def q_j1_one_to_one(spark, sf):
    return out(A.binop(_inst(T.m_counter_reset(spark, sf)), _inst(T.m_counter(spark, sf)), "/"), 9)


_SUMU = S.agg(_I6, "sum", GL)
_SUMT = S.agg(_I6, "sum", ET)


@register("j2_on_group_left", S.final(
    f"(SELECT a.event_type, a.user_id, a.ts, a.value / b.value AS value FROM {_SUMU} a JOIN {_SUMT} b "
    f"ON a.event_type = b.event_type AND a.ts = b.ts)", GL, 9))
def q_j2_on_group_left(spark, sf):
    g = _inst(T.m_gauge(spark, sf))
    return out(A.binop(A.aggregate(g, "sum", by=GL), A.aggregate(g, "sum", by=ET), "/",
                       on=ET, group_left=[]), 9)


@register("j3_ignoring", S.final(
    f"(SELECT a.event_type, a.user_id, a.ts, a.value / b.value AS value FROM {_I6} a JOIN {_SUMT} b "
    f"ON a.event_type = b.event_type AND a.ts = b.ts)", GL, 9))
def q_j3_ignoring(spark, sf):
    g = _inst(T.m_gauge(spark, sf))
    return out(A.binop(g, A.aggregate(g, "sum", by=ET), "/", ignoring=["user_id"], group_left=[]), 9)


@register("j5_group_right", S.final(
    f"(SELECT b.event_type, b.user_id, b.ts, a.value - b.value AS value FROM {_SUMT} a JOIN {_I6} b "
    f"ON a.event_type = b.event_type AND a.ts = b.ts)", GL, 4))
def q_j5_group_right(spark, sf):
    g = _inst(T.m_gauge(spark, sf))
    return out(A.binop(A.aggregate(g, "sum", by=ET), g, "-", on=ET, group_right=[]), 4)


_IS6 = S.instant(S.view("m_state"), ["user_id"], G6H, LB)


@register("j6_and", S.final(
    f"(SELECT * FROM {_I6} a WHERE EXISTS (SELECT 1 FROM {_IS6} b WHERE b.user_id = a.user_id AND b.ts = a.ts "
    f"AND b.value = 0))", GL))
def q_j6_and(spark, sf):
    st = A.where_value(_inst(T.m_state(spark, sf)), "==", 0)
    return out(A.set_and(_inst(T.m_gauge(spark, sf)), st, on=["user_id"]))


@register("j7_unless", S.final(
    f"(SELECT * FROM {_I6} a WHERE NOT EXISTS (SELECT 1 FROM {_IS6} b WHERE b.user_id = a.user_id AND b.ts = a.ts "
    f"AND b.value = 0))", GL))
def q_j7_unless(spark, sf):
    st = A.where_value(_inst(T.m_state(spark, sf)), "==", 0)
    return out(A.set_unless(_inst(T.m_gauge(spark, sf)), st, on=["user_id"]))


_OI = S.instant(S.view("m_order_info"), ["o_custkey", "o_orderpriority", "o_orderstatus"], GWEEK, duration_ms("60d"))
_OV = S.instant(S.view("m_order_value"), ["o_custkey", "o_orderstatus"], GWEEK, duration_ms("60d"))


@register("j9_info_join", S.final(
    f"(SELECT v.o_custkey, v.o_orderstatus, i.o_orderpriority, v.ts, v.value * i.value AS value FROM {_OV} v JOIN "
    f"(SELECT o_custkey, o_orderpriority, ts, value FROM (SELECT o_custkey, o_orderpriority, ts, MAX(value) AS value, "
    f"ROW_NUMBER() OVER (PARTITION BY o_custkey, ts ORDER BY MAX(value) DESC, o_custkey, o_orderpriority) AS rn "
    f"FROM {_OI} GROUP BY o_custkey, o_orderpriority, ts) WHERE rn = 1) i ON v.o_custkey = i.o_custkey AND v.ts = i.ts)",
    ["o_custkey", "o_orderstatus", "o_orderpriority"], 2))
def q_j9_info_join(spark, sf):
    v = A.instant(T.m_order_value(spark, sf), GWEEK, "60d")
    i = A.instant(T.m_order_info(spark, sf), GWEEK, "60d")
    return out(A.info_join(v, i, on=["o_custkey"], labels=["o_orderpriority"]), 2)


_S_CLICK = S.agg(S.instant(S.view("m_gauge", "event_type = 'click'"), GL, G6H, LB), "sum", ["user_id"])
_S_VIEW = S.agg(S.instant(S.view("m_gauge", "event_type = 'view'"), GL, G6H, LB), "sum", ["user_id"])


@register("u1_or", S.final(
    f"(SELECT * FROM {_S_CLICK} UNION ALL SELECT * FROM {_S_VIEW} v WHERE NOT EXISTS "
    f"(SELECT 1 FROM {_S_CLICK} c WHERE c.user_id = v.user_id AND c.ts = v.ts))", ["user_id"]))
def q_u1_or(spark, sf):
    g = T.m_gauge(spark, sf)
    c = A.aggregate(_inst(A.select(g, eq={"event_type": "click"})), "sum", by=["user_id"])
    v = A.aggregate(_inst(A.select(g, eq={"event_type": "view"})), "sum", by=["user_id"])
    return out(A.set_or(c, v))


_SP5 = S.agg(S.instant(S.view("m_gauge", "event_type = 'purchase'"), GL, G6H, 300000), "sum", [])


@register("u2_or_vector0", S.final(
    f"(SELECT * FROM {_SP5} UNION ALL SELECT g.ts, 0.0 FROM {S.grid(G6H)} g WHERE g.ts NOT IN (SELECT ts FROM {_SP5}))",
    []))
def q_u2_or_vector0(spark, sf):
    s = A.aggregate(A.instant(A.select(T.m_gauge(spark, sf), eq={"event_type": "purchase"}), G6H, "5m"), "sum")
    return out(A.default_zero(s, G6H))


@register("u3_absent_fill", S.final(
    f"(SELECT * FROM {_SP5} UNION ALL SELECT g.ts, 0.0 FROM {S.grid(G6H)} g WHERE g.ts NOT IN (SELECT ts FROM {_SP5}))",
    []))
def q_u3_absent_fill(spark, sf):
    """``x or 0 * absent(x)`` – same result as ``or vector(0)`` when x has no labels."""
    sel = A.select(T.m_gauge(spark, sf), eq={"event_type": "purchase"})
    s = A.aggregate(A.instant(sel, G6H, "5m"), "sum")
    return out(A.set_or(s, A.scalar_op(A.absent(A.instant(sel, G6H, "5m"), G6H, {}), "*", 0)))


# ---------------------------------------------------------------- long windows
D5, D7 = duration_ms("5d"), duration_ms("7d")


@register("wl_rate_sum_by", S.final(S.agg(S.extrapolated(S.view("m_user_counter"), GL, G6H, D5), "sum", ET), ET))
def q_wl_rate_sum_by(spark, sf):
    """``sum by (event_type) (rate(x[5d]))``, a window of 20 steps."""
    return out(A.aggregate(A.rate(T.m_user_counter(spark, sf), "5d", G6H), "sum", by=ET))


@register("wl_increase_resets", S.final(S.extrapolated(S.view("m_counter_reset"), ET, G6H, D5, per_second=False), ET))
def q_wl_increase_resets(spark, sf):
    return out(A.increase(T.m_counter_reset(spark, sf), "5d", G6H))


@register("wl_irate", S.final(_irate_sql(S.view("m_counter_reset"), ET, G6H, D5), ET))
def q_wl_irate(spark, sf):
    return out(A.irate(T.m_counter_reset(spark, sf), "5d", G6H))


@register("wl_changes", S.final(_changes_sql(S.view("m_state"), ["user_id"], G6H, D7), ["user_id"]))
def q_wl_changes(spark, sf):
    return out(A.changes(T.m_state(spark, sf), "7d", G6H))


for _fn, _f in (("avg", "AVG(value)"), ("max", "MAX(value)"), ("min", "MIN(value)"), ("last", "arg_max(value, ts)")):
    def _mk(fn):
        def q(spark, sf):
            g = T.m_gauge(spark, sf)
            if fn == "avg":
                g = g.with_df(g.df.withColumn(VALUE, F.col(VALUE) * SQRT2))
            return out(A.over_time(g, fn, "7d", G6H))
        return q
    src = _G7 if _fn == "avg" else S.view("m_gauge")
    register(f"wl_{_fn}_over_time", S.final(_over_time_sql(src, GL, G6H, D7, _f), GL))(_mk(_fn))


_REC = S.agg(f"(SELECT event_type, user_id, ts, value * {SQRT2} AS value FROM {_I6})", "sum", ET)


@register("wl_avg_over_recorded", S.final(_over_time_sql(_REC, ET, G6H, D5, "AVG(value)"), ET))
def q_wl_avg_over_recorded(spark, sf):
    """``avg_over_time(recorded[5d])`` where the recorded series sit exactly on the grid:
    the sample at t - 5d is inside the closed window (slot edge case)."""
    rec = A.aggregate(A.scalar_op(_inst(T.m_gauge(spark, sf)), "*", SQRT2), "sum", by=ET)
    return out(A.avg_over_time(rec, "5d", G6H))


@register("wl_max_over_recorded", S.final(_over_time_sql(S.agg(_I6, "count", ET), ET, G6H, D5, "MAX(value)"), ET))
def q_wl_max_over_recorded(spark, sf):
    rec = A.aggregate(_inst(T.m_gauge(spark, sf)), "count", by=ET)
    return out(A.max_over_time(rec, "5d", G6H))


@register("wl_rate_over_recorded", S.final(S.extrapolated(S.agg(_I6, "count", ET), ET, G6H, D5), ET))
def q_wl_rate_over_recorded(spark, sf):
    rec = A.aggregate(_inst(T.m_gauge(spark, sf)), "count", by=ET)
    return out(A.rate(rec, "5d", G6H))


# ---------------------------------------------------------------- histogram mean, interval join, rename fallback
_RS = S.agg(S.extrapolated(S.view("m_user_counter"), GL, G6H, D2), "sum", ET)
_RC = S.agg(S.extrapolated(S.view("m_user_count"), GL, G6H, D2), "sum", ET)


@register("a12_histogram_avg", S.final(
    f"(SELECT a.event_type, a.ts, CASE WHEN b.value = 0 THEN 'nan'::DOUBLE ELSE a.value / b.value END AS value "
    f"FROM {_RS} a JOIN {_RC} b ON a.event_type = b.event_type AND a.ts = b.ts)", ET))
def q_a12_histogram_avg(spark, sf):
    """``sum by (event_type) (rate(v_sum[2d])) / sum by (event_type) (rate(v_count[2d]))``."""
    return out(A.histogram_avg(T.m_user_counter(spark, sf), T.m_user_count(spark, sf), "2d", G6H, by=ET))


_IV_SQL = """(SELECT CAST(user_id AS VARCHAR) AS app, 'job' AS kind,
              CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS name,
              MIN(epoch_us(ts) // 1000) AS start_ts, MAX(epoch_us(ts) // 1000) AS end_ts
       FROM events GROUP BY user_id, CAST(ts AS DATE)
       UNION ALL
       SELECT CAST(user_id AS VARCHAR), 'stage', CAST(user_id AS VARCHAR) || '/' || event_type || '/' || CAST(CAST(ts AS DATE) AS VARCHAR),
              MIN(epoch_us(ts) // 1000), MAX(epoch_us(ts) // 1000)
       FROM events GROUP BY user_id, event_type, CAST(ts AS DATE))"""


@register("j11_interval_join", f"""
SELECT s.event_type, s.user_id, s.ts, ROUND(s.value, 6) AS value, i.kind, i.name, i.start_ts, i.end_ts
FROM {S.view("m_gauge")} s JOIN {_IV_SQL} i ON s.user_id = i.app AND s.ts BETWEEN i.start_ts AND i.end_ts""")
def q_j11_interval_join(spark, sf):
    """Every sample annotated with the job and stage spans of its application that contain it."""
    g = T.m_gauge(spark, sf).df
    j = A.annotate(g, T.app_intervals(spark, sf), on=[("user_id", "app")])
    return j.select(*GL, TS, rnd(VALUE, 6).alias(VALUE), "kind", "name", "start_ts", "end_ts")


_R_OLD = S.extrapolated(S.view("m_counter_reset", "regexp_full_match(event_type, 'error|click')"), ET, G6H, D1)
_R_NEW = S.extrapolated(S.view("m_counter"), ET, G6H, D1)


@register("u4_rename_fallback", S.final(
    f"(SELECT * FROM {_R_OLD} UNION ALL SELECT * FROM {_R_NEW} n WHERE NOT EXISTS "
    f"(SELECT 1 FROM {_R_OLD} o WHERE o.event_type = n.event_type AND o.ts = n.ts))", ET))
def q_u4_rename_fallback(spark, sf):
    """``rate(old_name[1d]) or rate(new_name[1d])``: the old series where it still exists (U4)."""
    old = A.rate(A.select(T.m_counter_reset(spark, sf), re={"event_type": "error|click"}), "1d", G6H)
    new = A.rate(T.m_counter(spark, sf), "1d", G6H)
    return out(A.coalesce_metrics(old, new))
