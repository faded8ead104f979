"""SQL text for the DuckDB oracle.

Written as a *different formulation* of each operator: range joins of samples
onto the grid (``BETWEEN``), full-series ``LAG`` and ``arg_min``/``arg_max``
instead of the Spark side's per-window expansion.  Times are epoch ms, labels
strings with '' for absent, values rounded to 6 digits.  Timestamps become
epoch ms by truncation (``epoch_us // 1000``), as Spark's conversion does.
"""
from __future__ import annotations

from ..frame import Grid

# -- metric views over the driver's tables -----------------------------------------
VIEWS = {
    "m_gauge": "SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, (epoch_us(ts) // 1000) AS ts, value FROM events",
    "m_gauge_ns": ("SELECT 'ns-' || CAST(user_id % 5 AS VARCHAR) AS namespace, CAST(user_id AS VARCHAR) AS user_id, "
                   "event_type, (epoch_us(ts) // 1000) AS ts, value FROM events"),
    "m_counter": ("SELECT event_type, (epoch_us(ts) // 1000) AS ts, SUM(value) OVER (PARTITION BY event_type "
                  "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events"),
    "m_user_counter": ("SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, (epoch_us(ts) // 1000) AS ts, "
                       "SUM(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id "
                       "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM events"),
    "m_user_count": ("SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, (epoch_us(ts) // 1000) AS ts, "
                     "CAST(COUNT(*) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id "
                     "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value FROM events"),
    "m_counter_reset": ("SELECT event_type, (epoch_us(ts) // 1000) AS ts, SUM(value) OVER (PARTITION BY event_type, "
                        "CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
                        "AS value FROM events"),
    "m_state": ("SELECT CAST(user_id AS VARCHAR) AS user_id, (epoch_us(ts) // 1000) AS ts, "
                "CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS value FROM events"),
    "m_order_info": ("SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority, o_orderstatus, "
                     "(epoch_us(o_orderdate) // 1000) AS ts, 1.0 AS value FROM orders"),
    "m_order_value": ("SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, (epoch_us(o_orderdate) // 1000) AS ts, "
                      "o_totalprice AS value FROM orders"),
    "m_bucket": ("SELECT l_returnflag, l_linestatus, b.le, (epoch_us(date_trunc('month', l_shipdate)) // 1000) AS ts, "
                 "CAST(COUNT(*) AS DOUBLE) AS value FROM lineitem JOIN (VALUES ('5', 5.0), ('10', 10.0), "
                 "('25', 25.0), ('50', 50.0), ('+Inf', 'inf'::DOUBLE)) b(le, bound) ON l_quantity <= b.bound "
                 "GROUP BY l_returnflag, l_linestatus, b.le, date_trunc('month', l_shipdate)"),
}


def view(name: str, where: str = "") -> str:
    base = VIEWS[name]
    return f"(SELECT * FROM ({base}) WHERE {where})" if where else f"({base})"


def grid(g: Grid) -> str:
    return f"(SELECT CAST({g.start} + i * {g.step} AS BIGINT) AS ts FROM range(0, {g.n}) r(i))"


def cols(labels, prefix: str = "") -> str:
    return ", ".join(prefix + l for l in labels)


def instant(src: str, labels, g: Grid, lookback_ms: int) -> str:
    """Newest sample in (t - lookback, t] for every grid time."""
    lc = cols(labels, "s.")
    sep = ", " if labels else ""
    grp = f"{lc}{sep}g.ts"
    # newest sample; equal timestamps → the larger value (same rule as the Spark side)
    return (f"(SELECT {lc}{sep}g.ts AS ts, MAX(struct_pack(t := s.ts, v := s.value)).v AS value "
            f"FROM {src} s JOIN {grid(g)} g "
            f"ON s.ts > g.ts - {lookback_ms} AND s.ts <= g.ts GROUP BY {grp})")


def windowed(src: str, labels, g: Grid, rng_ms: int, with_prev: bool = False) -> str:
    """Samples joined to every grid time whose window [t - range, t] holds them."""
    lc = cols(labels, "s.")
    sep = ", " if labels else ""
    if with_prev:
        part = f"PARTITION BY {cols(labels)}" if labels else ""
        src = (f"(SELECT *, LAG(value) OVER ({part} ORDER BY ts, value) AS pv, "
               f"LAG(ts) OVER ({part} ORDER BY ts, value) AS pt FROM {src})")
        extra = ", s.pv, s.pt"
    else:
        extra = ""
    return (f"(SELECT {lc}{sep}g.ts AS t, s.ts, s.value{extra} FROM {src} s JOIN {grid(g)} g "
            f"ON s.ts BETWEEN g.ts - {rng_ms} AND g.ts)")


def extrapolated(src: str, labels, g: Grid, rng_ms: int, counter=True, per_second=True) -> str:
    lc = cols(labels)
    sep = ", " if labels else ""
    w = windowed(src, labels, g, rng_ms, with_prev=True)
    corr = f"SUM(CASE WHEN pt >= t - {rng_ms} AND value < pv THEN pv ELSE 0 END)" if counter else "0"
    agg = (f"(SELECT {lc}{sep}t, COUNT(*) AS n, MIN(struct_pack(t := ts, v := value)).v AS fv, MIN(ts) AS ft, "
           f"MAX(struct_pack(t := ts, v := value)).v AS lv, "
           f"MAX(ts) AS lt, {corr} AS corr FROM {w} GROUP BY {lc}{sep}t HAVING COUNT(*) >= 2 AND MAX(ts) > MIN(ts))")
    d = "(lv - fv + corr)"
    sampled = "((lt - ft) / 1000.0)"
    avg_gap = f"({sampled} / (n - 1))"
    to_start = f"((ft - (t - {rng_ms})) / 1000.0)"
    if counter:
        to_zero = f"({sampled} * (fv / {d}))"
        to_start = f"(CASE WHEN {d} > 0 AND fv >= 0 AND {to_zero} < {to_start} THEN {to_zero} ELSE {to_start} END)"
    to_end = "((t - lt) / 1000.0)"
    ext = (f"({sampled} + CASE WHEN {to_start} < {avg_gap} * 1.1 THEN {to_start} ELSE {avg_gap} / 2 END "
           f"+ CASE WHEN {to_end} < {avg_gap} * 1.1 THEN {to_end} ELSE {avg_gap} / 2 END)")
    val = f"{d} * ({ext} / {sampled})"
    if per_second:
        val = f"({val}) / {rng_ms / 1000.0}"
    return f"(SELECT {lc}{sep}t AS ts, {val} AS value FROM {agg})"


def agg(src: str, op: str, by) -> str:
    f = {"sum": "SUM(value)", "avg": "AVG(value)", "min": "MIN(value)", "max": "MAX(value)",
         "count": "CAST(COUNT(*) AS DOUBLE)", "stdvar": "VAR_POP(value)"}[op]
    lc = cols(by)
    sep = ", " if by else ""
    return f"(SELECT {lc}{sep}ts, {f} AS value FROM {src} GROUP BY {lc}{sep}ts)"


def final(src: str, labels, digits: int = 6) -> str:
    lc = cols(labels)
    sep = ", " if labels else ""
    return f"SELECT {lc}{sep}ts, ROUND(value, {digits}) AS value FROM {src}"
