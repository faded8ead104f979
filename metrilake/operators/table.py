"""Dashboard-level query and table operators: D1–D12.

Panels run a query over a step grid (range) or at one time (instant) and then
reshape the result: merge several queries on their shared labels, compute
fields, reduce each series to one number, fill gaps, stack.  All of it is
DataFrame joins, grouped aggregates and windows partitioned by series or by
time (bounded by the number of grid points or of series in one panel).
"""
from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import TS, VALUE, Grid, MetricFrame, fdiv

MAX_RATE_INTERVAL_FLOOR_S = 15


def query_range(expr: Callable[[Grid], MetricFrame], start, end, step) -> MetricFrame:
    """Range query (D1): evaluate ``expr`` on the grid start..end by step."""
    return expr(Grid.range(start, end, step))


def query_instant(expr: Callable[[Grid], MetricFrame], t) -> MetricFrame:
    """Instant table query."""
    return expr(Grid.instant(t))


def rate_interval(step_s: float, scrape_s: float = 30) -> str:
    """``$__rate_interval`` = max(4 × scrape, step + scrape), in seconds."""
    return f"{int(max(4 * scrape_s, step_s + scrape_s))}s"


def group_last(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``groupBy`` transform with ``lastNotNull`` per field (D3)."""
    aggs = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(TS), F.col(f))))[f].alias(f) for f in fields]
    return df.groupBy(*by).agg(*aggs)


def merge(frames: Mapping[str, MetricFrame], on: Sequence[str] | None = None, with_time: bool = True) -> DataFrame:
    """``merge`` (D4): full outer join of the queries on their shared labels;
    each query's value becomes column ``value_<refId>``."""
    items = list(frames.items())
    shared = on if on is not None else [l for l in items[0][1].labels if all(l in f.labels for _, f in items)]
    keys = list(shared) + ([TS] if with_time else [])
    out = None
    for ref, mf in items:
        d = mf.df.select(*keys, F.col(VALUE).alias(f"value_{ref}"))
        out = d if out is None else out.join(d, on=keys, how="full")
    return out


def calc(df: DataFrame, name: str, a: str, op: str, b) -> DataFrame:
    """``calculateField`` binary operation (D5); b is a column name or a number."""
    x, y = F.col(a), (F.col(b) if isinstance(b, str) else F.lit(float(b)))
    v = {"+": x + y, "-": x - y, "*": x * y, "/": fdiv(x, y)}[op]
    return df.withColumn(name, v)


def organize(df: DataFrame, exclude: Sequence[str] = (), order: Sequence[str] | None = None,
             rename: Mapping[str, str] | None = None) -> DataFrame:
    """``organize`` (D6): hide, reorder and rename columns."""
    rename = rename or {}
    cols = [c for c in (order or df.columns) if c not in set(exclude)]
    cols += [c for c in df.columns if c not in cols and c not in set(exclude)]
    return df.select(*[F.col(c).alias(rename.get(c, c)) for c in cols])


def labels_to_fields(df: DataFrame, keys: Sequence[str], col: str = "labels") -> DataFrame:
    """``labelsToFields`` (D7): named entries of a label map become columns."""
    return df.select("*", *[F.coalesce(F.col(col)[k], F.lit("")).alias(k) for k in keys]).drop(col)


def reduce_series(mf: MetricFrame, how: str) -> DataFrame:
    """Single-stat reduction of each series over the range (D8):
    avg/mean, min, max, current/last, lastNotNull."""
    v = F.col(VALUE)
    agg = {
        "avg": F.avg(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v),
        "current": F.max(F.struct(F.col(TS), v))[VALUE], "last": F.max(F.struct(F.col(TS), v))[VALUE],
        "lastNotNull": F.max(F.when(v.isNotNull() & ~F.isnan(v), F.struct(F.col(TS), v)))[VALUE],
    }[how]
    return mf.df.groupBy(*mf.labels).agg(agg.alias(VALUE))


def fill_gaps(mf: MetricFrame, grid: Grid, how: str = "null") -> MetricFrame:
    """Gap policy over the grid (D9): ``null`` leaves gaps, ``zero`` fills 0,
    ``connected`` carries the last value forward.  Every series is expanded
    to the grid with ``sequence`` (series × grid points, the panel's size)."""
    if how == "null":
        return mf
    series = mf.df.select(*mf.labels).distinct()
    full = series.select(*mf.labels, F.explode(F.sequence(F.lit(grid.start), F.lit(grid.end), F.lit(grid.step)))
                         .alias(TS))
    d = full.join(mf.df.select(*mf.labels, TS, VALUE), on=list(mf.labels) + [TS], how="left")
    if how == "zero":
        d = d.withColumn(VALUE, F.coalesce(F.col(VALUE), F.lit(0.0)))
    elif how == "connected":
        w = Window.partitionBy(*mf.labels).orderBy(TS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = d.withColumn(VALUE, F.last(VALUE, ignorenulls=True).over(w)).filter(F.col(VALUE).isNotNull())
    else:
        raise ValueError(how)
    return mf.with_df(d.select(*mf.labels, TS, VALUE))


def stack(mf: MetricFrame, negative_y: str | None = None, on: str | None = None) -> MetricFrame:
    """Stacked values (D10): running sum over series (label order) at each time;
    series whose ``on`` label matches ``negative_y`` are drawn below zero."""
    v = F.col(VALUE)
    if negative_y and on:
        v = F.when(F.col(on).rlike(f"^(?:{negative_y})$"), -v).otherwise(v)
    w = Window.partitionBy(TS).orderBy(*mf.labels).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = mf.df.withColumn(VALUE, F.sum(v).over(w))
    return mf.with_df(d)


def per_value(agg_fn: Callable[..., MetricFrame], mf: MetricFrame, op: str, by: Sequence[str], label: str) -> MetricFrame:
    """Repeated panel per variable value (D11): one job with ``label`` added to ``by``."""
    return agg_fn(mf, op, by=list(by) + [label])


def chained_values(mf: MetricFrame, label: str, **bound) -> DataFrame:
    """Variable whose values depend on earlier variables (D12): ``label_values(metric{bound…}, label)``."""
    from ..operators.select import bind, select
    from ..sources.store import label_values
    return label_values(select(mf, **bind(bound)), label)
