"""Range (window) functions over one series: W1–W13.

Window semantics: at grid time t a function sees the samples with
t - range <= ts <= t.  All of them read one row per (series, t) from
``slots.window_table``, which merges summaries of the series' slots: samples are
shuffled once, whatever range and step are, and no group holds more than the
samples of one series in one slot.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import NAME, TS, VALUE, Grid, MetricFrame, duration_ms, fdiv
from .series import running_sum, series_lag
from .slots import MOMENTS, nan_aware, window_table


def _labels_out(mf: MetricFrame, keep_name: bool = False) -> tuple[str, ...]:
    return mf.labels if keep_name else tuple(l for l in mf.labels if l != NAME)


def _finish(mf: MetricFrame, grid: Grid, agg: DataFrame, value: Column, keep_name=False,
            cond: Column | None = None) -> MetricFrame:
    labels = _labels_out(mf, keep_name)
    if cond is not None:
        agg = agg.filter(cond)
    out = agg.select(*labels, grid.ts_of(F.col("_k")).alias(TS), value.cast("double").alias(VALUE))
    return MetricFrame(out, labels)


def over_time(mf: MetricFrame, fn: str, rng, grid: Grid) -> MetricFrame:
    """avg/min/max/last ``_over_time``."""
    parts = {"avg": {"sum"}, "min": {"min", "nans"}, "max": {"max", "nans"}, "last": {"last"}}
    if fn not in parts:
        raise ValueError(f"unknown over_time function {fn}")
    t = window_table(mf, grid, duration_ms(rng), parts[fn])
    val = {"avg": lambda: F.col("sum") / F.col("n"), "min": lambda: nan_aware(F.col("min"), F.col("nans")),
           "max": lambda: nan_aware(F.col("max"), F.col("nans")), "last": lambda: F.col("last.v")}[fn]()
    return _finish(mf, grid, t, val, keep_name=(fn == "last"))


def avg_over_time(mf, rng, grid): return over_time(mf, "avg", rng, grid)
def min_over_time(mf, rng, grid): return over_time(mf, "min", rng, grid)
def max_over_time(mf, rng, grid): return over_time(mf, "max", rng, grid)
def last_over_time(mf, rng, grid): return over_time(mf, "last", rng, grid)


def _regression(mf: MetricFrame, rng, grid: Grid) -> tuple[DataFrame, Column, Column]:
    """The windows with at least two samples, slope per second and value at t of their least-squares lines.

    The sums of the slots are about origins near the window (see ``window_table``); slots are summed about their
    own means first, so neither epoch times nor large values cost digits.
    """
    t = window_table(mf, grid, duration_ms(rng), set(MOMENTS))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    var, cov = F.col("sxx") - sx * sx / n, F.col("sxy") - sx * sy / n
    slope = F.when(F.col("_wide"), fdiv(cov, var))
    at = (grid.ts_of(F.col("_k")) - F.col("x0")) / F.lit(1000.0)
    # samples that share one timestamp leave only rounding in var
    t = t.filter(n >= 2).withColumn("_wide", var > F.col("sxx") * F.lit(1e-14))
    return t, slope, F.col("y0") + sy / n + slope * (at - sx / n)


def deriv(mf: MetricFrame, rng, grid: Grid) -> MetricFrame:
    """Least-squares slope per second (W4); needs two samples."""
    t, slope, _ = _regression(mf, rng, grid)
    return _finish(mf, grid, t, slope)


def predict_linear(mf: MetricFrame, rng, grid: Grid, seconds: float) -> MetricFrame:
    """Value the least-squares line reaches ``seconds`` after t."""
    t, slope, now = _regression(mf, rng, grid)
    return _finish(mf, grid, t, slope * F.lit(float(seconds)) + now)


def _extrapolated(mf: MetricFrame, rng, grid: Grid, is_counter: bool, is_rate: bool) -> MetricFrame:
    r = duration_ms(rng)
    agg = window_table(mf, grid, r, {"first", "last", "drops"} if is_counter else {"first", "last"})
    t = grid.ts_of(F.col("_k"))
    fv, ft, lv, lt, n = F.col("first.v"), F.col("first.ts"), F.col("last.v"), F.col("last.ts"), F.col("n")
    delta = lv - fv + (F.col("drops") if is_counter else F.lit(0.0))
    to_start = (ft - (t - F.lit(r))) / F.lit(1000.0)
    to_end = (t - lt) / F.lit(1000.0)
    sampled = (lt - ft) / F.lit(1000.0)
    avg_gap = sampled / (n - F.lit(1))
    if is_counter:
        to_zero = sampled * (fv / delta)
        to_start = F.when((delta > 0) & (fv >= 0) & (to_zero < to_start), to_zero).otherwise(to_start)
    thr = avg_gap * F.lit(1.1)
    ext = (sampled
           + F.when(to_start < thr, to_start).otherwise(avg_gap / 2)
           + F.when(to_end < thr, to_end).otherwise(avg_gap / 2))
    res = delta * (ext / sampled)
    if is_rate:
        res = res / F.lit(r / 1000.0)
    return _finish(mf, grid, agg, res, cond=(n >= 2) & (lt > ft))


def rate(mf: MetricFrame, rng, grid: Grid) -> MetricFrame:
    """Per-second counter increase, reset-aware and extrapolated to the window edges."""
    return _extrapolated(mf, rng, grid, is_counter=True, is_rate=True)


def increase(mf: MetricFrame, rng, grid: Grid) -> MetricFrame:
    """Counter increase over the window (W3) = rate × range."""
    return _extrapolated(mf, rng, grid, is_counter=True, is_rate=False)


def irate(mf: MetricFrame, rng, grid: Grid) -> MetricFrame:
    """Per-second rate from the last two samples in the window, no extrapolation."""
    r = duration_ms(rng)
    agg = window_table(mf, grid, r, {"prev"})
    lv, lt, pv, pt = F.col("last.v"), F.col("last.ts"), F.col("last.pv"), F.col("last.pts")
    diff = F.when(lv < pv, lv).otherwise(lv - pv)
    in_window = pt.isNotNull() & (pt >= grid.ts_of(F.col("_k")) - F.lit(r)) & (lt > pt)
    return _finish(mf, grid, agg, diff / ((lt - pt) / F.lit(1000.0)), cond=in_window)


def changes(mf: MetricFrame, rng, grid: Grid) -> MetricFrame:
    """Number of value changes between consecutive samples in the window."""
    return _finish(mf, grid, window_table(mf, grid, duration_ms(rng), {"changes"}), F.col("changes"))


def subquery_grid(grid: Grid, rng, res) -> Grid:
    """Inner grid of ``expr[range:res]``: multiples of res from start-range to end."""
    r, s = duration_ms(rng), duration_ms(res)
    lo = grid.start - r
    first = (lo // s) * s
    if first < lo:
        first += s
    last = (grid.end // s) * s
    return Grid(first, max(first, last), s)


def subquery(inner: Callable[[Grid], MetricFrame], rng, res, grid: Grid,
             fn: Callable[..., MetricFrame], *args) -> MetricFrame:
    """``fn(inner[range:res])`` (W11): evaluate ``inner`` on the aligned inner grid,
    then apply the range function to its output as if it were raw samples."""
    inner_mf = inner(subquery_grid(grid, rng, res))
    return fn(inner_mf, rng, grid, *args)


def monotonic(mf: MetricFrame, bucket_ms: int = 86_400_000) -> MetricFrame:
    """Counter-reset correction as its own step (W13): value + all earlier drops.

    Exact over the whole history; partitioned by (series, day) with bucket
    edges repaired by ``series_lag``/``running_sum`` (no hot-series task).
    """
    d = series_lag(mf.df, mf.labels, TS, [VALUE], bucket_ms=bucket_ms)
    drop = F.when(F.col("prev_value").isNotNull() & (F.col(VALUE) < F.col("prev_value")),
                  F.col("prev_value")).otherwise(F.lit(0.0))
    d = running_sum(d, mf.labels, TS, [], drop, "_adj", bucket_ms=bucket_ms)
    return mf.with_df(d.select(*mf.labels, TS, (F.col(VALUE) + F.col("_adj")).alias(VALUE)))
