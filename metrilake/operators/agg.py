"""Aggregations over series at each evaluation time: A1–A13.

All of them group by (grouping labels, ts) with built-in aggregate functions,
so Spark merges partial aggregates on the map side and a hot group costs one
row per map task in the shuffle.  ``topk`` uses a salted two-stage window so
that even a global top-k is never one task's sort over all series.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..frame import NAN, NAME, TS, VALUE, Grid, MetricFrame, ensure_labels, label_list

TOPK_SALTS = 64


def _nan_masked(fn, v: Column) -> Column:
    real = fn(F.when(~F.isnan(v), v))
    return F.when(real.isNull() & (F.count(v) > 0), F.lit(NAN)).otherwise(real)


_AGGS = {
    "sum": lambda v: F.sum(v),
    "avg": lambda v: F.avg(v),
    "min": lambda v: _nan_masked(F.min, v),
    "max": lambda v: _nan_masked(F.max, v),
    "count": lambda v: F.count(v).cast("double"),
    "stdvar": lambda v: F.var_pop(v),
}


def aggregate(mf: MetricFrame, op: str, by: Sequence[str] | None = None,
              without: Sequence[str] | None = None) -> MetricFrame:
    """``op by (...)`` / ``op without (...)`` / global."""
    if op not in _AGGS:
        raise ValueError(f"unknown aggregation {op}")
    keys = label_list(mf, by, without)
    mf = ensure_labels(mf, keys)
    out = mf.df.groupBy(*keys, TS).agg(_AGGS[op](F.col(VALUE)).alias(VALUE))
    return MetricFrame(out.select(*keys, TS, VALUE), tuple(keys))


def sum_(mf, by=None, without=None): return aggregate(mf, "sum", by, without)
def avg(mf, by=None, without=None): return aggregate(mf, "avg", by, without)
def min_(mf, by=None, without=None): return aggregate(mf, "min", by, without)
def max_(mf, by=None, without=None): return aggregate(mf, "max", by, without)
def count(mf, by=None, without=None): return aggregate(mf, "count", by, without)
def stdvar(mf, by=None, without=None): return aggregate(mf, "stdvar", by, without)


def value_text(v: Column) -> Column:
    """Float → label text the way the metric server prints it ("1", "0.5", "NaN", "+Inf")."""
    return (F.when(F.isnan(v), F.lit("NaN"))
            .when(v == F.lit(float("inf")), F.lit("+Inf"))
            .when(v == F.lit(float("-inf")), F.lit("-Inf"))
            .when((v == F.floor(v)) & (F.abs(v) < F.lit(1e15)), v.cast("bigint").cast("string"))
            .otherwise(v.cast("string")))


def count_values(mf: MetricFrame, label: str, by: Sequence[str] | None = None,
                 without: Sequence[str] | None = None) -> MetricFrame:
    """Number of series per distinct value; the value becomes label ``label``."""
    keys = label_list(mf, by, without)
    mf = ensure_labels(mf, keys)
    keys = [k for k in keys if k != label]
    out = (mf.df.withColumn(label, value_text(F.col(VALUE)))
             .groupBy(*keys, label, TS).agg(F.count(F.lit(1)).cast("double").alias(VALUE)))
    labels = tuple(keys) + (label,)
    return MetricFrame(out.select(*labels, TS, VALUE), labels)


def _rank_key(mf: MetricFrame, largest: bool) -> list[Column]:
    v = F.col(VALUE)
    primary = F.desc(VALUE) if largest else F.asc(VALUE)
    # NaN always ranks last; ties broken by the label tuple (ours – the spec leaves it open)
    return [F.isnan(v).asc(), primary] + [F.col(l).asc() for l in mf.labels]


def topk(mf: MetricFrame, k: int, by: Sequence[str] | None = None,
         without: Sequence[str] | None = None, largest: bool = True) -> MetricFrame:
    """k largest series per group and time, all labels kept."""
    keys = label_list(mf, by, without)
    mf = ensure_labels(mf, keys)
    if k < 1:
        return mf.with_df(mf.df.limit(0))
    if k == 1:
        # one aggregate with partial merge: min over (nan, -value, labels…)
        v = F.col(VALUE)
        s = F.struct(F.isnan(v).alias("_nan"), (-v if largest else v).alias("_o"),
                     *[F.col(l).alias("_l" + str(i)) for i, l in enumerate(mf.labels)], v.alias("_v"))
        agg = mf.df.groupBy(*keys, TS).agg(F.min(s).alias("_best"))
        out = agg.select(*[F.col("_best._l" + str(i)).alias(l) for i, l in enumerate(mf.labels)],
                         TS, F.col("_best._v").alias(VALUE))
        return mf.with_df(out)
    order = _rank_key(mf, largest)
    salt = F.pmod(F.xxhash64(*[F.col(l) for l in mf.labels]), F.lit(TOPK_SALTS)) if mf.labels else F.lit(0)
    d = mf.df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*keys, TS, "_salt").orderBy(*order)
    d = d.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    w2 = Window.partitionBy(*keys, TS).orderBy(*order)
    d = d.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k)
    return mf.with_df(d.select(*mf.labels, TS, VALUE))


def le_value(le: Column) -> Column:
    """Histogram bound label → double ('+Inf' → Infinity)."""
    t = F.lower(F.trim(le))
    return (F.when(t.isin("+inf", "inf"), F.lit(float("inf")))
            .when(t == "-inf", F.lit(float("-inf")))
            .otherwise(le.try_cast("double")))


def histogram_quantile(mf: MetricFrame, q: float, le: str = "le") -> MetricFrame:
    """φ-quantile from cumulative ``le`` buckets with linear interpolation.

    Per (labels without le, t) the buckets (a handful per histogram) are
    collected, sorted, equal bounds merged and counts made monotone; then the
    rank is located and interpolated inside the bucket – all array functions
    in the JVM.  No +Inf bucket or fewer than two buckets → NaN; a rank in the
    +Inf bucket → the largest finite bound.
    """
    keys = [l for l in mf.labels if l not in (le, NAME)]
    d = mf.df.withColumn("_b", le_value(F.col(le))).filter(F.col("_b").isNotNull())
    g = (d.groupBy(*keys, TS)
          .agg(F.array_sort(F.collect_list(F.struct(F.col("_b").alias("b"), F.col(VALUE).alias("c")))).alias("_a")))
    # merge equal bounds (array is sorted by b, then c)
    merged = F.aggregate(
        "_a", F.array().cast("array<struct<b:double,c:double>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] == x["b"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1),
                                       F.array(F.struct(x["b"].alias("b"),
                                                        (F.element_at(acc, -1)["c"] + x["c"]).alias("c")))))
                        .otherwise(F.concat(acc, F.array(x))))
    g = g.withColumn("_m", merged)
    # monotone counts: running max
    mono = F.transform("_m", lambda x, i: F.struct(
        x["b"].alias("b"),
        F.array_max(F.transform(F.slice(F.col("_m"), 1, i + 1), lambda y: y["c"])).alias("c")))
    g = g.withColumn("_m", mono)
    n = F.size("_m")
    total = F.element_at("_m", -1)["c"]
    rank = F.lit(float(q)) * total
    # index (0-based) of the first bucket among the first n-1 with count >= rank
    bi = F.size(F.filter(F.slice(F.col("_m"), 1, F.greatest(n - 1, F.lit(1))), lambda x: x["c"] < rank))
    at = lambda i: F.element_at(F.col("_m"), (i + 1).cast("int"))
    b_end = at(bi)["b"]
    b_start = F.when(bi > 0, at(bi - 1)["b"]).otherwise(F.lit(0.0))
    c_prev = F.when(bi > 0, at(bi - 1)["c"]).otherwise(F.lit(0.0))
    interp = b_start + (b_end - b_start) * ((rank - c_prev) / (at(bi)["c"] - c_prev))
    res = (F.when(F.lit(q) < 0, F.lit(float("-inf")))
            .when(F.lit(q) > 1, F.lit(float("inf")))
            .when(F.element_at("_m", -1)["b"] != F.lit(float("inf")), F.lit(NAN))
            .when(n < 2, F.lit(NAN))
            .when(total == 0, F.lit(NAN))
            .when(bi == n - 1, at(n - 2)["b"])
            .when((bi == 0) & (at(F.lit(0))["b"] <= 0), at(F.lit(0))["b"])
            .otherwise(interp))
    out = g.select(*keys, TS, res.alias(VALUE))
    return MetricFrame(out, tuple(keys))


def absent(mf: MetricFrame, grid: Grid, labels: dict | None = None) -> MetricFrame:
    """1 at every grid time where ``mf`` has no sample, labelled with the
    selector's equality matchers (A13).  Only the distinct times of ``mf`` meet
    the grid, so the anti join is between two grid-sized sides."""
    labels = labels or {}
    present = mf.df.select(TS).distinct()
    g = grid.df(mf.spark).join(present, on=TS, how="left_anti")
    out = g.select(*[F.lit(v).alias(k) for k, v in labels.items()], TS, F.lit(1.0).alias(VALUE))
    return MetricFrame(out, tuple(labels.keys()))


def histogram_avg(sum_mf: MetricFrame, count_mf: MetricFrame, rng, grid: Grid,
                  by: Sequence[str] | None = None, without: Sequence[str] | None = None) -> MetricFrame:
    """Histogram/summary mean ``sum by (..) (rate(x_sum[r])) / sum by (..) (rate(x_count[r]))``.

    Two partial-merge aggregates of the same shape joined one-to-one on (by…, t);
    no observation is ever gathered in one place."""
    from .match import binop
    from .range_fns import rate
    s = aggregate(rate(sum_mf, rng, grid), "sum", by=by, without=without)
    c = aggregate(rate(count_mf, rng, grid), "sum", by=by, without=without)
    return binop(s, c, "/")
