"""Element-wise arithmetic, comparisons and scalar helpers: P4–P14.

Float semantics follow the query language, not Spark SQL: x/0 is ±Inf, 0/0 is
NaN, and every comparison with NaN is false (Spark orders NaN above all
numbers, so comparisons are guarded).
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import NAN, NAME, TS, VALUE, Grid, MetricFrame, fdiv


@dataclass(frozen=True)
class Scalar:
    """A scalar per evaluation time (``scalar()``, ``time()``): columns ts, value.

    Its size is the grid's, so joining it is a broadcast of a bounded table.
    """
    df: DataFrame


ARITH = ("+", "-", "*", "/", "^")
COMPARE = ("==", "!=", ">", "<", ">=", "<=")


def apply_arith(op: str, a: Column, b: Column) -> Column:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return fdiv(a, b)
    if op == "^":
        return F.pow(a, b)
    raise ValueError(op)


def apply_compare(op: str, a: Column, b: Column) -> Column:
    ok = ~F.isnan(a) & ~F.isnan(b)
    c = {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    if op == "!=":
        # NaN != x is true in IEEE terms
        return F.isnan(a) | F.isnan(b) | c
    return ok & c


def _labels_wo_name(mf: MetricFrame) -> tuple[str, ...]:
    return tuple(l for l in mf.labels if l != NAME)


def scalar_op(mf: MetricFrame, op: str, s, scalar_left: bool = False, bool_: bool = False) -> MetricFrame:
    """vector ⊕ scalar (or scalar ⊕ vector with ``scalar_left``); s is a number or :class:`Scalar`."""
    df = mf.df
    if isinstance(s, Scalar):
        df = df.join(s.df.withColumnRenamed(VALUE, "_s"), on=TS, how="inner")
        sv = F.col("_s")
    else:
        sv = F.lit(float(s))
    v = F.col(VALUE)
    a, b = (sv, v) if scalar_left else (v, sv)
    if op in ARITH:
        labels = _labels_wo_name(mf)
        out = df.select(*labels, TS, apply_arith(op, a, b).alias(VALUE))
        return MetricFrame(out, labels)
    cond = apply_compare(op, a, b)
    if bool_:
        labels = _labels_wo_name(mf)
        out = df.select(*labels, TS, F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)).alias(VALUE))
        return MetricFrame(out, labels)
    # filter keeps the vector element's value and its metric name
    return MetricFrame(df.filter(cond).select(*mf.labels, TS, VALUE), mf.labels)


def where_value(mf: MetricFrame, op: str, x, bool_: bool = False) -> MetricFrame:
    """``v > 0.9`` (P5); chain calls for ``> 0.9 < 1`` (P6); ``bool_`` maps to 0/1."""
    return scalar_op(mf, op, x, bool_=bool_)


def compare_bool(mf: MetricFrame, op: str, x) -> MetricFrame:
    return scalar_op(mf, op, x, bool_=True)


def neg(mf: MetricFrame) -> MetricFrame:
    labels = _labels_wo_name(mf)
    return MetricFrame(mf.df.select(*labels, TS, (-F.col(VALUE)).alias(VALUE)), labels)


def clamp_min(mf: MetricFrame, lo: float) -> MetricFrame:
    """max(v, lo); NaN stays NaN."""
    v = F.col(VALUE)
    labels = _labels_wo_name(mf)
    out = mf.df.select(*labels, TS, F.when(F.isnan(v), v).otherwise(F.greatest(v, F.lit(float(lo)))).alias(VALUE))
    return MetricFrame(out, labels)


def ceil(mf: MetricFrame) -> MetricFrame:
    """Round up to an integer, result stays DOUBLE."""
    v = F.col(VALUE)
    labels = _labels_wo_name(mf)
    res = F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), v).otherwise(F.ceil(v).cast("double"))
    return MetricFrame(mf.df.select(*labels, TS, res.alias(VALUE)), labels)


def label_replace(mf: MetricFrame, dst: str, replacement: str, src: str, regex: str) -> MetricFrame:
    """Set ``dst`` to ``replacement`` (with $1 groups) when ``src`` fully matches."""
    from ..frame import ensure_labels
    mf = ensure_labels(mf, [src, dst])
    pat = f"^(?:{regex})$"
    newv = F.when(F.col(src).rlike(pat), F.regexp_replace(F.col(src), pat, _java_repl(replacement))) \
        .otherwise(F.col(dst))
    return mf.with_df(mf.df.withColumn(dst, newv))


def _java_repl(r: str) -> str:
    """``${1}`` → ``$1`` (Java's replacement syntax has no braces for numbers)."""
    import re
    return re.sub(r"\$\{(\d+)\}", r"$\1", r)


def time_(spark: SparkSession, grid: Grid) -> Scalar:
    """``time()``: evaluation time in seconds (P10)."""
    return Scalar(grid.df(spark).select(TS, (F.col(TS) / F.lit(1000.0)).alias(VALUE)))


def vector(spark: SparkSession, grid: Grid, s) -> MetricFrame:
    """``vector(s)``: one label-less element per grid time."""
    if isinstance(s, Scalar):
        return MetricFrame(s.df.select(TS, VALUE), ())
    return MetricFrame(grid.df(spark).select(TS, F.lit(float(s)).alias(VALUE)), ())


def scalar(mf: MetricFrame, grid: Grid) -> Scalar:
    """``scalar(v)``: the value when v has exactly one element at t, else NaN."""
    per_t = mf.df.groupBy(TS).agg(F.count(F.lit(1)).alias("_n"), F.max(VALUE).alias("_v"))
    g = grid.df(mf.spark).join(per_t, on=TS, how="left")
    return Scalar(g.select(TS, F.when(F.col("_n") == 1, F.col("_v")).otherwise(F.lit(NAN)).alias(VALUE)))


def eval_time(mf: MetricFrame) -> MetricFrame:
    labels = _labels_wo_name(mf)
    return MetricFrame(mf.df.select(*labels, TS, (F.col(TS) / F.lit(1000.0)).alias(VALUE)), labels)
