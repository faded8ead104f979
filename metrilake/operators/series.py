"""Exact per-series sequential helpers that stay parallel under skew.

A window partitioned by series alone puts a hot series (say a third of all
rows) into one task.  These helpers partition by (series, time bucket) instead
and repair the bucket edges with a per-bucket summary whose size is bounded by
(#series × #buckets), not by the number of samples.  The big side is joined to
that summary on the same keys it is already hash-partitioned by, so the repair
adds no shuffle of the samples.
"""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET_MS = 86_400_000  # one day


def _bucket(ts: str, bucket_ms: int) -> Column:
    return F.floor(F.col(ts) / F.lit(bucket_ms)).cast("bigint")


def running_sums(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], cols: Mapping[str, Column],
                 bucket_ms: int = DEFAULT_BUCKET_MS, bucket_col: Column | None = None) -> DataFrame:
    """Cumulative sums of ``cols`` (name of the sum -> what is summed) per ``keys`` in (ts, *order) order,
    rows-unbounded-preceding, all in one sort.

    ``bucket_col`` overrides the time bucket (any column monotone in the order).
    """
    keys = list(keys)
    b = bucket_col if bucket_col is not None else _bucket(ts, bucket_ms)
    names = {out: f"__rs_{i}" for i, out in enumerate(cols)}
    d = df.withColumns({f"{n}_c": cols[out].cast("double") for out, n in names.items()} | {"__rs_b": b})
    w = Window.partitionBy(*keys, "__rs_b").orderBy(F.col(ts), *[F.col(o) for o in order]) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({f"{n}_s": F.sum(f"{n}_c").over(w) for n in names.values()})
    # bucket totals → exclusive prefix per series (bounded: one row per series and bucket)
    tot = d.groupBy(*keys, "__rs_b").agg(*[F.sum(f"{n}_c").alias(f"{n}_t") for n in names.values()])
    wb = Window.partitionBy(*keys).orderBy("__rs_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "__rs_b", *[F.coalesce(F.sum(f"{n}_t").over(wb), F.lit(0.0)).alias(f"{n}_off") for n in names.values()])
    d = d.join(tot, on=keys + ["__rs_b"], how="inner")
    d = d.withColumns({out: F.col(f"{n}_s") + F.col(f"{n}_off") for out, n in names.items()})
    return d.drop("__rs_b", *[n + x for n in names.values() for x in ("_c", "_s", "_off")])


def running_sum(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], col: Column,
                out: str, bucket_ms: int = DEFAULT_BUCKET_MS, bucket_col: Column | None = None) -> DataFrame:
    """Cumulative sum of ``col``: ``running_sums`` of one column."""
    return running_sums(df, keys, ts, order, {out: col}, bucket_ms, bucket_col)


def series_lag(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], prefix: str = "prev_",
               bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """Previous row's ``ts`` and ``cols`` per series in the order of (ts, cols), exact across any gap."""
    keys = list(keys)
    d = df.withColumn("__rs_b", _bucket(ts, bucket_ms))
    fields = [ts] + [c for c in cols if c != ts]
    w = Window.partitionBy(*keys, "__rs_b").orderBy(*fields)       # equal timestamps in the order of their values
    d = d.withColumns({prefix + c: F.lag(c).over(w) for c in fields})
    last = d.groupBy(*keys, "__rs_b").agg(F.max(F.struct(*[F.col(c) for c in fields])).alias("__rs_last"))
    wb = Window.partitionBy(*keys).orderBy("__rs_b")
    carry = last.select(*keys, "__rs_b", F.lag("__rs_last").over(wb).alias("__rs_carry"))
    d = d.join(carry, on=keys + ["__rs_b"], how="inner")
    d = d.withColumn("__rs_first", F.col(prefix + ts).isNull())
    for c in fields:
        d = d.withColumn(prefix + c, F.when(F.col("__rs_first"), F.col("__rs_carry." + c)).otherwise(F.col(prefix + c)))
    return d.drop("__rs_b", "__rs_carry", "__rs_first")
