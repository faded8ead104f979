"""Interval join (J11): samples ↔ query/job/stage start–end annotations.

A sample matches every interval of the same key (application) with
``start <= ts <= end``.  Spark has no range-join strategy, so the range predicate
would otherwise become a nested-loop join.  Instead both sides get an equi key
on a time bucket: an interval is exploded into the buckets it overlaps, a sample
carries the bucket holding its ``ts``.  The join is then a shuffle hash /
sort-merge equi-join on ``(key, tier, bucket)`` with the exact ``BETWEEN`` test as
a residual; a sample sits in exactly one bucket per tier and an interval in one
tier, so no pair is produced twice.

Sizing: durations are heavy-tailed (a stage of seconds, a query of days), so one
bucket width cannot serve all intervals.  Tier ``t`` uses buckets of
``bucket·fanout^t`` and an interval goes to the smallest tier that covers it in at
most ``fanout`` + 1 buckets; a sample carries one bucket per tier (a handful).
The base ``bucket`` defaults to the 0.9-quantile duration, and the number of tiers
follows from the longest interval; both come from one aggregate over the interval
table (two numbers to the driver).  A hot key is spread over its buckets, and AQE's
skew-join handling splits a bucket that is still too large.
"""
from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_B, _T = "_ibucket", "_itier"


def duration_stats(intervals: DataFrame, start: str, end: str, quantile: float = 0.9) -> tuple[int, int]:
    """(quantile duration, longest duration) in ms – one distributed aggregate."""
    d = F.col(end) - F.col(start)
    r = intervals.select(F.percentile_approx(d, F.lit(quantile), F.lit(1000)).alias("q"), F.max(d).alias("m")).first()
    return int(r["q"] or 0), int(r["m"] or 0)


def choose_bucket_ms(intervals: DataFrame, start: str, end: str, quantile: float = 0.9,
                     floor_ms: int = 1000) -> int:
    """Base bucket width from the interval durations, rounded up to a whole second."""
    q, _ = duration_stats(intervals, start, end, quantile)
    return max(floor_ms, -(-q // 1000) * 1000)


def _tiers_needed(max_ms: int, bucket_ms: int, fanout: int) -> int:
    t = 0
    while max_ms > fanout * bucket_ms * fanout ** t:
        t += 1
    return t


def annotate(samples: DataFrame, intervals: DataFrame, on: Sequence[tuple[str, str]] | Sequence[str],
             ts: str = "ts", start: str = "start_ts", end: str = "end_ts",
             bucket_ms: int | None = None, how: str = "inner", fanout: int = 64) -> DataFrame:
    """Join each sample to the intervals of the same key that contain its ``ts``.

    ``on``: key columns, either names present on both sides or ``(sample_col,
    interval_col)`` pairs.  Times are epoch ms (BIGINT) on both sides, bounds
    inclusive.  ``how="left"`` keeps samples that fall in no interval (with NULL
    interval columns).  Interval key columns are dropped from the output.
    """
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in on]
    q, longest = duration_stats(intervals, start, end)
    if bucket_ms is None:
        bucket_ms = max(1000, -(-q // 1000) * 1000)
    tmax = _tiers_needed(longest, bucket_ms, fanout)
    width = lambda t: F.lit(int(bucket_ms)) * F.pow(F.lit(float(fanout)), t).cast("bigint")

    right_keys = {r for _, r in pairs}
    iv = intervals.select(*[F.col(c).alias(f"_iv_{c}") if c in right_keys else F.col(c)
                            for c in intervals.columns])
    d = (F.col(end) - F.col(start)).cast("double")
    tier = F.when(d <= F.lit(float(fanout * bucket_ms)), F.lit(0)).otherwise(
        F.ceil(F.log(d / F.lit(float(fanout * bucket_ms))) / F.lit(math.log(fanout))))
    iv = iv.withColumn(_T + "_r", F.least(F.greatest(tier, F.lit(0)), F.lit(tmax)).cast("int"))
    w = width(F.col(_T + "_r"))
    iv = iv.withColumn(_B + "_r", F.explode(F.sequence(F.floor(F.col(start) / w).cast("bigint"),
                                                       F.floor(F.col(end) / w).cast("bigint"))))
    sm = samples.withColumn(_T, F.explode(F.sequence(F.lit(0), F.lit(tmax)))) if tmax else \
        samples.withColumn(_T, F.lit(0))
    sm = sm.withColumn(_B, F.floor(F.col(ts) / width(F.col(_T))).cast("bigint"))
    cond = [sm[l] == iv[f"_iv_{r}"] for l, r in pairs] + [sm[_T] == iv[_T + "_r"], sm[_B] == iv[_B + "_r"]]
    cond.append(sm[ts].between(iv[start], iv[end]))
    if how == "inner" or not tmax:
        j = sm.join(iv.withColumn("_hit", F.lit(True)), cond, how)
    else:
        # a left join per tier emits a NULL row for every tier a sample missed: keep the
        # matches, and the tier-0 NULL row of a sample that matched in no tier at all
        j = sm.join(iv.withColumn("_hit", F.lit(True)), cond, "left")
        hits = F.count("_hit").over(Window.partitionBy(*[sm[c] for c in samples.columns]))
        j = j.withColumn("_hits", hits).filter(F.col("_hit").isNotNull() | ((F.col("_hits") == 0) & (F.col(_T) == 0)))
        j = j.drop("_hits")
    return j.drop(_B, _B + "_r", _T, _T + "_r", "_hit", *[f"_iv_{r}" for r in right_keys])
