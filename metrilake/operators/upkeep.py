"""Long-term store upkeep: T1–T12.

Replica de-duplication and downsampling are grouped aggregations keyed by
(series, time slot) – partial merge on the map side, and a hot series spreads
over its slots.  Block-level policies (retention, size budget, consistency
delay, delete marks) work on a block metadata frame, one row per block.
"""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NAME, TS, VALUE, Grid, MetricFrame, duration_ms, epoch_ms
from .relabel import hash_mod
from .range_fns import monotonic


def dedup_replicas(mf: MetricFrame, replica_labels: Sequence[str], slot="15s") -> MetricFrame:
    """Merge replicas of a series (T1): replica labels dropped; in each time slot
    the sample of the first replica (label order) present wins, so a gap in
    one replica is filled by another."""
    s = duration_ms(slot)
    reps = [r for r in replica_labels if r in mf.labels]
    keys = [l for l in mf.labels if l not in reps]
    rep = F.concat_ws("\u0001", *[F.col(r) for r in reps]) if reps else F.lit("")
    d = (mf.df.withColumn("_slot", F.floor(F.col(TS) / F.lit(s)).cast("bigint"))
         .groupBy(*keys, "_slot")
         .agg(F.min(F.struct(rep.alias("r"), F.col(TS).alias("t"), F.col(VALUE).alias("v"))).alias("_w")))
    return MetricFrame(d.select(*keys, F.col("_w.t").alias(TS), F.col("_w.v").alias(VALUE)), tuple(keys))


def downsample(mf: MetricFrame, resolution="5m", counter: bool = True) -> DataFrame:
    """Per series and slot: count, sum, min, max and the reset-corrected counter.

    Output rows are (labels, ts = slot start, count, sum, min, max, counter).
    """
    r = duration_ms(resolution)
    base = monotonic(mf) if counter else mf
    real = F.when(~F.isnan(VALUE), F.col(VALUE))  # a NaN loses to any number
    nan = F.when(F.count(VALUE) > 0, F.lit(float("nan")))
    d = (base.df.withColumn("_slot", (F.floor(F.col(TS) / F.lit(r)) * F.lit(r)).cast("bigint"))
         .groupBy(*mf.labels, "_slot")
         .agg(F.count(F.lit(1)).alias("count"), F.sum(VALUE).alias("sum"), F.coalesce(F.min(real), nan).alias("min"),
              F.coalesce(F.max(real), nan).alias("max"), F.max(F.struct(F.col(TS), F.col(VALUE)))[VALUE].alias("counter")))
    return d.select(*mf.labels, F.col("_slot").alias(TS), "count", "sum", "min", "max", "counter")


def _real(fn, c: str):
    """min or max over numbers; NaN only where there is nothing else."""
    return F.coalesce(fn(F.when(~F.isnan(c), F.col(c))), F.when(F.count(c) > 0, F.lit(float("nan"))))


def rollup(agg: DataFrame, labels: Sequence[str], resolution="1h") -> DataFrame:
    """Coarser level from a downsampled one (1h from 5m) without touching raw data."""
    r = duration_ms(resolution)
    d = (agg.withColumn("_slot", (F.floor(F.col(TS) / F.lit(r)) * F.lit(r)).cast("bigint"))
         .groupBy(*labels, "_slot")
         .agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), _real(F.min, "min").alias("min"),
              _real(F.max, "max").alias("max"), F.max(F.struct(F.col(TS), F.col("counter")))["counter"].alias("counter")))
    return d.select(*labels, F.col("_slot").alias(TS), "count", "sum", "min", "max", "counter")


def pick_resolution(step) -> str:
    """Coarsest level whose slot is at most a fifth of the query step."""
    s = duration_ms(step)
    if s // 5 >= duration_ms("1h"):
        return "1h"
    if s // 5 >= duration_ms("5m"):
        return "5m"
    return "raw"


def block_meta(samples: DataFrame, resolution_col: Column | None = None, bytes_per_sample: int = 16) -> DataFrame:
    """One row per (resolution, day) block: min/max time, samples, bytes estimate."""
    res = resolution_col if resolution_col is not None else F.lit("raw")
    d = samples.withColumn("resolution", res).withColumn("date", F.to_date(F.timestamp_millis(TS)))
    return (d.groupBy("resolution", "date")
             .agg(F.min(TS).alias("min_ts"), F.max(TS).alias("max_ts"), F.count(F.lit(1)).alias("samples"))
             .withColumn("bytes", F.col("samples") * F.lit(bytes_per_sample)))


def expired(meta: DataFrame, policy: Mapping[str, str], now) -> DataFrame:
    """Blocks whose newest sample is older than their resolution's retention (T4)."""
    n = epoch_ms(now)
    lim = F.create_map(*[x for k, v in policy.items() for x in (F.lit(k), F.lit(duration_ms(v)))])
    return meta.filter(F.col("max_ts") < F.lit(n) - lim[F.col("resolution")])


def retain_bytes(meta: DataFrame, limit: int, partition: Sequence[str] = ("resolution",)) -> DataFrame:
    """Size budget (T5): newest blocks are kept while the running total fits; returns the blocks to delete.

    The window is per resolution over block rows (bounded by retention / block length).
    """
    w = Window.partitionBy(*partition).orderBy(F.desc("max_ts"), F.desc("date")) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return meta.withColumn("running_bytes", F.sum("bytes").over(w)).filter(F.col("running_bytes") > F.lit(limit))


def settled(df: DataFrame, now, delay="30m", ingest_col: str = "uploaded_ts") -> DataFrame:
    """Ignore blocks/samples younger than the consistency delay."""
    return df.filter(F.col(ingest_col) <= F.lit(epoch_ms(now) - duration_ms(delay)))


def compact(mf: MetricFrame, partitions: int | None = None) -> MetricFrame:
    """Merge overlapping blocks (T7): one sample per (series, ts), clustered by series
    and sorted by time, ready to be written as one block.  Where blocks disagree the
    larger value stays, a NaN only if there is no number."""
    d = mf.df.groupBy(*mf.labels, TS).agg(_real(F.max, VALUE).alias(VALUE))
    d = d.repartitionByRange(*([partitions] if partitions else []), *mf.labels, TS) \
        .sortWithinPartitions(*mf.labels, TS)
    return mf.with_df(d)


def visible_blocks(meta: DataFrame, marks: DataFrame, now, delay="24h", key: str = "block_id") -> DataFrame:
    """Blocks still served (T8): not deletion-marked, or marked less than ``delay`` ago."""
    cut = epoch_ms(now) - duration_ms(delay)
    gone = marks.filter(F.col("deletion_mark_ts") <= F.lit(cut)).select(key)
    return meta.join(gone, on=key, how="left_anti")


def shard(mf: MetricFrame, n: int, labels: Sequence[str] | None = None) -> MetricFrame:
    """Hash shard per series (T9): ``hashmod`` of the label values, then co-partitioned."""
    labs = list(labels or mf.labels)
    key = F.concat_ws(";", *[F.col(l) for l in labs])
    d = mf.df.withColumn("shard", hash_mod(key, n))
    return MetricFrame(d.repartition(n, "shard"), mf.labels + ("shard",))


def route_tenants(mf: MetricFrame, rings: Sequence[Mapping], tenant: str = "tenant", rf: int = 1) -> MetricFrame:
    """Tenant → hashring → endpoint(s).

    ``rings`` is the ring configuration: ``[{"hashring", "tenants": [...],
    "endpoints": [...]}]``; a ring with an empty tenant list is the default.
    Being configuration, it is compiled into literal map lookups – no join.
    The endpoint is ``hash(series) mod |ring|``; replication factor ``rf``
    adds the next ``rf-1`` endpoints of the ring (an explode of ``rf`` rows).
    """
    t2r = {t: r["hashring"] for r in rings for t in r.get("tenants") or []}
    dflt = next((r["hashring"] for r in rings if not r.get("tenants")), None)
    r2e = {r["hashring"]: r["endpoints"] for r in rings}
    tmap = F.create_map(*[x for k, v in t2r.items() for x in (F.lit(k), F.lit(v))]) if t2r else None
    ring = F.coalesce(tmap[F.col(tenant)], F.lit(dflt)) if tmap is not None else F.lit(dflt)
    emap = F.create_map(*[x for k, v in r2e.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    ends = emap[ring]
    key = F.concat_ws(";", *[F.col(l) for l in mf.labels])
    h = hash_mod(key, 1 << 30)
    d = mf.df.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(rf - 1))))
    idx = F.pmod(h + F.col("_r"), F.size(ends))
    d = d.withColumn("hashring", ring).withColumn("endpoint", F.element_at(ends, (idx + 1).cast("int")))
    cols = list(mf.labels) + ["hashring", "endpoint"]
    return MetricFrame(d.select(*cols, TS, VALUE), tuple(cols))


def backfill(evaluate, start, end, step) -> MetricFrame:
    """Evaluate a rule (or group) over history on its own step grid."""
    return evaluate(Grid.range(start, end, step))
