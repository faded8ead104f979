"""Block store of samples on Parquet.

Layout: ``<root>/resolution=<raw|5m|1h>/date=<yyyy-mm-dd>/part-*.parquet`` with
columns (metric, labels MAP, series_id, ts ms, value), files sorted by
(metric, series_id, ts).  A read derives its ``date`` range from the query
window (+ lookback) so Spark prunes partitions, and the ``metric``/``ts``
predicates reach the Parquet reader as pushed filters.
"""
from __future__ import annotations

import datetime as _dt
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import NAME, TS, VALUE, MetricFrame, duration_ms, epoch_ms
from ..operators.select import from_map

SCHEMA = "metric string, labels map<string,string>, series_id bigint, ts bigint, value double"


def sorted_labels_json(labels: Column) -> Column:
    return F.to_json(F.array_sort(F.map_entries(labels)))


def series_id(metric: Column, labels: Column) -> Column:
    """Stable 64-bit series key: hash of the name and the sorted label set."""
    return F.xxhash64(metric, sorted_labels_json(labels))


def to_samples(mf: MetricFrame, metric: str | None = None) -> DataFrame:
    """MetricFrame → stored form (labels folded back into a MAP)."""
    labels = [l for l in mf.labels if l != NAME]
    m = F.col(NAME) if NAME in mf.labels else F.lit(metric)
    lab = (F.map_filter(F.create_map(*[x for l in labels for x in (F.lit(l), F.col(l))]), lambda k, v: v != "")
           if labels else F.create_map().cast("map<string,string>"))
    d = mf.df.select(m.alias("metric"), lab.alias("labels"), F.col(TS).alias("ts"), F.col(VALUE).alias("value"))
    return d.withColumn("series_id", series_id(F.col("metric"), F.col("labels"))).select(
        "metric", "labels", "series_id", "ts", "value")


def write_samples(samples: DataFrame, root: str, resolution: str = "raw", mode: str = "append") -> None:
    """Partitioned write; rows are clustered by day and sorted by series then time."""
    d = (samples.withColumn("resolution", F.lit(resolution))
                .withColumn("date", F.to_date(F.timestamp_millis("ts"))))
    # range partitioning balances a heavy day over many tasks (a plain
    # repartition by date would put one whole day into one task)
    (d.repartitionByRange("resolution", "date", "metric", "series_id")
       .sortWithinPartitions("metric", "series_id", "ts")
       .write.mode(mode).partitionBy("resolution", "date").parquet(root))


def read_samples(spark: SparkSession, root: str, metric: str | Sequence[str] | None = None, start=None, end=None,
                 lookback="5m", resolution: str = "raw") -> DataFrame:
    """Scan a time window (S7: min/max time per reader) of one resolution."""
    d = spark.read.parquet(root).filter(F.col("resolution") == resolution)
    if start is not None:
        lo = epoch_ms(start) - duration_ms(lookback)
        d = d.filter((F.col("date") >= F.lit(_day(lo))) & (F.col("ts") >= F.lit(lo)))
    if end is not None:
        hi = epoch_ms(end)
        d = d.filter((F.col("date") <= F.lit(_day(hi))) & (F.col("ts") <= F.lit(hi)))
    if metric is not None:
        d = d.filter(F.col("metric").isin(*metric) if isinstance(metric, (list, tuple)) else (F.col("metric") == metric))
    return d.select("metric", "labels", "series_id", "ts", "value")


def _day(ms: int) -> _dt.date:
    return _dt.datetime.fromtimestamp(ms / 1000, tz=_dt.timezone.utc).date()


def frame(samples: DataFrame, labels: Sequence[str]) -> MetricFrame:
    """Stored samples → MetricFrame with the named labels promoted to columns."""
    return from_map(samples, labels, "labels", "ts", "value", "metric")


def union_stores(*frames: MetricFrame) -> MetricFrame:
    """Fan-out read over several stores (S9): union by name, labels aligned."""
    labels = list(dict.fromkeys(l for f in frames for l in f.labels))
    dfs = []
    for f in frames:
        d = f.df
        for l in labels:
            if l not in f.labels:
                d = d.withColumn(l, F.lit(""))
        dfs.append(d.select(*labels, TS, VALUE))
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return MetricFrame(out, tuple(labels))


def record(mf: MetricFrame, name: str, labels: dict | None = None) -> MetricFrame:
    """Recording-rule output (S10, P8): metric renamed, static labels set (overriding)."""
    labels = labels or {}
    d = mf.df
    keep = [l for l in mf.labels if l != NAME]
    for k, v in labels.items():
        d = d.withColumn(k, F.lit(v))
    out_labels = [NAME] + keep + [k for k in labels if k not in keep]
    d = d.withColumn(NAME, F.lit(name))
    return MetricFrame(d.select(*out_labels, TS, VALUE), tuple(out_labels))


def label_values(mf: MetricFrame, label: str) -> DataFrame:
    """Sorted distinct non-empty values of one label (S11, D12 when ``mf`` is pre-filtered)."""
    return (mf.df.select(F.col(label).alias(label)).filter(F.col(label) != "").distinct().orderBy(label))
