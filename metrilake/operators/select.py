"""Selectors (P1–P3), the as-of instant selector (J10) and frame construction."""
from __future__ import annotations

import re
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NAME, TS, VALUE, Grid, MetricFrame, duration_ms, ensure_labels, to_ms
from ..functions.matchers import predicate

DEFAULT_LOOKBACK = "5m"


def from_table(df: DataFrame, labels: Sequence[str], ts: str = "ts", value: str = "value",
               metric: str | None = None) -> MetricFrame:
    """Promote table columns to a sample frame.

    Labels become strings with "" for absent, the time column becomes epoch ms.
    """
    dtype = df.schema[ts].dataType.typeName()
    if dtype in ("long", "integer"):
        tcol = F.col(ts).cast("bigint")
    else:
        tcol = to_ms(ts, "timestamp_ntz" if dtype == "timestamp_ntz" else "timestamp")
    cols = [F.coalesce(F.col(l).cast("string"), F.lit("")).alias(l) for l in labels]
    out_labels = list(labels)
    if metric is not None:
        cols = [F.lit(metric).alias(NAME)] + cols
        out_labels = [NAME] + out_labels
    out = df.select(*cols, tcol.alias(TS), F.col(value).cast("double").alias(VALUE))
    return MetricFrame(out, tuple(out_labels))


def from_map(df: DataFrame, labels: Sequence[str], labels_col: str = "labels", ts: str = "ts",
             value: str = "value", metric_col: str | None = "metric") -> MetricFrame:
    """Samples stored with a MAP<STRING,STRING> label column → promoted columns."""
    proj = {l: F.coalesce(F.col(labels_col)[l], F.lit("")) for l in labels}
    if metric_col:
        proj = {NAME: F.col(metric_col), **proj}
    tmp = df.select(*[c.alias(k) for k, c in proj.items()], F.col(ts).alias("_t"), F.col(value).alias("_v"))
    return from_table(tmp.withColumnRenamed("_t", TS).withColumnRenamed("_v", VALUE), list(proj.keys()))


def select(mf: MetricFrame, eq: Mapping[str, str] | None = None, ne: Mapping[str, str] | None = None,
           re: Mapping[str, str] | None = None, nre: Mapping[str, str] | None = None,
           metric: str | None = None) -> MetricFrame:
    """Label matchers. Matching a label the frame does not carry treats it as ""."""
    names = set((eq or {}).keys()) | set((ne or {}).keys()) | set((re or {}).keys()) | set((nre or {}).keys())
    mf = ensure_labels(mf, sorted(names - set(mf.labels)))
    cond = predicate(eq, ne, re, nre)
    if metric is not None:
        cond = cond & (F.col(NAME) == metric)
    return mf.with_df(mf.df.filter(cond))


_ESCAPE = re.compile(r"[\\.^$|?*+()\[\]{}]")


def bind(values: Mapping[str, object]) -> dict:
    """Dashboard variables → matcher kwargs.

    ``{"cluster": "a"}`` → eq; a list → regex alternation of its escaped values; ``None`` or ``"$__all"``
    (the "All" choice, ``.*``) → no matcher at all.
    """
    eq, re_ = {}, {}
    for k, v in values.items():
        if v is None or v == "$__all" or v == ".*":
            continue
        if isinstance(v, (list, tuple)):
            re_[k] = "|".join(_ESCAPE.sub(r"\\\g<0>", str(x)) for x in v)
        else:
            eq[k] = str(v)
    return {"eq": eq, "re": re_}


def time_bounds(mf: MetricFrame, lo: int, hi: int) -> MetricFrame:
    """Keep samples with lo <= ts <= hi (pushes into the scan as a range on ts)."""
    return mf.with_df(mf.df.filter((F.col(TS) >= F.lit(lo)) & (F.col(TS) <= F.lit(hi))))


def instant(mf: MetricFrame, grid: Grid, lookback=DEFAULT_LOOKBACK) -> MetricFrame:
    """As-of selection: at each grid time t the newest sample in (t - lookback, t].

    A slot is what lies between two grid points.  Its newest sample (merged
    map-side, so a hot series shuffles a row a slot and map task) serves the grid
    points from the slot's end to the next slot that holds a sample, or as long
    as the lookback reaches.  The next slot is looked for inside blocks of
    a lookback's slots, of which a group holds two of one series.
    """
    lb = duration_ms(lookback)
    ts, keys = F.col(TS), list(mf.labels)
    df = mf.df.filter((ts > F.lit(grid.start - lb)) & (ts <= F.lit(grid.end)))
    j = F.greatest(F.lit(0).cast("bigint"), F.ceil((ts - F.lit(grid.start)) / F.lit(grid.step)).cast("bigint"))
    s = df.select(*keys, TS, VALUE, j.alias("_j")).groupBy(*keys, "_j").agg(F.max(F.struct(TS, VALUE)).alias("_s"))
    reach = F.least(F.floor((F.col("_s." + TS) + F.lit(lb - 1 - grid.start)) / F.lit(grid.step)).cast("bigint"),
                    F.lit(grid.n - 1).cast("bigint"))
    if grid.n > 1 and lb > grid.step:
        m = F.lit(lb // grid.step + 1)
        s = s.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_ahead"))     # a slot is also seen from the block before
        s = s.withColumn("_B", F.floor(F.col("_j") / m).cast("bigint") - F.col("_ahead"))
        s = s.withColumn("_next", F.lead("_j").over(Window.partitionBy(*keys, "_B").orderBy("_j"))).filter("_ahead = 0")
        reach = F.least(reach, F.col("_next") - 1)
    s = s.withColumn("_reach", reach).filter("_j <= _reach")
    out = s.select(*keys, F.explode(F.sequence("_j", "_reach")).alias("_k"), "_s").select(
        *keys, grid.ts_of(F.col("_k")).alias(TS), F.col("_s." + VALUE).alias(VALUE))
    return MetricFrame(out, mf.labels)
