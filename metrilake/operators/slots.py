"""Windows [t - range, t] of a series from mergeable summaries of its slots.

Every sample goes through one shuffle, whatever range and step are:

1. the grid's axis is cut into slots (t_{j-1}, t_j] that divide step and range,
   and each (series, slot) becomes one summary.  Order-free parts (count, sum,
   extremes, last sample, centred co-moments) are merged map-side; the parts
   that need the samples' order (drops and changes between neighbours, the last
   but one) take ``lag`` inside the slot, with equal timestamps in the order of
   their values;
2. with m slots a range, slots are put into blocks of m.  Window k of block B
   holds the slots of block B up to k and those of block B - 1 from k - m + 1: a
   running merge from the front and one from the back, the two stacks of a
   sliding aggregation.  A slot is read in its own block, where it enters at
   k = j, and in the next one, where it leaves at k = j + m, so a group is two
   blocks of one series at most.  The drop between neighbouring slots belongs to
   the later one and is taken off where that one comes first in its window;
3. between two such events a window's merge does not change, so only there are
   rows filled in: empty stretches of a series cost nothing.

A window also holds the samples exactly at t - range: those on the right edge of
the slot that leaves at k.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NAN, TS, VALUE, Grid, MetricFrame

LEAST_SLOTS = 16      # slots of a range, if it can be cut so: a hot series' samples are in as many groups
CUTS = (40, 20, 16, 10, 8, 5, 4, 2, 1)

#: Parts of a summary: how two are merged.
MERGE = {"n": F.sum, "sum": F.sum, "nans": F.sum, "min": F.min, "max": F.max, "first": F.min, "last": F.max,
         "drops": F.sum, "changes": F.sum, "sx": F.sum, "sy": F.sum, "sxx": F.sum, "sxy": F.sum}
#: Parts that need the samples of a slot in order; "prev" asks for the sample before the last one.
ORDERED = {"drops", "changes", "prev"}
MOMENTS = {"sx", "sy", "sxx", "sxy"}


def _width(grid: Grid, rng: int) -> tuple[int, int]:
    """Slot width in ms and slots a step (0: the grid is one point)."""
    base = rng if grid.n == 1 else math.gcd(grid.step, rng)
    least = -(-LEAST_SLOTS * base // rng)
    cut = min((c for c in CUTS if base % c == 0 and c >= least), default=max(c for c in CUTS if base % c == 0))
    width = base // cut
    return width, 0 if grid.n == 1 else grid.step // width


def _two(a: Column, b: Column, how) -> Column:
    """Merge of two partial results, either of which may be null."""
    if how is F.sum:
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return (F.least if how is F.min else F.greatest)(a, b)


@dataclass(frozen=True)
class SlotFrame(MetricFrame):
    """Summaries of a frame's slots, a row per (series, slot ``_j``), for windows of any range that ``width`` divides."""

    start: int = 0
    width: int = 1
    parts: frozenset = frozenset()


def _all_parts(parts: set[str]) -> set[str]:
    ordered, moments = bool(parts & ORDERED), bool(parts & MOMENTS)
    return {"n"} | parts - {"prev"} | ({"first", "last"} if ordered else set()) | (MOMENTS if moments else set())


def slot_frame(mf: MetricFrame, grid: Grid, width: int, parts: set[str]) -> MetricFrame:
    """The summaries of all slots of ``width`` ms up to the grid's end: what windows of several ranges share."""
    return mf if mf.empty else SlotFrame(_summaries(mf, grid, width, parts), mf.labels, False, grid.start, width, frozenset(parts))


def _summaries(mf: MetricFrame, grid: Grid, width: int, parts: set[str], begin: int | None = None) -> DataFrame:
    """One row per (series, slot) of the samples from ``begin`` on: ``_j``, the parts of all samples and, as ``E_``, of
    those on the slot's right edge."""
    keys = list(mf.labels)
    ts, v = F.col(TS), F.col(VALUE)
    ordered, moments = bool(parts & ORDERED), bool(parts & MOMENTS)
    parts, start = _all_parts(parts), grid.start
    # slot j ends at start + j * width; samples up to t - range can lie in slots below zero
    inside = ts <= F.lit(grid.end)
    d = mf.df.filter(inside if begin is None else (ts >= F.lit(begin)) & inside).select(
        *keys, TS, VALUE, F.ceil((ts - F.lit(start)) / F.lit(width)).cast("bigint").alias("_j"))
    right = F.lit(start) + F.col("_j") * F.lit(width)
    on = ts == right
    if ordered:
        w = Window.partitionBy(*keys, "_j").orderBy(TS, VALUE)
        d = d.withColumns({"_pv": F.lag(VALUE).over(w), "_pt": F.lag(TS).over(w)})
    pv = F.col("_pv")
    real = F.when(~F.isnan(v), v)
    sample = F.struct(ts.alias("ts"), v.alias("v"))
    x = (ts - right) / F.lit(1000.0)
    # the samples on the right edge alone share a timestamp and are in the order of their values
    tied = on & (F.col("_pt") == ts)
    before = lambda t, p: [t.alias("pts"), p.alias("pv")] if ordered else []
    slot = {
        "n": lambda: F.count(v), "sum": lambda: F.sum(v), "nans": lambda: F.sum(F.isnan(v).cast("int")), "min": lambda: F.min(real), "max": lambda: F.max(real),
        "first": lambda: F.min(sample),
        "last": lambda: F.max(F.struct(ts.alias("ts"), v.alias("v"), *before(F.col("_pt"), pv))),
        "drops": lambda: F.sum(F.when(pv.isNotNull() & (v < pv), pv).otherwise(F.lit(0.0))),
        "changes": lambda: F.sum(F.when(pv.isNotNull() & (v != pv), F.lit(1)).otherwise(F.lit(0))),
    }
    edge = {
        "n": lambda: F.count(F.when(on, v)), "sum": lambda: F.sum(F.when(on, v)), "nans": lambda: F.sum(F.when(on, F.isnan(v).cast("int"))),
        "min": lambda: F.min(F.when(on, real)), "max": lambda: F.max(F.when(on, real)), "first": lambda: F.min(F.when(on, sample)),
        "last": lambda: F.max(F.when(on, F.struct(ts.alias("ts"), v.alias("v"), *before(F.when(tied, ts), F.when(tied, pv))))),
        "drops": lambda: F.sum(F.when(tied & (v < pv), pv).otherwise(F.lit(0.0))),
        "changes": lambda: F.sum(F.when(tied & (v != pv), F.lit(1)).otherwise(F.lit(0))),
    }
    plain = sorted(parts - MOMENTS)
    aggs = [slot[p]().alias(p) for p in plain] + [edge[p]().alias("E_" + p) for p in plain]
    if moments:
        one = F.when(on, v)
        aggs += [F.avg(x).alias("mx"), F.avg(v).alias("my"), F.var_pop(x).alias("vx"), F.covar_pop(x, v).alias("cxy"), F.sum(one).alias("E_sy")]
    return d.groupBy(*keys, "_j").agg(*aggs)


def window_table(mf: MetricFrame, grid: Grid, rng: int, parts: set[str]) -> DataFrame:
    """One row per (series, k) whose window [t_k - rng, t_k] holds a sample: labels, ``_k``, ``n`` and the ``parts``.

    first, last: struct(ts, v), the last one with pts and pv of the sample before it where an ordered part is asked for;
    drops: sum of the values before counter drops; changes: how often neighbours differ; sum, min, max (without NaN),
    nans; sx, sy, sxx, sxy: sums of (x, y, x², x·y) for x in seconds from ``x0`` (epoch ms) and y from ``y0``.
    ``mf`` may be a ``SlotFrame`` of the grid, whose slots divide range and step.
    """
    keys = list(mf.labels)
    if mf.empty:
        return _no_windows(mf, parts)
    start = grid.start
    ts = F.col(TS)
    ordered, moments = bool(parts & ORDERED), bool(parts & MOMENTS)
    if isinstance(mf, SlotFrame):
        width, per = mf.width, 0 if grid.n == 1 else grid.step // mf.width
        if mf.start != start or rng % width or grid.n > 1 and grid.step % width or not parts <= mf.parts:
            raise ValueError("the slots are not of this grid, range or parts")
        m = rng // width
        s = mf.df.filter(F.col("_j") >= F.lit(-m))          # of slot -m only the right edge is in a window
    else:
        width, per = _width(grid, rng)
        m = rng // width
        s = _summaries(mf, grid, width, parts, start - rng)
    parts = _all_parts(parts)
    right = F.lit(start) + F.col("_j") * F.lit(width)

    # ---- blocks: a slot enters its own at k = j and leaves the next at k = j + m
    s = s.withColumn("_out", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns(
        {"_B": F.floor(F.col("_j") / F.lit(m)).cast("bigint") + F.col("_out"), "_at": F.col("_j") + F.col("_out") * F.lit(m)})
    group = [*keys, "_B"]
    leaves = F.col("_out") == 1
    in_order = Window.partitionBy(*group).orderBy("_j")
    if moments:  # x from the block's first point, y from the mean of its first slot, so that sums stay small
        s = s.withColumns({"x0": F.lit(start) + F.col("_B") * F.lit(m * width), "y0": F.first("my").over(in_order)})
        shift = (right - F.col("x0")) / F.lit(1000.0)
        mx, my, n = F.col("mx") + shift, F.col("my") - F.col("y0"), F.col("n")
        s = s.withColumns({"sx": n * mx, "sy": n * my, "sxx": n * (F.col("vx") + mx * mx), "sxy": n * (F.col("cxy") + mx * my),
                           "E_sx": F.col("E_n") * shift, "E_sxx": F.col("E_n") * shift * shift})
        s = s.withColumn("E_sy", F.col("E_sy") - F.col("E_n") * F.col("y0")).withColumn("E_sxy", F.col("E_sy") * shift)
    if ordered:
        s = s.withColumn("_prev", F.lag("last").over(in_order))
        pair = F.col("_prev").isNotNull()
        drop = F.when(pair & (F.col("first.v") < F.col("_prev.v")), F.col("_prev.v")).otherwise(F.lit(0.0))
        change = F.when(pair & (F.col("first.v") != F.col("_prev.v")), F.lit(1)).otherwise(F.lit(0))
        s = s.withColumn("first", F.struct("first.ts", "first.v", drop.alias("drops"), change.alias("changes")))
        before = F.struct(           # the sample before a slot's last one: inside the slot, else the last of the slot before
            "last.ts", "last.v", F.coalesce(F.col("last.pts"), F.col("_prev.ts")).alias("pts"),
            F.when(F.col("last.pts").isNotNull(), F.col("last.pv")).otherwise(F.col("_prev.v")).alias("pv"))
        s = s.withColumns({p: F.col(p) + F.col("first." + p) for p in ("drops", "changes") if p in parts} | {"last": before})
    events = Window.partitionBy(*group).orderBy("_at", "_out")
    front = Window.partitionBy(*group).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(*group).orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {"_next": F.lead("_at").over(events), "_lead": F.row_number().over(events) == 1}
        | {"N_" + p: F.lead(p).over(events) for p in sorted(parts)}       # where a slot enters as another leaves, the latter
        | {"P_" + p: MERGE[p](F.when(~leaves, F.col(p))).over(front) for p in sorted(parts)}
        | {"Q_" + p: MERGE[p](F.when(leaves, F.col(p))).over(back) for p in sorted(parts)})

    # ---- what windows merge to before a block's first event (A), from an event on (I), and at it where a slot leaves (H)
    merged = {}
    for p in sorted(parts):
        leaving = F.when(leaves, F.col(p)).when(F.col("_next") == F.col("_at"), F.col("N_" + p))
        merged["A_" + p] = _two(leaving, F.col("Q_" + p), MERGE[p])
        merged["I_" + p] = _two(F.col("P_" + p), F.col("Q_" + p), MERGE[p])
    s = s.withColumns(merged)
    at_edge = {p: _two(F.col("I_" + p), F.col("E_" + p), MERGE[p]) for p in parts - {"first", "last"}}
    if "first" in parts:       # what lies between the first slot and one before the window is taken off
        own = sorted({"drops", "changes"} & parts)
        s = s.withColumns({"H_" + p: c for p, c in at_edge.items()} | {"H_first": F.col("E_first"), "H_last": F.coalesce(F.col("I_last"), F.col("E_last"))})
        s = s.withColumns({f"{v}_{p}": F.col(f"{v}_{p}") - F.coalesce(F.col(f"{v}_first.{p}"), F.lit(0)) for v in "AI" for p in own}
                          | {f"{v}_first": F.struct(f"{v}_first.ts", f"{v}_first.v") for v in "AI"})
    else:
        s = s.withColumns({"H_" + p: c for p, c in at_edge.items()} | ({"H_last": F.coalesce(F.col("I_last"), F.col("E_last"))} if "last" in parts else {}))

    # ---- pieces between events: from the block's first point to the first event, at an event, behind it up to the next.
    # They leave a generator as attributes, so what is computed from windows never repeats the merges above.
    edge = leaves & (F.col("E_n") > 0)
    end = F.coalesce(F.col("_next"), (F.col("_B") + 1) * F.lit(m)) - F.lit(1)

    def piece(v: str, low: Column, high: Column) -> Column:
        if per:
            low, high = F.ceil(low / F.lit(per)).cast("bigint"), F.floor(high / F.lit(per)).cast("bigint")
        return F.struct(F.greatest(low, F.lit(0).cast("bigint")).alias("low"), F.least(high, F.lit(grid.n - 1).cast("bigint")).alias("high"),
                        *[F.col(f"{v}_{p}").alias(p) for p in sorted(parts)])

    s = s.select(*keys, *(["x0", "y0"] if moments else []), F.explode(F.array(
        F.when(F.col("_lead"), piece("A", F.col("_B") * F.lit(m), F.col("_at") - 1)), F.when(edge, piece("H", F.col("_at"), F.col("_at"))),
        piece("I", F.when(edge, F.col("_at") + 1).otherwise(F.col("_at")), end))).alias("_w")).filter("_w.low <= _w.high and _w.n > 0")
    return s.select(*keys, F.explode(F.sequence("_w.low", "_w.high")).alias("_k"), *[F.col("_w." + p).alias(p) for p in sorted(parts)], *(["x0", "y0"] if moments else []))


def _no_windows(mf: MetricFrame, parts: set[str]) -> DataFrame:
    """The windows of a frame without samples: none, with their columns."""
    ends = "struct<ts: bigint, v: double" + (", pts: bigint, pv: double>" if parts & ORDERED else ">")
    kinds = {"first": "struct<ts: bigint, v: double>", "last": ends, "x0": "bigint", "n": "bigint", "_k": "bigint"}
    names = ["_k", "n", *sorted(set(MERGE) - {"n"}), "x0", "y0"]
    return mf.df.select(*mf.labels, *[F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in names])


def nan_aware(real: Column, nans: Column) -> Column:
    """NaN loses to any number; a window of nothing but NaN gives NaN."""
    return F.when(real.isNull() & (nans > 0), F.lit(NAN)).otherwise(real)
