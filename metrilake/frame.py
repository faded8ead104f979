"""MetricFrame, evaluation grid and the column helpers shared by all operators.

Data model
----------
A *sample frame* holds one row per sample: label columns (strings; an absent
label is ``""`` exactly as in the label-matching semantics, never NULL, so all
label joins are plain equi-joins that keep Spark's hash partitioning), an
epoch-millisecond ``ts`` (BIGINT) and a DOUBLE ``value``.  The metric name, when
kept, is the ordinary label column ``__name__``.

An *evaluated vector* has the same shape; its ``ts`` is the evaluation time of
the grid point.  Operators take and return :class:`MetricFrame`, a thin pair of
(DataFrame, label column names).
"""
from __future__ import annotations

import datetime as _dt
import re
from dataclasses import dataclass
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TS = "ts"
VALUE = "value"
NAME = "__name__"

_DUR = re.compile(r"(\d+(?:\.\d+)?)(ms|s|m|h|d|w|y)")
_UNIT_MS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000,
            "w": 7 * 86_400_000, "y": 365 * 86_400_000}


def duration_ms(d) -> int:
    """'5m' / '1h30m' / '30d' / 300 (seconds) → milliseconds."""
    if isinstance(d, (int, float)):
        return int(d * 1000)
    if isinstance(d, _dt.timedelta):
        return int(d.total_seconds() * 1000)
    s = d.strip()
    pos, total = 0, 0
    for m in _DUR.finditer(s):
        if m.start() != pos:
            raise ValueError(f"bad duration {d!r}")
        total += float(m.group(1)) * _UNIT_MS[m.group(2)]
        pos = m.end()
    if pos != len(s) or not s:
        raise ValueError(f"bad duration {d!r}")
    return int(total)


def epoch_ms(t) -> int:
    """datetime / ISO string / epoch-ms int → epoch ms (naive datetimes are UTC)."""
    if isinstance(t, (int, float)):
        return int(t)
    if isinstance(t, str):
        t = _dt.datetime.fromisoformat(t)
    if t.tzinfo is None:
        t = t.replace(tzinfo=_dt.timezone.utc)
    return int(round(t.timestamp() * 1000))


def to_ms(c: Column | str, dtype: str = "timestamp_ntz") -> Column:
    """Timestamp column → epoch ms BIGINT, independent of the session zone for NTZ."""
    c = F.col(c) if isinstance(c, str) else c
    if dtype == "timestamp_ntz":
        epoch = F.lit(_dt.datetime(1970, 1, 1)).cast("timestamp_ntz")
        return F.timestamp_diff("MILLISECOND", epoch, c)
    return F.unix_millis(c)


def ms_to_ts(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_millis(c)


# --- float semantics --------------------------------------------------------------
INF = float("inf")
NAN = float("nan")


def fdiv(num: Column, den: Column) -> Column:
    """IEEE division: x/0 = ±Inf, 0/0 = NaN (Spark ANSI would raise, try_divide gives NULL)."""
    return (F.when(den.isNull() | num.isNull(), F.lit(None).cast("double"))
            .when(F.isnan(num) | F.isnan(den), F.lit(NAN))
            .when(den == 0,
                  F.when(num > 0, F.lit(INF)).when(num < 0, F.lit(-INF)).otherwise(F.lit(NAN)))
            .otherwise(num.cast("double") / den.cast("double")))


def not_nan(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


# --- grid --------------------------------------------------------------------------
@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start+step, …, ≤ end (epoch ms).

    A grid has no cap: it is three numbers on the driver, its points are made by
    Spark where they are needed (``df``) or follow from a sample's time.
    """
    start: int
    end: int
    step: int

    @staticmethod
    def range(start, end, step) -> "Grid":
        s, e, st = epoch_ms(start), epoch_ms(end), duration_ms(step)
        if st <= 0 or e < s:
            raise ValueError("grid needs step > 0 and end >= start")
        return Grid(s, e, st)

    @staticmethod
    def instant(t) -> "Grid":
        t = epoch_ms(t)
        return Grid(t, t, 1)

    @property
    def n(self) -> int:
        return (self.end - self.start) // self.step + 1

    def times(self) -> list[int]:
        return [self.start + i * self.step for i in range(self.n)]

    def df(self, spark: SparkSession) -> DataFrame:
        """One row per evaluation time (``ts``)."""
        return (spark.range(0, self.n, numPartitions=max(1, self.n // 100_000))
                .select((F.lit(self.start) + F.col("id") * F.lit(self.step)).cast("bigint").alias(TS)))

    def k_of(self, ts: Column) -> Column:
        return ((ts - F.lit(self.start)) / F.lit(self.step)).cast("bigint")

    def ts_of(self, k: Column) -> Column:
        return (F.lit(self.start) + k * F.lit(self.step)).cast("bigint")


# --- MetricFrame ---------------------------------------------------------------------
@dataclass(frozen=True)
class MetricFrame:
    df: DataFrame
    labels: tuple[str, ...]
    empty: bool = False        # known to hold no rows, whatever it is made of

    def __post_init__(self):
        object.__setattr__(self, "labels", tuple(self.labels))

    # convenience --------------------------------------------------------------
    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def with_df(self, df: DataFrame, labels: Iterable[str] | None = None) -> "MetricFrame":
        return MetricFrame(df, tuple(self.labels if labels is None else labels), self.empty)

    def select_std(self) -> DataFrame:
        return self.df.select(*self.labels, TS, VALUE)

    def drop_name(self) -> "MetricFrame":
        if NAME not in self.labels:
            return self
        labels = tuple(l for l in self.labels if l != NAME)
        return MetricFrame(self.df.drop(NAME), labels, self.empty)

    def to_table(self, timestamps: bool = False) -> DataFrame:
        """Plain result table: labels, ts (epoch ms or timestamp), value."""
        t = ms_to_ts(TS).alias(TS) if timestamps else F.col(TS)
        return self.df.select(*self.labels, t, VALUE)

    # fluent sugar for the functional API ------------------------------------------
    def __getattr__(self, item):
        from . import api
        fn = getattr(api, item, None)
        if fn is None:
            raise AttributeError(item)
        return lambda *a, **kw: fn(self, *a, **kw)


def label_list(mf: MetricFrame, by: Sequence[str] | None = None, without: Sequence[str] | None = None) -> list[str]:
    """Grouping label list for ``by`` / ``without`` (metric name always removed by ``without``)."""
    if by is not None and without is not None:
        raise ValueError("use by= or without=, not both")
    if by is not None:
        return list(dict.fromkeys(by))
    if without is not None:
        drop = set(without) | {NAME}
        return [l for l in mf.labels if l not in drop]
    return []


def ensure_labels(mf: MetricFrame, names: Iterable[str]) -> MetricFrame:
    """Add absent label columns as "" so that they can be grouped/matched."""
    missing = [n for n in names if n not in mf.labels]
    if not missing:
        return mf
    df = mf.df
    for n in missing:
        df = df.withColumn(n, F.lit(""))
    return MetricFrame(df, mf.labels + tuple(missing), mf.empty)


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str], rprefix: str) -> Column:
    """Join condition on label columns (absent labels are "" so plain equality is exact)."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & (left[k] == right[rprefix + k])
    return cond
