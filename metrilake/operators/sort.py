"""Sorts: O1, O3.  A sort is the last step of a panel query; Spark range-partitions
the result, so even a large table sorts in parallel."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import TS, VALUE, MetricFrame


def sort_desc(mf: MetricFrame) -> DataFrame:
    """``sort_desc(v)`` (O1): by value, largest first (NaN last), per evaluation time."""
    return mf.df.orderBy(*desc_order(mf))


def desc_order(mf: MetricFrame) -> list:
    return [F.col(TS), F.isnan(VALUE).asc(), F.col(VALUE).desc(), *[F.col(x) for x in mf.labels]]


def sort_asc(mf: MetricFrame) -> DataFrame:
    return mf.df.orderBy(F.col(TS), F.isnan(VALUE).asc(), F.col(VALUE).asc(), *mf.labels)


def numbered(df: DataFrame, order: Sequence) -> DataFrame:
    """``row`` = place of each row in a sorted result, from 1.  Range partitions in
    order, a number inside each, and the sizes of those before it: the driver holds
    one number per partition."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    d = d.withColumn("_p", F.shiftright("_id", 33))
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(sizes.select("_p", before.alias("_b")), "_p")
    return d.withColumn("row", F.col("_b") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_p", "_b", "_id")


def sort_by(df: DataFrame, cols: Sequence[tuple[str, bool]]) -> DataFrame:
    """Table sort (O3): ``[(column, descending)]``."""
    return df.orderBy(*table_order(cols))


def table_order(cols: Sequence[tuple[str, bool]]) -> list:
    return [F.col(c).desc() if d else F.col(c).asc() for c, d in cols]
