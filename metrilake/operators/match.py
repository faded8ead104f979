"""Vector matching: binary operators between two vectors (J1–J9) and the set
operators ``and`` / ``or`` / ``unless`` (U1–U4).

Matching keys are label columns plus ``ts``.  Absent labels are "" on both
sides, so every join is a plain equi-join: Spark can hash-partition it, reuse
an upstream partitioning on the same keys, and AQE may turn it into a
broadcast join when the runtime size of one side is under the threshold.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import NAME, TS, VALUE, MetricFrame, ensure_labels
from .arith import ARITH, Scalar, apply_arith, apply_compare, scalar_op


def match_keys(l: MetricFrame, r: MetricFrame, on: Sequence[str] | None, ignoring: Sequence[str] | None) -> list[str]:
    if on is not None:
        return list(dict.fromkeys(on))
    drop = set(ignoring or ()) | {NAME}
    allk = list(dict.fromkeys(list(l.labels) + list(r.labels)))
    return [k for k in allk if k not in drop]


def _prefixed(df: DataFrame, cols: Sequence[str], p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in cols])


def assert_unique(mf: MetricFrame, keys: Sequence[str], what: str = "one side") -> DataFrame:
    """One row per (keys, ts); a duplicate raises at run time.

    Returns the de-duplicated side.  The check rides on one aggregation with
    partial merge and sits inside ``value`` so column pruning cannot drop it.
    """
    others = [c for c in mf.df.columns if c not in list(keys) + [TS, VALUE]]
    agg = mf.df.groupBy(*keys, TS).agg(
        F.count(F.lit(1)).alias("_n"), F.first(VALUE).alias(VALUE), *[F.first(c).alias(c) for c in others])
    msg = F.lit(f"found duplicate series for the match group on {what}")
    checked = F.when(F.col("_n") > 1, F.raise_error(msg).cast("double")).otherwise(F.col(VALUE))
    return agg.withColumn(VALUE, checked).drop("_n")


def binop(l, r, op: str, on: Sequence[str] | None = None, ignoring: Sequence[str] | None = None,
          group_left: Sequence[str] | None = None, group_right: Sequence[str] | None = None,
          bool_: bool = False, check_unique: bool = True) -> MetricFrame:
    """``l op r`` with vector matching.

    * one-to-one (default): each side at most one element per match key;
    * ``group_left=[labels]``: many(l)-to-one(r), copying ``labels`` from r;
    * ``group_right=[labels]``: mirrored.
    Either side may be a number or :class:`Scalar`.
    """
    if not isinstance(l, MetricFrame):
        return scalar_op(r, op, l, scalar_left=True, bool_=bool_)
    if not isinstance(r, MetricFrame):
        return scalar_op(l, op, r, bool_=bool_)
    if group_left is not None and group_right is not None:
        raise ValueError("group_left and group_right are exclusive")
    keys = match_keys(l, r, on, ignoring)
    l = ensure_labels(l, keys)
    r = ensure_labels(r, keys)
    many_left = group_right is None
    include = list(group_left if group_left is not None else (group_right or []))
    many, one = (l, r) if many_left else (r, l)
    one_cols = list(dict.fromkeys(keys + [c for c in include if c not in keys]))
    one = ensure_labels(one, one_cols)
    one_df = one.df.select(*one_cols, TS, VALUE)
    if check_unique:
        one_df = assert_unique(MetricFrame(one_df, tuple(one_cols)), keys, "the one side")
    o = _prefixed(one_df, one_cols + [TS, VALUE], "_o_")
    if check_unique and group_left is None and group_right is None:
        many = many.with_df(assert_unique(many, keys, "the other side"))
    cond = F.col(TS) == F.col("_o_" + TS)
    for k in keys:
        cond = cond & (F.col(k) == F.col("_o_" + k))
    j = many.df.join(o, on=cond, how="inner")
    mv, ov = F.col(VALUE), F.col("_o_" + VALUE)
    lv, rv = (mv, ov) if many_left else (ov, mv)
    is_arith = op in ARITH
    # result labels
    card_one = group_left is None and group_right is None
    if card_one:
        if on is not None:
            labels = [k for k in keys]
        else:
            labels = [c for c in many.labels if c not in set(ignoring or ())]
    else:
        labels = list(many.labels) + [c for c in include if c not in many.labels]
    if is_arith or bool_:
        labels = [c for c in labels if c != NAME]
    sel = []
    for c in labels:
        if not card_one and c in include:
            sel.append(F.col("_o_" + c).alias(c))
        else:
            sel.append(F.col(c))
    if is_arith:
        val = apply_arith(op, lv, rv)
        out = j.select(*sel, F.col(TS), val.alias(VALUE))
    else:
        cond_v = apply_compare(op, lv, rv)
        if bool_:
            out = j.select(*sel, F.col(TS), F.when(cond_v, F.lit(1.0)).otherwise(F.lit(0.0)).alias(VALUE))
        else:
            out = j.filter(cond_v).select(*sel, F.col(TS), lv.alias(VALUE))
    return MetricFrame(out, tuple(labels))


def _sig_join(l: MetricFrame, r: MetricFrame, on, ignoring, how: str) -> MetricFrame:
    keys = match_keys(l, r, on, ignoring)
    l = ensure_labels(l, keys)
    r = ensure_labels(r, keys)
    rk = r.df.select(*keys, TS)
    out = l.df.join(rk, on=keys + [TS], how=how)
    return MetricFrame(out.select(*l.labels, TS, VALUE), l.labels)


def set_and(l: MetricFrame, r: MetricFrame, on=None, ignoring=None) -> MetricFrame:
    """Elements of l that have a match in r (J6) – left semi join."""
    return _sig_join(l, r, on, ignoring, "left_semi")


def set_unless(l: MetricFrame, r: MetricFrame, on=None, ignoring=None) -> MetricFrame:
    """Elements of l without a match in r (J7) – left anti join."""
    return _sig_join(l, r, on, ignoring, "left_anti")


def set_or(l: MetricFrame, r: MetricFrame, on=None, ignoring=None) -> MetricFrame:
    """All of l plus the elements of r whose match key is not in l."""
    keys = match_keys(l, r, on, ignoring)
    l = ensure_labels(l, keys)
    r = ensure_labels(r, keys)
    labels = list(dict.fromkeys(list(l.labels) + list(r.labels)))
    l = ensure_labels(l, labels)
    r = ensure_labels(r, labels)
    extra = r.df.join(l.df.select(*keys, TS), on=keys + [TS], how="left_anti")
    out = l.df.select(*labels, TS, VALUE).unionByName(extra.select(*labels, TS, VALUE))
    return MetricFrame(out, tuple(labels))


def default_zero(mf: MetricFrame, grid) -> MetricFrame:
    """``x or vector(0)`` (U2) – adds a label-less 0 where x has no element at all."""
    from .arith import vector
    return set_or(mf, vector(mf.spark, grid, 0.0))


def coalesce_metrics(first: MetricFrame, second: MetricFrame, on=None, ignoring=None) -> MetricFrame:
    """Old-name-or-new-name fallback (U4) – ``first or second``."""
    return set_or(first, second, on=on, ignoring=ignoring)


def info_join(mf: MetricFrame, info: MetricFrame, on: Sequence[str], labels: Sequence[str],
              op: str = "*") -> MetricFrame:
    """``mf * on(on) group_left(labels) topk by(on)(1, max by(on+labels)(info))``."""
    from .agg import aggregate, topk
    one = topk(aggregate(info, "max", by=list(on) + list(labels)), 1, by=list(on))
    return binop(mf, one, op, on=on, group_left=labels, check_unique=False)
