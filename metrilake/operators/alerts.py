"""Alert evaluation and routing: E1–E11.

An *alerts frame* is a MetricFrame whose labels include ``alertname`` plus
columns ``state`` ('pending'/'firing') and ``active_at`` (ms).  Windows here
are partitioned by one alert instance and ordered by evaluation time: a
group holds a row a grid point at most, whatever the volume of samples behind the alert.
"""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NAME, TS, VALUE, Grid, MetricFrame, duration_ms, ensure_labels
from ..functions.matchers import predicate

ALERTNAME = "alertname"


def alert(mf: MetricFrame, name: str, labels: Mapping[str, str] | None = None) -> MetricFrame:
    """Each element of the rule's result is an alert instance (E1); static labels override."""
    labels = dict(labels or {})
    d = mf.df.drop(NAME) if NAME in mf.labels else mf.df
    keep = [l for l in mf.labels if l not in (NAME, ALERTNAME) and l not in labels]
    for k, v in labels.items():
        d = d.withColumn(k, F.lit(v))
    d = d.withColumn(ALERTNAME, F.lit(name))
    out_labels = [ALERTNAME] + keep + list(labels)
    return MetricFrame(d.select(*out_labels, TS, VALUE), tuple(out_labels))


def hold(alerts: MetricFrame, for_, grid: Grid) -> DataFrame:
    """``for`` hold (E2): an instance is *pending* from the first of an unbroken
    run of evaluations and *firing* once it has been active for ``for``.

    Gaps-and-islands: grid index minus row number is constant along a run of
    consecutive evaluations, so the run start is a grouped minimum.
    """
    f = duration_ms(for_)
    ids = list(alerts.labels)
    d = alerts.df.withColumn("_k", grid.k_of(F.col(TS)))
    w = Window.partitionBy(*ids).orderBy("_k")
    d = d.withColumn("_isl", F.col("_k") - F.row_number().over(w))
    wi = Window.partitionBy(*ids, "_isl")
    d = d.withColumn("active_at", F.min(TS).over(wi))
    state = F.when(F.col(TS) - F.col("active_at") >= F.lit(f), F.lit("firing")).otherwise(F.lit("pending"))
    return d.select(*ids, TS, VALUE, state.alias("state"), "active_at")


def firing(held: DataFrame) -> DataFrame:
    return held.filter(F.col("state") == "firing")


def alerts_series(held: DataFrame, labels: Sequence[str]) -> MetricFrame:
    """``ALERTS{alertname, alertstate, …} = 1`` as a queryable series."""
    d = held.select(F.lit("ALERTS").alias(NAME), *labels, F.col("state").alias("alertstate"), TS,
                    F.lit(1.0).alias(VALUE))
    return MetricFrame(d, (NAME, *labels, "alertstate"))


def burn_rate_alert(long: MetricFrame, short: MetricFrame, factor: float, budget: float,
                    name: str, labels: Mapping[str, str] | None = None) -> MetricFrame:
    """Multi-window burn-rate alert (E4): ``long > f·b and short > f·b``."""
    from .arith import where_value
    from .match import set_and
    thr = factor * budget
    return alert(set_and(where_value(long, ">", thr), where_value(short, ">", thr)), name, labels)


def inhibit(alerts: DataFrame, rules: Sequence[Mapping], labels: Sequence[str]) -> DataFrame:
    """Drop alerts muted by a firing source alert with equal ``equal`` labels at the same time.

    A source that also matches the rule's target matchers cannot mute an
    alert that matches both sides (no self-inhibition).  Each rule is one
    semi join between two filtered sides of the alert frame.
    """
    ids = list(labels) + [TS]
    muted = None
    for r in rules:
        src_m = predicate(**_m(r["source"]))
        tgt_m = predicate(**_m(r["target"]))
        eq = list(r["equal"])
        src = alerts.filter((F.col("state") == "firing") & src_m).select(
            *[F.col(c).alias("_s_" + c) for c in eq + [TS]], tgt_m.alias("_s_both"))
        tgt = alerts.filter(tgt_m).withColumn("_t_both", src_m)
        cond = F.col(TS) == F.col("_s_" + TS)
        for c in eq:
            cond = cond & (F.col(c) == F.col("_s_" + c))
        cond = cond & ~(F.col("_t_both") & F.col("_s_both"))
        m = tgt.join(src, on=cond, how="left_semi").select(*ids)
        muted = m if muted is None else muted.unionByName(m)
    if muted is None:
        return alerts
    return alerts.join(muted.distinct(), on=ids, how="left_anti")


def _m(spec: Mapping) -> dict:
    return {"eq": spec.get("eq"), "ne": spec.get("ne"), "re_": spec.get("re"), "nre": spec.get("nre")}


def route(alerts: DataFrame, tree: Mapping) -> DataFrame:
    """First matching child route wins, else the root receiver (E7); adds receiver and group key."""
    recv = F.lit(tree["receiver"])
    group_by = tree.get("group_by", [])
    for child in reversed(tree.get("routes", [])):
        recv = F.when(predicate(**_m(child.get("matchers", {}))), F.lit(child["receiver"])).otherwise(recv)
    gkey = F.concat_ws(",", *[F.concat(F.lit(g + "="), F.coalesce(F.col(g), F.lit(""))) for g in group_by]) \
        if group_by else F.lit("")
    return alerts.withColumn("receiver", recv).withColumn("group_key", gkey)


def group_notifications(routed: DataFrame, labels: Sequence[str], group_interval, repeat_interval,
                        group_wait="0s") -> DataFrame:
    """Notifications per (receiver, group) at ``group_interval`` slots.

    A slot notifies when the set of firing alerts of the group differs from
    the previous slot's (XOR of instance hashes + count as a set digest), and
    again every ``repeat_interval`` while it stays unchanged.  The first
    notification of a run waits ``group_wait``.
    """
    gi, rp, gw = duration_ms(group_interval), duration_ms(repeat_interval), duration_ms(group_wait)
    fp = F.xxhash64(*[F.coalesce(F.col(l), F.lit("")) for l in labels])
    d = (routed.filter(F.col("state") == "firing")
         .withColumn("_slot", F.floor(F.col(TS) / F.lit(gi)).cast("bigint"))
         # an instance counts once a slot, however often it was evaluated in it
         .select("receiver", "group_key", "_slot", fp.alias("_fp")).distinct()
         .groupBy("receiver", "group_key", "_slot")
         .agg(F.bit_xor("_fp").alias("_digest"), F.count(F.lit(1)).alias("alerts")))
    w = Window.partitionBy("receiver", "group_key").orderBy("_slot")
    prev_slot, prev_dig, prev_n = F.lag("_slot").over(w), F.lag("_digest").over(w), F.lag("alerts").over(w)
    d = d.withColumn("_new_run", prev_slot.isNull() | (prev_slot != F.col("_slot") - 1))
    d = d.withColumn("_changed", F.col("_new_run") | (prev_dig != F.col("_digest")) | (prev_n != F.col("alerts")))
    wc = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_last_change", F.max(F.when(F.col("_changed"), F.col("_slot"))).over(wc))
    since = (F.col("_slot") - F.col("_last_change")) * F.lit(gi)
    repeat = (since > 0) & (since % F.lit(rp) == 0)
    d = d.filter(F.col("_changed") | repeat)
    notify = F.col("_slot") * F.lit(gi) + F.when(F.col("_new_run"), F.lit(gw)).otherwise(F.lit(0))
    return d.select("receiver", "group_key", notify.cast("bigint").alias("notify_ts"), "alerts",
                    F.when(F.col("_changed"), F.lit("update")).otherwise(F.lit("repeat")).alias("kind"))


def resolve(held: DataFrame, labels: Sequence[str], timeout="5m") -> DataFrame:
    """Incidents per alert instance (E9): a silence longer than ``timeout``
    resolves it at last-seen + timeout; the next sighting opens a new one."""
    to = duration_ms(timeout)
    ids = list(labels)
    d = held.filter(F.col("state") == "firing")
    w = Window.partitionBy(*ids).orderBy(TS)
    d = d.withColumn("_new", F.coalesce(F.col(TS) - F.lag(TS).over(w) > F.lit(to), F.lit(True)))
    d = d.withColumn("_inc", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (d.groupBy(*ids, "_inc")
             .agg(F.min(TS).alias("starts_at"), (F.max(TS) + F.lit(to)).alias("ends_at"),
                  F.count(F.lit(1)).alias("evaluations"))
             .drop("_inc"))


def _any_range(c: Column, ranges: Sequence) -> Column:
    """Whether a number lies in one of the ranges (from, to), both included; a number alone is a range."""
    out = F.lit(False)
    for r in ranges:
        low, high = (r, r) if isinstance(r, int) else r
        out = out | c.between(low, high)
    return out


def in_interval(t: Column, interval: Mapping) -> Column:
    """Whether a UTC timestamp lies in a calendar interval; a field that is left out matches always.

    weekdays (Monday = 0), months and years are numbers or ranges (from, to); days_of_month too, where a negative day counts
    from the month's end (-1 its last) and a range is cut to the month; times are ("HH:MM", "HH:MM"), the end left out
    ("24:00" is the day's end).
    """
    fields = {"weekdays": F.pmod(F.dayofweek(t) + F.lit(5), F.lit(7)), "months": F.month(t), "years": F.year(t)}
    out = F.lit(True)
    for name, c in fields.items():
        if interval.get(name) is not None:
            out = out & _any_range(c, interval[name])
    if interval.get("days_of_month") is not None:
        day, last = F.dayofmonth(t), F.dayofmonth(F.last_day(t))
        place = lambda d: F.lit(d) if d > 0 else last + F.lit(d + 1)
        hit = F.lit(False)
        for r in interval["days_of_month"]:
            low, high = (r, r) if isinstance(r, int) else r
            if not low or not high:
                raise ValueError("days of a month count from 1 or from -1")
            hit = hit | ((day >= place(low)) & (day <= place(high)))
        out = out & hit
    if interval.get("times"):
        minute = F.hour(t) * 60 + F.minute(t)
        out = out & _any_range(minute, [(int(a[:2]) * 60 + int(a[3:]), int(b[:2]) * 60 + int(b[3:]) - 1) for a, b in interval["times"]])
    return out


def mute(alerts: DataFrame, intervals: Sequence[Mapping]) -> DataFrame:
    """Drop alerts inside a mute time interval (E10, ``in_interval``): one predicate of the calendar day and minute."""
    t = F.timestamp_millis(F.col(TS))
    muted = F.lit(False)
    for iv in intervals:
        muted = muted | in_interval(t, iv)
    return alerts.filter(~muted)


def watchdog(spark, grid: Grid) -> MetricFrame:
    """Always-firing dead-man switch."""
    from .arith import vector
    return alert(vector(spark, grid, 1), "Watchdog", {"severity": "none"})


def info_inhibitor(alerts_mf: MetricFrame) -> MetricFrame:
    """Fires for each info alert whose namespace has no firing warning or critical alert."""
    from .match import set_unless
    from .select import select
    info = select(alerts_mf, eq={"severity": "info"})
    loud = select(alerts_mf, ne={"alertname": "InfoInhibitor"}, re={"severity": "warning|critical"},
                  eq={"alertstate": "firing"})
    return alert(set_unless(info, loud, on=["namespace"]), "InfoInhibitor", {"severity": "none"})
