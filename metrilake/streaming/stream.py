"""Structured Streaming operators: X1–X9.

Streams carry samples ``(labels…, ts_event TIMESTAMP, ts ms, value)``; the
event-time column is what watermarks and windows use.  Operators that keep state
of their own are stateful processors (``transformWithStateInPandas``): state is a
few numbers or an append-only list per key in the state store, timers on the
watermark close windows and drop idle keys.  Results are written per micro-batch
(``foreachBatch``) into a table in the cluster's shared folder with the batch
id, so a restarted query resumes from its checkpoint and readers take the newest
version of each key.
"""
from __future__ import annotations

import math
import threading
import uuid
from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from ..frame import TS, VALUE, MetricFrame, duration_ms
from ..session import shared_dir

EVENT_TIME = "event_time"
END = "_end"          # marks the row that ends a replayed stream: no sample, it moves the watermark on


def _interval(d) -> str:
    return f"{duration_ms(d) // 1000} seconds"


def with_event_time(stream: DataFrame, ts_ms: str = TS) -> DataFrame:
    return stream.withColumn(EVENT_TIME, F.timestamp_millis(F.col(ts_ms)))


def with_delay(stream: DataFrame, delay="30m") -> DataFrame:
    """Watermark = consistency delay (X3): later samples may be dropped by stateful operators."""
    return stream.withWatermark(EVENT_TIME, _interval(delay))


def stream_eval(stream: DataFrame, labels: Sequence[str], interval="3m") -> DataFrame:
    """Tumbling evaluation interval (X1): per series and evaluation time t the last
    sample of (t - interval, t] (the instant value at t), plus count/sum.  Spark's windows
    are closed on the left, so they start one millisecond, a sample's resolution, later."""
    w = F.window(EVENT_TIME, _interval(interval), startTime="1 millisecond")
    return (stream.groupBy(w.alias("w"), *labels)
            .agg(F.max(F.struct(F.col(TS), F.col(VALUE))).alias("_l"), F.count(F.lit(1)).alias("samples"),
                 F.sum(VALUE).alias("sum"))
            .select(*labels, (F.unix_millis(F.col("w.end")) - 1).alias("eval_ts"), F.col("_l." + VALUE).alias("last"),
                    "samples", "sum"))


# -- X2: sliding ranges from slots --------------------------------------------------------
_SLOT = {"n": "bigint", "min": "double", "max": "double", "first_ts": "bigint", "first": "double", "last_ts": "bigint", "last": "double", "drops": "double",
         "e_n": "bigint", "e_first": "double", "e_last": "double", "e_drops": "double"}


def _drops(v: np.ndarray) -> float:
    """The sum of the values before counter drops of samples in order."""
    return float(v[:-1][v[1:] < v[:-1]].sum()) if len(v) > 1 else 0.0


class _Slots(StatefulProcessor):
    """Samples of one (series, slot), appended to a list until the watermark passes the slot's end; then one summary.

    A slot is (end - width, end]; ``e_`` fields are of the samples exactly at its end, which a window that begins
    there holds too.
    """

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle):
        self.handle = handle
        self.samples = handle.getListState("samples", f"{TS} bigint, {VALUE} double")

    def handleInputRows(self, key, rows, timerValues):
        end = int(key[-1])
        if not self.samples.exists():
            self.handle.registerTimer(end)
        for pdf in rows:
            if END in pdf:
                pdf = pdf[~pdf[END].to_numpy(bool)]
            if len(pdf):
                self.samples.appendList(list(zip(pdf[TS].tolist(), pdf[VALUE].tolist())))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        got = list(self.samples.get())
        self.samples.clear()
        if not got:
            return
        t, v = np.array([x[0] for x in got], np.int64), np.array([x[1] for x in got], np.float64)
        order = np.lexsort((v, t))
        t, v = t[order], v[order]
        e = v[t == int(key[-1])]
        yield pd.DataFrame([(*key[:-1], pd.Timestamp(int(key[-1]), unit="ms"), int(key[-1]), len(v), float(v.min()), float(v.max()), int(t[0]), float(v[0]),
                             int(t[-1]), float(v[-1]), _drops(v), len(e), float(e[0]) if len(e) else None, float(e[-1]) if len(e) else None, _drops(e))],
                           columns=[*self.keys, EVENT_TIME, "slot", *_SLOT])


class _Ranges(StatefulProcessor):
    """The slots of one series that open windows still need; a window's merge of them when the watermark passes its end."""

    def __init__(self, keys: list[str], rng: int, step: int, width: int):
        self.keys, self.rng, self.step, self.width = keys, rng, step, width

    def init(self, handle):
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot bigint", ", ".join(f"{c} {t}" for c, t in _SLOT.items()))

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            for slot, *summary in pdf[["slot", *_SLOT]].itertuples(index=False):
                self.slots.updateValue((int(slot),), tuple(None if isinstance(x, float) and math.isnan(x) else x for x in summary))
                first = -(-int(slot) // self.step) * self.step
                for end in range(first, int(slot) + self.rng + 1, self.step):     # windows that hold the slot, or its end
                    self.handle.registerTimer(end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        end = expiredTimerInfo.getExpiryTimeInMs()
        begin = end - self.rng
        held = sorted((k[0], dict(zip(_SLOT, v))) for k, v in self.slots.iterator())
        parts = []       # (n, min, max, first, last, drops) in order
        for slot, s in held:
            if slot == begin and s["e_n"]:
                parts.append((s["e_n"], s["e_first"], s["e_last"], s["e_first"], s["e_last"], s["e_drops"]))
            elif begin < slot <= end:
                parts.append((s["n"], s["min"], s["max"], s["first"], s["last"], s["drops"]))
            if slot < begin + self.width:       # no later window holds it
                self.slots.removeKey((slot,))
        if not parts:
            return
        n, low, high, first, last, drops = zip(*parts)
        fallen = sum(drops) + sum(a for a, b in zip(last, first[1:]) if b < a)
        yield pd.DataFrame([(*key, end, min(low), max(high), sum(n), last[-1] - first[0], last[-1] - first[0] + fallen)],
                           columns=[*self.keys, "eval_ts", "min", "max", "samples", "delta", "increase"])


def stream_range(stream: DataFrame, labels: Sequence[str], rng="5m", step="1m") -> DataFrame:
    """Sliding range ``[t - range, t]`` evaluated every ``step`` (X2), in append mode: per series and window, once the
    watermark has passed it, min/max and count for ``*_over_time``, the difference of the last and first sample, and the
    counter increase between them, which adds what each reset took away.

    Two chained stateful steps.  Samples go to slots that divide range and step, keyed by (series, slot): a hot series is
    spread over its slots, each sample is held once, in a list that only grows, until the slot closes.  Closed slots, a
    summary each, go to their series, which merges those of a window; it holds the slots of one range.  A row marked
    ``END`` (``replayed``) is no sample; behind it all windows are closed.
    """
    r, s = duration_ms(rng), duration_ms(step)
    width, keys = math.gcd(r, s), list(labels)
    end = (F.ceil(F.col(TS) / F.lit(width)) * F.lit(width)).cast("bigint")
    text = ", ".join(f"{k} string" for k in keys)
    slots = (stream.select(*keys, TS, VALUE, EVENT_TIME, end.alias("slot"), *([END] if END in stream.columns else [])).groupBy(*keys, "slot")
             .transformWithStateInPandas(_Slots(keys), f"{text}, {EVENT_TIME} timestamp, slot bigint, " + ", ".join(f"{c} {t}" for c, t in _SLOT.items()),
                                         "Append", "EventTime", eventTimeColumnName=EVENT_TIME))
    return slots.groupBy(*keys).transformWithStateInPandas(
        _Ranges(keys, r, s, width), f"{text}, eval_ts bigint, min double, max double, samples bigint, delta double, increase double", "Append", "EventTime")


def dedup_stream(stream: DataFrame, labels: Sequence[str], slot=None) -> DataFrame:
    """Drop repeated samples (X4, keyed by series and ts) or keep one replica
    sample per series and slot (X8, ``slot`` given) within the watermark."""
    if slot is None:
        return stream.dropDuplicatesWithinWatermark(list(labels) + [TS])
    s = duration_ms(slot)
    return (stream.withColumn("_slot", F.floor(F.col(TS) / F.lit(s)).cast("bigint"))
            .dropDuplicatesWithinWatermark(list(labels) + ["_slot"]).drop("_slot"))


# -- X5: out-of-order split ---------------------------------------------------------------
def split_late(batch: DataFrame, newest: DataFrame, labels: Sequence[str], order: str, block: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Flag samples older than the newest that arrived before them for their series.

    ``batch`` is a micro-batch whose arrival order is ``order`` (a sequence number or offset that grows from batch to
    batch), ``newest`` holds (labels, newest ts) of what arrived earlier.  A series' rows are taken in blocks of
    ``block`` arrival numbers: the running maximum inside a block is a window of that many rows at most, the maximum of
    the blocks before it, and of earlier batches, is joined to it.  Returns the flagged rows and the series' new maxima.
    """
    keys = list(labels)
    d = batch.withColumn("_b", F.floor(F.col(order) / F.lit(block)))
    before = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = d.groupBy(*keys, "_b").agg(F.max(TS).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (tops.withColumn("_carry", F.max("_top").over(earlier)).join(newest.select(*keys, "newest"), keys, "left")
             .select(*keys, "_b", F.greatest("_carry", "newest").alias("_carry")))
    late = F.col(TS) < F.greatest("_in", "_carry")
    out = (d.withColumn("_in", F.max(TS).over(before)).join(carry, [*keys, "_b"])
           .select(*batch.columns, F.coalesce(late, F.lit(False)).alias("out_of_order")))
    return out, tops.groupBy(*keys).agg(F.max("_top").alias("newest"))


def split_late_to_table(spark: SparkSession, stream: DataFrame, labels: Sequence[str], order: str, name: str, block: int = 10_000) -> DataFrame:
    """``split_late`` over a stream; the state between batches is a table of maxima by batch in the shared folder.

    A batch reads what earlier ones left and writes the maxima of the series it saw, so a batch that runs
    again after a failure gives the same rows; every 32nd writes those of all series, and readers begin there.
    """
    keys = list(labels)
    root = shared_dir(spark, f"streams/{name}-{uuid.uuid4().hex[:8]}")
    schema = stream.select(*keys, F.col(TS).alias("newest")).schema

    def sink(df: DataFrame, epoch: int):
        if epoch:
            paths = [f"{root}/state/{e}" for e in range((epoch - 1) // 32 * 32, epoch)]
            seen = df.sparkSession.read.schema(schema).parquet(*paths).groupBy(*keys).agg(F.max("newest").alias("newest"))
        else:
            seen = df.sparkSession.createDataFrame([], schema)
        df = df.persist()
        out, tops = split_late(df, seen, keys, order, block)
        if epoch % 32 == 0:
            tops = tops.unionByName(seen).groupBy(*keys).agg(F.max("newest").alias("newest"))
        out.write.mode("overwrite").parquet(f"{root}/data/_batch={epoch}")
        tops.write.mode("overwrite").parquet(f"{root}/state/{epoch}")
        df.unpersist()

    _run(stream, sink, "append", root)
    return spark.read.schema(stream.schema.add("out_of_order", "boolean").add("_batch", "long")).parquet(f"{root}/data").drop("_batch")


# -- X6: streaming `for` state ----------------------------------------------------------------
HOLD_GROUPS = 4096      # groups of alert instances, so that Python is called once for many of them
_NO_RUN = -(1 << 63)


def hold_stream(evals: DataFrame, labels: Sequence[str], for_, max_gap) -> DataFrame:
    """Streaming ``for`` (X6): rows are evaluations ``(labels, ts, active bool, event_time)`` with a watermark, batches in
    the order of time.

    A false evaluation or a gap above ``max_gap`` ends a run of active ones.  Emits the state after every active evaluation.
    Alert instances are dealt to groups by the hash of their labels.  A group's state is, per instance, when its run began
    (null: none) and its last evaluation; a batch's evaluations of all its instances are taken as arrays, gaps and islands
    at once.  An instance is dropped when the watermark is more than the largest gap behind its last evaluation: a later
    one begins a new run in any case.
    """
    keys, hold, gap = list(labels), duration_ms(for_), duration_ms(max_gap)
    cols = [f"k{i}" for i in range(len(keys))]

    def fn(key, pdfs, state):
        held = dict(zip([*cols, "since", "last"], state.get)) if state.exists else {c: [] for c in [*cols, "since", "last"]}
        rows = [] if state.hasTimedOut else list(pdfs)
        wm, n = state.getCurrentWatermarkMs(), len(held["last"])
        ids = pd.concat([pd.DataFrame({c: pd.Series(list(held[c]), dtype=object) for c in cols})] + [p[cols] for p in rows], ignore_index=True)
        code = ids.groupby(cols, dropna=False, sort=False).ngroup().to_numpy()       # the instances of the state come first, in their order
        m = int(code.max()) + 1 if len(code) else 0
        since, last, known = np.full(m, _NO_RUN, np.int64), np.zeros(m, np.int64), np.arange(m) < n
        since[:n] = [_NO_RUN if x is None else x for x in held["since"]]
        last[:n] = held["last"]
        label = ids.to_numpy(object)[np.sort(np.unique(code, return_index=True)[1])] if m else np.zeros((0, len(cols)), object)
        if rows:
            t, active = (np.concatenate(x) for x in zip(*[(p[TS].to_numpy(np.int64), p["active"].to_numpy(bool)) for p in rows]))
            order = np.lexsort((t, code[n:]))
            c, t, active = code[n:][order], t[order], active[order]
            first = np.concatenate([[True], c[1:] != c[:-1]])
            before = np.where(first, np.where(known[c], last[c], t), np.concatenate([[0], t[:-1]]))
            on = np.where(first, known[c] & (since[c] != _NO_RUN), np.concatenate([[False], active[:-1]]))
            begins = active & ~(on & (t - before <= gap))
            at = np.maximum.accumulate(np.where(begins | first, np.arange(len(t)), 0))
            start = np.where(begins, t, since[c])[at]
            end = np.concatenate([first[1:], [True]])
            since[c[end]], last[c[end]] = np.where(active[end], start[end], _NO_RUN), t[end]
            if active.any():
                out = [*label[c[active]].T, t[active], np.where(t - start >= hold, "firing", "pending").astype(object)[active], start[active]]
                yield pd.DataFrame(dict(zip([*keys, TS, "state", "active_at"], out)))
        keep = last + gap + 1 > wm
        if keep.any():
            state.update((*[list(x) for x in label[keep].T], [None if x == _NO_RUN else int(x) for x in since[keep]], last[keep].tolist()))
            state.setTimeoutTimestamp(int(last[keep].min()) + gap + 1)
        elif state.exists:
            state.remove()

    schema = ", ".join(f"{k} string" for k in keys) + ", ts bigint, state string, active_at bigint"
    kept = ", ".join(f"{c} array<string>" for c in cols) + ", since array<bigint>, last array<bigint>"
    group = F.pmod(F.xxhash64(*keys), F.lit(HOLD_GROUPS))
    return (evals.select(*[F.col(k).alias(c) for k, c in zip(keys, cols)], TS, "active", EVENT_TIME, group.alias("_group")).groupBy("_group")
            .applyInPandasWithState(fn, schema, kept, "append", GroupStateTimeout.EventTimeTimeout))


# -- X7: streaming notification grouping with timers ------------------------------------------
def group_notifications_stream(routed: DataFrame, labels: Sequence[str], group_interval, repeat_interval,
                               group_wait="0s") -> DataFrame:
    """Notification grouping on a stream (X7): E8's rule, driven by event-time timers.

    Input: routed firing alert evaluations ``(receiver, group_key, labels…, ts, event_time)``
    with a watermark.  Per (receiver, group) the state keeps the distinct alert
    fingerprints of each still-open ``group_interval`` slot and the digest of the last
    closed one.  A slot closes when the watermark passes its end – on the next
    micro-batch or, without new data, on its event-time timer – and then notifies when
    its alert set differs from the previous slot's, or every ``repeat_interval`` while
    unchanged; the first notification of a run waits ``group_wait``.  Rows of a batch
    are folded chunk by chunk into sets, never gathered; state is bounded by the alert
    instances of the open slots, and is dropped once no later slot can continue the run.
    """
    gi, rp, gw = duration_ms(group_interval), duration_ms(repeat_interval), duration_ms(group_wait)
    fp = F.xxhash64(*[F.coalesce(F.col(l), F.lit("")) for l in labels])
    d = routed.filter(F.col("state") == "firing") if "state" in routed.columns else routed
    d = d.select("receiver", "group_key", F.floor(F.col(TS) / F.lit(gi)).cast("bigint").alias("_slot"),
                 fp.alias("_fp"), EVENT_TIME)
    out_schema = "receiver string, group_key string, notify_ts bigint, alerts bigint, kind string"
    state_schema = ("open_slots array<bigint>, open_fps array<array<bigint>>, prev_slot bigint, "
                    "prev_digest bigint, last_change bigint")

    def fn(key, pdfs, state):
        if state.exists:
            slots, fps, prev_slot, prev_dig, last_change = state.get
        else:
            slots, fps, prev_slot, prev_dig, last_change = [], [], None, None, None
        open_ = {int(s): set(int(v) for v in f) for s, f in zip(slots or [], fps or [])}
        for pdf in pdfs:
            for s, g in pdf.groupby("_slot")["_fp"]:
                open_.setdefault(int(s), set()).update(int(v) for v in g.unique())
        wm = state.getCurrentWatermarkMs()
        out = []
        for s in sorted(open_):
            if (s + 1) * gi > wm:          # rows with ts <= watermark are late: the slot is complete
                break
            members = open_.pop(s)
            dig = 0
            for v in members:
                dig ^= v
            new_run = prev_slot is None or prev_slot != s - 1
            changed = new_run or prev_dig != dig
            if changed:
                last_change = s
            since = (s - last_change) * gi
            if changed or (since > 0 and since % rp == 0):
                out.append((key[0], key[1], s * gi + (gw if new_run else 0), len(members),
                            "update" if changed else "repeat"))
            prev_slot, prev_dig = s, dig
        if open_:
            ks = sorted(open_)
            state.update((ks, [sorted(open_[k]) for k in ks], prev_slot, prev_dig, last_change))
            state.setTimeoutTimestamp(max((ks[0] + 1) * gi - 1, wm + 1))
        elif prev_slot is not None and (prev_slot + 2) * gi > wm:
            # the next slot may still continue this run: keep the digest until it is closed
            state.update(([], [], prev_slot, prev_dig, last_change))
            state.setTimeoutTimestamp(max((prev_slot + 2) * gi - 1, wm + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["receiver", "group_key", "notify_ts", "alerts", "kind"])

    return d.groupBy("receiver", "group_key").applyInPandasWithState(
        fn, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


# -- running a streaming query to completion ------------------------------------------------
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str, root: str) -> None:
    """Runs a stream with ``availableNow`` to its end; keyed state of any kind lies in RocksDB, outside the heap."""
    spark = stream.sparkSession
    if spark.conf.get(STATE_STORE, None) != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)
    (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", root + "/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append",
                 keys: Sequence[str] | None = None) -> DataFrame:
    """Run ``stream`` with ``availableNow`` into a batch-versioned Parquet table in the shared
    folder and return the final table (for ``update`` mode: newest version per ``keys``)."""
    root = shared_dir(spark, f"streams/{name}-{uuid.uuid4().hex[:8]}")

    def sink(df: DataFrame, epoch: int):
        # a batch that runs again after a failure replaces what it wrote before
        df.write.mode("overwrite").parquet(f"{root}/data/_batch={epoch}")

    _run(stream, sink, mode, root)
    schema = stream.schema.add("_batch", "long")
    try:
        res = spark.read.schema(schema).parquet(root + "/data")
    except Exception:  # noqa: BLE001 - nothing written
        return spark.createDataFrame([], schema).drop("_batch")
    if mode == "update" and keys:
        w = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
        res = res.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return res.drop("_batch")


ROWS_A_FILE = 500_000     # of a replayed batch, if it has more
ROWS_A_TASK = 20_000      # so many rows are dealt to each file at least, so that none stays empty


def replayed(spark: SparkSession, df: DataFrame, order: str, parts: int | Sequence[float], name: str, end: int | None = None) -> DataFrame:
    """A stream of a table's rows in micro-batches along a numeric column, ``parts`` of about equal size or, if that is
    a list, cut at these values, each the last of its batch: the ranges are written as files, one after the other and as
    many each, and read back a range a batch.

    ``end``: a last batch holds one row marked ``END``, of nulls but for ``order``, which is so much above the largest
    one: where that is a time, the watermark passes what was read before and the stream's last results come out.
    """
    root = shared_dir(spark, f"streams/{name}-{uuid.uuid4().hex[:8]}/input")
    if end is not None:
        df = df.withColumn(END, F.lit(False))
    bounds = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001) if isinstance(parts, int) else parts
    cuts = [float("-inf"), *sorted(set(bounds)), float("inf")]
    place = F.lit(0)
    for x in cuts[1:-1]:
        place = place + (F.col(order) > F.lit(x)).cast("int")
    sizes = [r[1] for r in df.filter(F.col(order).isNotNull()).groupBy(place.alias("_part")).count().collect()]
    files = max(1, min(min(sizes, default=0) // ROWS_A_TASK, max(sizes, default=0) // ROWS_A_FILE))
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = df.filter((F.col(order) > F.lit(low)) & (F.col(order) <= F.lit(high)))
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.parquet(f"{root}/part={i}")
    if end is not None:
        kinds, last = dict(df.dtypes), F.max(order) + F.lit(end)
        nulls = [F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in (order, END)]
        df.agg(last.cast(kinds[order]).alias(order), F.lit(True).alias(END)).filter(F.col(order).isNotNull()).select(*nulls, order, END).coalesce(1).write.parquet(f"{root}/part={len(cuts) - 1}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/part=*")


# -- X9: lag ------------------------------------------------------------------------------------
class ProgressSamples(StreamingQueryListener):
    """Turns the observed numbers of each batch of a query into samples (metric, labels, ts, value).

    ``observe`` on a stream computes them as a batch runs; the listener receives one row a batch.  ts is the
    batch's number times ``interval``, so that batches are evaluation times.
    """

    def __init__(self, name: str, interval: int = 1000):
        self.name, self.interval = name, interval
        self.rows: list[tuple[str, str, int, float]] = []
        self.done = threading.Event()
        self._id = None

    def onQueryStarted(self, event):
        if event.name == self.name:
            self._id = event.id

    def onQueryProgress(self, event):
        p = event.progress
        if p.name == self.name and self.name in p.observedMetrics and p.numInputRows:
            for metric, value in p.observedMetrics[self.name].asDict().items():
                if value is not None:
                    kind, _, stream = metric.partition(":")
                    self.rows.append((kind, stream, p.batchId * self.interval, float(value)))

    def onQueryTerminated(self, event):
        if event.id == self._id:
            self.done.set()


def observed_times(spark: SparkSession, stream: DataFrame, by: str, streams: Sequence[str], name: str) -> tuple[MetricFrame, MetricFrame]:
    """(highest, sent) per batch of a stream: the newest timestamp that has come in, and that of each of ``streams``
    (values of the column ``by``), in seconds, as samples at the batch's number.  Batches without rows of a stream
    leave its last sample standing."""
    seen = [F.max(TS).alias("highest:")] + [F.max(F.when(F.col(by) == F.lit(s), F.col(TS))).alias(f"sent:{s}") for s in streams]
    root = shared_dir(spark, f"streams/{name}-{uuid.uuid4().hex[:8]}")
    listener = ProgressSamples(name)
    spark.streams.addListener(listener)
    try:
        q = (stream.observe(name, *seen).writeStream.queryName(name).foreachBatch(lambda df, epoch: df.write.format("noop").mode("overwrite").save())
             .option("checkpointLocation", root + "/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
        listener.done.wait(60)
    finally:
        spark.streams.removeListener(listener)
    df = spark.createDataFrame(listener.rows, "metric string, stream string, ts bigint, value double").withColumn("value", F.col("value") / F.lit(1000.0))
    newest = Window.partitionBy("metric", "stream").orderBy(TS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("value", F.max("value").over(newest))      # one row a batch and stream
    highest = MetricFrame(df.filter("metric = 'highest'").select(TS, VALUE), ())
    return highest, MetricFrame(df.filter("metric = 'sent'").select("stream", TS, VALUE), ("stream",))


def lag_report(highest, sent):
    """Consumer lag (X9): ``highest - ignoring(...) group_right sent`` per stream."""
    from ..operators.match import binop
    return binop(highest, sent, "-", on=[c for c in highest.labels if c in sent.labels], group_right=[])
