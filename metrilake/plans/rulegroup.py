"""Rule groups (G1): recording and alerting rules over one evaluation grid each.

A rule's expression is a Python function of a :class:`Ctx` that returns a
MetricFrame built from the operators; what it reads, it asks the context for by
name: source families, records of its own and other groups, and ``ALERTS``, the
states of all alerts.

Rules run in the order of what they read.  A first pass calls every expression
on empty frames, notes the names, selections and shared expressions it asks for
and so gives the graph of the rules; rules that read ``ALERTS`` come after those
that do not.  In the second pass everything that two or more readers share is
written once to the shared folder and read from there: families, instant
selections, shared expressions, records and alert states.  Plans stay as small
as one rule's however large the group is, lost executors repeat one node, and
rules that do not wait for each other run at the same time.  There is no
per-evaluation loop: a rule is evaluated at all grid times at once.
"""
from __future__ import annotations

import threading
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Callable, Mapping, Sequence

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import NAME, TS, VALUE, Grid, MetricFrame, duration_ms
from ..operators import alerts as AL
from ..operators.select import instant, select
from ..operators.slots import slot_frame
from ..sources.store import record as _record


class MetricSource:
    """Metric name → raw samples (MetricFrame without ``__name__``).

    ``derived``: a family is computed when it is read, so what several rules read is written once."""

    derived = True

    def get(self, name: str) -> MetricFrame | None:  # pragma: no cover - interface
        raise NotImplementedError

    def names(self) -> frozenset | None:
        """The families there are, if that is known."""
        return None


class DictSource(MetricSource):
    def __init__(self, families: Mapping[str, Callable[[], MetricFrame]]):
        self._f = dict(families)
        self._cache: dict[str, MetricFrame] = {}

    def with_families(self, more: Mapping[str, Callable[[], MetricFrame]]) -> "DictSource":
        return DictSource({**self._f, **more})

    def names(self):
        return frozenset(self._f)

    def get(self, name):
        if name not in self._f:
            return None
        if name not in self._cache:
            self._cache[name] = self._f[name]()
        return self._cache[name]


class StoreSource(MetricSource):
    """Samples from the block store; label columns are the label names the metric carries
    (found with one distinct over its map keys – a handful of names, not data)."""

    derived = False

    def __init__(self, spark: SparkSession, root: str, start, end, lookback="5m"):
        from ..sources.store import read_samples
        self._read = lambda m: read_samples(spark, root, m, start, end, lookback)

    def get(self, name):
        from ..sources.store import frame
        d = self._read(name)
        keys = sorted(r[0] for r in d.select(F.explode(F.map_keys("labels"))).distinct().collect())
        return frame(d, keys).drop_name()


def written(spark: SparkSession, mf: MetricFrame, name: str) -> MetricFrame:
    """Write a frame to a table in the shared folder and read it back: later rules plan
    against a scan instead of the whole lineage (and survive executor loss)."""
    import re
    import uuid
    from ..session import shared_dir
    path = shared_dir(spark, f"rules/{re.sub(r'[^A-Za-z0-9_]+', '_', name)}-{uuid.uuid4().hex[:8]}")
    mf.df.write.mode("overwrite").parquet(path)
    return replace(mf, df=spark.read.parquet(path), empty=False)


ALERTS = "ALERTS"
AT_ONCE = 6           # rules that are evaluated at the same time


class Ctx:
    """What a rule's expression can ask for."""

    def __init__(self, spark: SparkSession, grid: Grid, lookback: str, run: "_Pass", group: str, reader: tuple):
        self.spark, self.grid, self.lookback = spark, grid, lookback
        self._run, self._group, self._reader = run, group, reader

    def raw(self, name: str, **matchers) -> MetricFrame:
        """Samples of ``name`` (a record, ``ALERTS`` or a source metric), matchers applied."""
        mf, _ = self._run.resolve(name, self._group, self._reader)
        return self._matching(mf, matchers)

    def _matching(self, mf: MetricFrame | None, matchers: Mapping) -> MetricFrame:
        if mf is None:
            mf = empty_frame(self.spark, sorted({k for m in matchers.values() for k in (m or {})}))
        return select(mf.drop_name(), **{k: v for k, v in matchers.items() if v})

    def sel(self, name: str, eq=None, ne=None, re=None, nre=None) -> MetricFrame:
        """Instant vector ``name{…}`` at every grid time (records of the group are already on the grid)."""
        matchers = {"eq": eq, "ne": ne, "re": re, "nre": nre}
        if self._run.on_grid(name, self._group):
            return self.raw(name, **matchers)
        key = ("instant", name, tuple((k, tuple(sorted(m.items()))) for k, m in matchers.items() if m), self.grid.step, self.lookback)
        return self._run.node(key, self, lambda c: c._run.instant(c.raw(name, **matchers), c.grid, c.lookback))

    def counted(self, name: str, slot: str, eq=None, ne=None, re=None, nre=None) -> MetricFrame:
        """Samples of a counter for rates over several ranges, each a multiple of ``slot``: their slots are summed up once."""
        matchers = {"eq": eq, "ne": ne, "re": re, "nre": nre}
        key = ("slots", name, tuple((k, tuple(sorted(m.items()))) for k, m in matchers.items() if m), slot, self.grid)
        return self._run.node(key, self, lambda c: slot_frame(c.raw(name, **matchers), c.grid, duration_ms(slot), {"first", "last", "drops"}))

    def shared(self, name: str, expr: Callable[["Ctx"], MetricFrame]) -> MetricFrame:
        """An expression that several rules use under one name: computed once where they do."""
        return self._run.node(("shared", name, self._group), self, expr)

    def _as(self, reader: tuple) -> "Ctx":
        return Ctx(self.spark, self.grid, self.lookback, self._run, self._group, reader)


def empty_frame(spark: SparkSession, labels: Sequence[str]) -> MetricFrame:
    schema = ", ".join([f"`{l}` string" for l in labels] + ["ts bigint", "value double"])
    return MetricFrame(spark.createDataFrame([], schema), tuple(labels))


@dataclass(frozen=True)
class Record:
    name: str
    expr: Callable[[Ctx], MetricFrame]
    labels: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Alert:
    name: str
    expr: Callable[[Ctx], MetricFrame]
    for_: str = "0s"
    labels: Mapping[str, str] = field(default_factory=dict)
    annotations: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class RuleGroup:
    name: str
    interval: str
    rules: Sequence[Record | Alert]


@dataclass
class GroupResult:
    records: MetricFrame | None
    alerts: DataFrame | None
    alert_labels: list


def _union(frames: Sequence[MetricFrame]) -> MetricFrame:
    labels = list(dict.fromkeys(l for f in frames for l in f.labels))
    out = None
    for f in frames:
        d = f.df
        for l in labels:
            if l not in f.labels:
                d = d.withColumn(l, F.lit(""))
        d = d.select(*labels, TS, VALUE)
        out = d if out is None else out.unionByName(d)
    return MetricFrame(out, tuple(labels))


def _clear(mf: MetricFrame) -> MetricFrame:
    """Labels named like the columns of the for-state become ``label_<name>``."""
    for name in ("state", "active_at"):
        if name in mf.labels:
            mf = MetricFrame(mf.df.withColumnRenamed(name, f"label_{name}"), tuple(f"label_{x}" if x == name else x for x in mf.labels))
    return mf


class _Pass:
    """What both passes share: rules by (group, place), the rules that record a name, and those that raise alerts."""

    def __init__(self, spark: SparkSession, groups: Sequence[RuleGroup], source: MetricSource, start, end, lookback: str):
        self.spark, self.groups, self.source, self.lookback = spark, {g.name: g for g in groups}, source, lookback
        self.grids = {g.name: Grid.range(start, end, g.interval) for g in groups}
        self.rules = {(g.name, i): r for g in groups for i, r in enumerate(g.rules)}
        self.records: dict[str, list[tuple]] = {}
        for key, r in self.rules.items():
            if isinstance(r, Record):
                self.records.setdefault(r.name, []).append(key)

    def ctx(self, key: tuple) -> Ctx:
        return Ctx(self.spark, self.grids[key[0]], self.lookback, self, key[0], ("rule", *key))

    def producers(self, name: str, reader: str) -> list[tuple]:
        """The rules whose results a name stands for: its records, the reader's group's own first."""
        own = [k for k in self.records.get(name, []) if k[0] == reader]
        return own or self.records.get(name, [])

    def on_grid(self, name: str, group: str) -> bool:
        """Whether a name's samples are the group's own evaluations: no lookback, a series that stops is gone at once."""
        if name == ALERTS:
            return all(self.grids[k[0]] == self.grids[group] for k, r in self.rules.items() if isinstance(r, Alert))
        return any(k[0] == group for k in self.records.get(name, []))


class _Trace(_Pass):
    """First pass: expressions over empty frames.  ``reads[reader]`` are the names that a rule or a node asks for,
    ``uses[node]`` counts how often a node is asked for, ``order`` is the rules in the order of what they read."""

    def __init__(self, *args):
        super().__init__(*args)
        self.reads: dict[tuple, set[str]] = {}
        self.uses: dict[tuple, int] = {}
        self.order: list[tuple] = []
        self._frames: dict[tuple[str, ...], MetricFrame] = {}
        self._labels: dict[tuple, tuple[str, ...]] = {}
        self._open: list[tuple] = []                  # rules that are being visited
        self.listeners: set[tuple] = set()            # rules that read ALERTS
        for key in self.rules:
            self._visit(key)
        quiet = [k for k in self.order if k not in self.listeners]
        self.order = quiet + [k for k in self.order if k in self.listeners]

    def _empty(self, labels: Sequence[str]) -> MetricFrame:
        labels = tuple(labels)
        if labels not in self._frames:
            self._frames[labels] = replace(empty_frame(self.spark, labels), empty=True)
        return self._frames[labels]

    def _visit(self, key: tuple) -> tuple[str, ...]:
        if key in self._labels:
            return self._labels[key]
        if key in self._open:
            raise ValueError(f"rules read each other in a circle: {[self.rules[k].name for k in self._open]}")
        self._open.append(key)
        rule = self.rules[key]
        mf = rule.expr(self.ctx(key))
        out = _record(self._empty(mf.labels), rule.name, dict(rule.labels)) if isinstance(rule, Record) else _clear(AL.alert(self._empty(mf.labels), rule.name, dict(rule.labels)))
        self._open.pop()
        self._labels[key] = out.labels
        self.order.append(key)
        return out.labels

    def resolve(self, name, group, reader):
        self.reads.setdefault(reader, set()).add(name)
        if name == ALERTS:
            self.listeners |= set(self._open[-1:])
            labels = dict.fromkeys(["alertname", "alertstate"])
            for k, r in self.rules.items():     # labels that an alert's own expression brings are known once it was visited
                if isinstance(r, Alert) and k not in self._open:
                    labels |= dict.fromkeys(self._visit(k))
            return self._empty(labels), self.on_grid(name, group)
        made = self.producers(name, group)
        if made:
            labels = dict.fromkeys(l for k in made for l in self._visit(k) if l != NAME)
            if set(made) & self.listeners:      # what reads a listener's record comes after it
                self.listeners |= set(self._open[-1:])
            return self._empty(labels), self.on_grid(name, group)
        mf = self.source.get(name)
        return (None if mf is None else self._empty(mf.drop_name().labels)), False

    def node(self, key, ctx, expr):
        self.uses[key] = self.uses.get(key, 0) + 1
        if key not in self._labels:
            self._labels[key] = expr(ctx._as(key)).labels
        return self._empty(self._labels[key])

    def instant(self, mf, grid, lookback):
        return mf


class _Run(_Pass):
    """Second pass.  Each node is made by the first reader that asks for it while the others wait; nodes
    read no nodes that read them, and rules start in the order of the first pass, so none waits for ever."""

    def __init__(self, trace: _Trace, write: bool):
        self.__dict__.update({k: getattr(trace, k) for k in ("spark", "groups", "source", "lookback", "grids", "rules", "records", "uses", "order", "listeners")})
        self.readers: dict[str, int] = {}
        for names in trace.reads.values():
            for n in names:
                self.readers[n] = self.readers.get(n, 0) + 1
        self.write = write
        self._lock = threading.Lock()
        self._made: dict[object, Future] = {}
        self.results: dict[tuple, Future] = {k: Future() for k in self.order}

    def _once(self, key, make: Callable[[], object]):
        with self._lock:
            mine = key not in self._made
            f = self._made.setdefault(key, Future())
        if mine:
            try:
                f.set_result(make())
            except BaseException as e:
                f.set_exception(e)
        return f.result()

    def resolve(self, name, group, reader):
        if name == ALERTS:
            return self._once((ALERTS, group), lambda: self._alerts()), self.on_grid(name, group)
        made = self.producers(name, group)
        if made:
            return _union([self.results[k].result() for k in made]), self.on_grid(name, group)
        mf = self.source.get(name)
        if mf is not None and self.source.derived and self.readers.get(name, 0) > 1:
            mf = self._once(("family", name), lambda: written(self.spark, mf, name))
        return mf, False

    def _alerts(self) -> MetricFrame:
        """The states of the alerts of all rules that read no states themselves."""
        series = []
        for k, r in self.rules.items():
            if isinstance(r, Alert) and k not in self.listeners:
                held, labels = self.results[k].result()
                series.append(AL.alerts_series(held, labels).drop_name())
        return _union(series) if series else empty_frame(self.spark, ["alertname", "alertstate"])

    def node(self, key, ctx, expr):
        if self.uses.get(key, 0) < 2:
            return expr(ctx)
        return self._once(key, lambda: written(self.spark, expr(ctx), str(key[1])))

    def instant(self, mf, grid, lookback):
        return instant(mf, grid, lookback)

    def evaluate(self, key: tuple) -> None:
        """A rule's result: the record, or the alert's held states with its labels; written if others read it, or if all are."""
        rule, grid = self.rules[key], self.grids[key[0]]
        try:
            mf = rule.expr(self.ctx(key))
            if isinstance(rule, Record):
                out = _record(mf, rule.name, dict(rule.labels))
                if self.write or rule.name in self.readers:
                    out = written(self.spark, out, rule.name)
            else:
                al = _clear(AL.alert(mf, rule.name, dict(rule.labels)))
                held = AL.hold(al, f"{duration_ms(rule.for_) // 1000}s", grid)
                if self.write or ALERTS in self.readers and key not in self.listeners:
                    held = written(self.spark, MetricFrame(held, al.labels), rule.name).df
                out = (held, al.labels)
            self.results[key].set_result(out)
        except BaseException as e:
            self.results[key].set_exception(e)


_graphs: dict[tuple, _Trace] = {}


def _traced(spark: SparkSession, groups: Sequence[RuleGroup], source: MetricSource, start, end, lookback: str) -> _Trace:
    """The graph of the groups over the source's families.  It does not depend on samples or times, so groups that
    are evaluated again over families of the same names keep it."""
    names = source.names()
    key = (tuple(id(g) for g in groups), names, lookback)
    if names is None or key not in _graphs:
        trace = _Trace(spark, groups, source, start, end, lookback)
        if names is not None:
            _graphs[key] = trace         # holds the groups too, so their identities stay theirs
        return trace
    kept, now = _graphs[key], _Pass(spark, groups, source, start, end, lookback)
    for k in ("reads", "uses", "order", "listeners"):
        setattr(now, k, getattr(kept, k))
    return now


def run_groups(spark: SparkSession, groups: Sequence[RuleGroup], source: MetricSource, start, end, lookback: str = "5m",
               drop_labels: Sequence[str] = (), write: bool = False) -> dict[str, GroupResult]:
    """Evaluate every rule of ``groups`` at each group's ``interval`` from start to end; results by group name.

    A group's rules may read records of any of the groups (its own first) and ``ALERTS``.  Records of another group are
    samples (the lookback holds); the group's own are on the grid.  Records of one name are unioned.  ``drop_labels``
    are removed from the records (the ruler's replica label drop).  ``write`` writes every rule's result as it is
    produced (the ruler's sink), not only what other rules read, so that a large group never becomes one plan.
    """
    run = _Run(_traced(spark, groups, source, start, end, lookback), write)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(inheritable_thread_target(spark)(run.evaluate), run.order))
    out = {}
    for g in groups:
        done = [(r, run.results[g.name, i].result()) for i, r in enumerate(g.rules)]
        recs = [x for r, x in done if isinstance(r, Record)]
        records = _union(recs) if recs else None
        if records is not None and drop_labels:
            records = MetricFrame(records.df.drop(*drop_labels), tuple(l for l in records.labels if l not in drop_labels))
        alerts = [x for r, x in done if isinstance(r, Alert)]
        labels = list(dict.fromkeys(l for _, ls in alerts for l in ls))
        held = None
        for h, ls in alerts:
            h = h.withColumns({l: F.lit("") for l in labels if l not in ls}) if set(labels) - set(ls) else h
            h = h.select(*labels, TS, VALUE, "state", "active_at")
            held = h if held is None else held.unionByName(h)
        out[g.name] = GroupResult(records, held, labels)
    return out


def run_group(spark: SparkSession, group: RuleGroup, source: MetricSource, start, end, lookback: str = "5m",
              drop_labels: Sequence[str] = (), write: bool = False) -> GroupResult:
    """``run_groups`` of one group."""
    return run_groups(spark, [group], source, start, end, lookback, drop_labels, write)[group.name]
