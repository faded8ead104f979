"""Embedding near-dedup by sorted projection passes.

A pass hashes every vector to a string of random-hyperplane bits, orders the
vectors of a label by it and compares each with a bounded window of its
neighbours.  Pairs that reach the cosine join classes; the union over all
passes gives components, inside which links are then counted exactly.

A pass also measures, for each row, how many leading bits it takes until no more
rows than a window share them.  A pair at the cosine agrees in that many bits
with a known chance, and is then compared; so each row knows the chance that
all its passes missed a partner of it, and takes part until that is below MISS.
Rows that are still too crowded after ROUNDS are compared with each other whole.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, group_links, groups, shared_table

BITS = 63                     # bits of an order key
WINDOW = 256                  # neighbours that a vector is compared with on either side
MISS = 1e-5                   # chance that no pass brings a pair at the threshold close
ROUNDS = (4, 4, 8, 16, 32)    # passes in one job
BLOCK = 1024                  # vectors of a component that are compared with as many others at once


def unit(vector, scale_first: bool = True) -> bytes | None:
    """The vector's direction in doubles; none if it is null, zero, empty or holds null or non-finite components."""
    if vector is None:
        return None
    x = np.array([np.nan if v is None else v for v in vector] if not isinstance(vector, np.ndarray) else vector, np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return (x / np.sqrt((x * x).sum())).tobytes()


def prefix_depths(grp: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """For rows in the order of (grp, key): leading bits after which at most window + 1
    rows, the row's own included, share them; BITS + 1 if even whole keys are shared by more."""
    lag = window + 1
    n = len(key)
    if n <= lag:
        return np.zeros(n, np.int64)
    x = key[:-lag] ^ key[lag:]
    high, low = x >> 32, x & 0xFFFFFFFF
    size = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1])
    crowded = np.where(grp[:-lag] == grp[lag:], BITS - size + 1, 0)
    edge = np.zeros(lag, np.int64)  # a row's run starts at most lag places before it
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, crowded, edge]), lag + 1).max(axis=1)


def nearness(grp: np.ndarray, key: np.ndarray, cosine: float, window: int) -> np.ndarray:
    """For the rows of a partition, in order (grp: the run of a pass and group that a row is in): a bound on the chance
    that its pass compares a row with a partner at the cosine.  What lies beyond the partition counts as sharing all
    bits with the row at its edge."""
    if not len(key):
        return np.zeros(0)
    lag = window + 1
    grp, key = (np.concatenate([np.full(lag, x[0]), x, np.full(lag, x[-1])]) for x in (grp, key))
    depth = prefix_depths(grp, key, window)[lag:-lag]
    return np.where(depth > BITS, 0.0, (1 - math.acos(cosine) / math.pi) ** depth)


def sparse_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the edges a-b, without the smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _window_edges(x: np.ndarray, uid: np.ndarray, grp: np.ndarray, cosine: float, window: int, across: int | None = None):
    """Links between rows at most ``window`` apart and of one group; with
    ``across``, only between rows before and from that place."""
    found = []
    n = len(uid)
    step = 1024
    for at in range(0, n, step):
        end = min(n, at + step)
        far = min(n, end + window)
        sim = x[at:end] @ x[at:far].T
        i, j = np.nonzero(sim >= cosine)
        i, j = i + at, j + at
        ok = (j > i) & (j - i <= window) & (grp[i] == grp[j])
        if across is not None:
            ok &= (i < across) & (j >= across)
        found.append((uid[i[ok]], uid[j[ok]]))
    a, b = (np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    return sparse_forest(a, b) if len(a) else (a, b)


def _sorted_pass_edges(keyed: DataFrame, cosine: float, window: int) -> tuple[DataFrame, DataFrame]:
    """keyed: pass, grp, key, uid, payload; edges (a, b) of all passes, and (uid, missed): log of the chance that they
    all missed a partner of the row.

    Rows at the edges of a partition of the order go to a second step, which
    compares the end of each with the start of the next.
    """
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        tail = None
        head: list[pa.RecordBatch] = []
        heads = 0
        thin: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            if not batch.num_rows:
                continue
            for held, c in zip(thin, ("pass", "grp", "uid", "key")):
                held.append(batch.column(c).to_numpy())
            batch = batch.drop_columns("key")
            if heads < window:
                head.append(batch.slice(0, window - heads))
                heads += head[-1].num_rows
            t = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            yield from _edges(t, cosine, window)
            tail = t.slice(max(0, t.num_rows - window)).combine_chunks()
        if tail is not None:
            for border, side, t in ((place, 1, pa.Table.from_batches(head)), (place + 1, 0, tail)):
                n = t.num_rows
                yield from pa.table([pa.array([None] * n, pa.int64())] * 2 + [pa.array(np.full(n, border, np.int64)), pa.array(np.full(n, side, np.int32)),
                                    pa.array(np.arange(n, dtype=np.int64)), t["pass"], t["grp"], t["uid"], t["payload"], pa.nulls(n, pa.float64())], names=names).to_batches()
            number, grp, uid, key = (np.concatenate(x) for x in thin)
            runs = np.cumsum(np.diff(number, prepend=number[0]).astype(bool) | np.diff(grp, prepend=grp[0]).astype(bool))
            with np.errstate(divide="ignore"):
                missed = np.maximum(np.log1p(-nearness(runs, key, cosine, window)), -1e3)
            void = pa.nulls(len(uid))
            yield pa.RecordBatch.from_arrays([*[void.cast(schema.field(c).type) for c in names[:7]], pa.array(uid), void.cast(pa.binary()), pa.array(missed)], names)

    def _edges(t: pa.Table, cosine: float, window: int, across: int | None = None) -> Iterator[pa.RecordBatch]:
        pay = t["payload"].to_pylist()
        size = np.array([len(p) for p in pay])
        grp = t["grp"].to_numpy()
        uid = t["uid"].to_numpy()
        for d in np.unique(size):  # one length of vector in a group
            rows = np.flatnonzero(size == d)
            x = np.frombuffer(b"".join([pay[r] for r in rows]), np.float64).reshape(len(rows), -1)
            cut = None if across is None else int((rows < across).sum())
            a, b = _window_edges(x, uid[rows], grp[rows], cosine, window, cut)
            if len(a):
                n = len(a)
                void = pa.nulls(n)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[void.cast(schema.field(c).type) for c in names[2:]]], names)

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["border"]):
            t = t.sort_by([("side", "ascending"), ("at", "ascending")])
            cut = int((t["side"].to_numpy() == 0).sum())
            if 0 < cut < t.num_rows:
                for e in _edges(t, cosine, window, cut):
                    yield e.select(["a", "b"])

    names = ["a", "b", "border", "side", "at", "pass", "grp", "uid", "payload", "missed"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("border", pa.int64()), ("side", pa.int32()), ("at", pa.int64()),
                        ("pass", pa.int32()), ("grp", pa.int64()), ("uid", pa.int64()), ("payload", pa.binary()), ("missed", pa.float64())])
    ddl = "a long, b long, border long, side int, at long, pass int, grp long, uid long, payload binary, missed double"
    ordered = keyed.repartitionByRange("pass", "grp", "key", "uid").sortWithinPartitions("pass", "grp", "key", "uid")
    both = shared_table(ordered.select("pass", "grp", "uid", "key", "payload").mapInArrow(inner, ddl), "pass")
    within = both.filter("a is not null").select("a", "b")
    between = both.filter("border is not null").repartition("border").sortWithinPartitions("border").mapInArrow(border, "a long, b long")
    return within.unionByName(between).distinct(), both.filter("missed is not null").groupBy("uid").agg(F.sum("missed").alias("missed"))


def sorted_passes(thin: DataFrame, *, cosine: float, window: int, seed: int, rounds: tuple[int, ...] = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """thin: grp, uid, payload; edges (a, b) that the passes find, and the rows of thin that are left after them.

    A row takes part until its partners are missed with a chance below MISS.  That bound is the row's own, so a pair
    needs only one of its rows to reach it: rows that go on are compared among themselves.
    """
    left, edges, missed, first = thin, None, None, 0
    for n in rounds:
        keyed = left.mapInArrow(_keys(list(range(first, first + n)), seed), "pass int, grp long, key long, uid long, payload binary")
        found, more = _sorted_pass_edges(keyed, cosine, window)
        found = shared_table(found, "found")
        edges = found if edges is None else edges.unionByName(found)
        missed = more if missed is None else missed.unionByName(more).groupBy("uid").agg(F.sum("missed").alias("missed"))
        missed = shared_table(missed.filter(F.col("missed") > math.log(MISS)), "missed")
        left = thin.join(missed.select("uid"), "uid", "left_semi").select("grp", "uid", "payload")
        first += n
        if missed.isEmpty():
            break
    return edges, left


def near_vectors(vectors: DataFrame, *, cosine: float = 0.93, embedding: str = "embedding", label: str = "label", key: str = "vec_id",
                 window: int = WINDOW, seed: int = 5) -> DataFrame:
    """Every row of vectors with its links and component.

    Returns <key>, n_links long (other rows linked directly), component_id long
    (the smallest <key> reachable over links, its own included), kept boolean
    (<key> = component_id).

    Rows link when their labels are equal and not null, their vectors have the
    same length and the cosine in double precision is at least ``cosine``.
    Null, empty and zero vectors and those with null or non-finite components
    link with nothing.  Equal vectors of a label are one class that stands for
    all its copies, however many.  Rows with a null key take part; they are a
    component's id only if no row of it has a key (then null and not kept).
    An empty table gives an empty result; other columns are ignored.

    A pair at the threshold is missed by all passes with a chance below MISS (two
    vectors agree in a hyperplane's bit with a chance of 1 - angle / pi, wherever
    they lie); rows too crowded for that after all rounds are compared with
    each other whole, block against block.  Links are counted exactly within
    components, block against block, so windows do not cap them.
    """
    src = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("key"),
                         F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = [None if lab is None else unit(v) for lab, v in zip(batch.column("label").to_pylist(), batch.column("v").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("key"), batch.column("label"), pa.array(body, pa.binary())],
                                             ["uid", "key", "label", "payload"])

    rows = src.mapInArrow(units, "uid long, key long, label string, payload binary")
    t = shared_table(rows.withColumn("grp", F.xxhash64("label", F.length("payload"))), "units")
    good = t.filter("payload is not null")
    classes = shared_table(good.groupBy("grp", "label", "payload").agg(F.min("uid").alias("rep"), F.min("key").alias("least"),
                                                                      F.count(F.lit(1)).alias("copies")), "vectors")
    thin = classes.select("grp", F.col("rep").alias("uid"), "payload")
    def linked(left: list[bytes], right: list[bytes]) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(side), np.float64).reshape(len(side), -1) for side in (left, right))
        return x @ y.T >= cosine

    edges, left = sorted_passes(thin, cosine=cosine, window=window, seed=seed)
    edges = edges.unionByName(group_links(left.select("grp", "uid", F.lit(1).cast("long").alias("weight")), thin.select("uid", "payload"), linked,
                                          most=2 * BLOCK, name="vectors"))
    root = shared_table(components(edges, "vec"), "roots")

    # exact counts within components
    member = (classes.join(root, classes["rep"] == root["node"])
              .select("root", F.col("rep").alias("uid"), "copies", "payload"))
    blocks = member.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("nb"))
    dealt = (member.join(blocks, "root").withColumn("blk", F.pmod(F.xxhash64("uid"), F.col("nb")).cast("int"))
             .withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
             .select("root", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), "blk", "uid", "copies", "payload"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["root", "x", "y"]):
            blk, uid, copies = g["blk"].to_numpy(), g["uid"].to_numpy(), g["copies"].to_numpy()
            v = np.frombuffer(b"".join(g["payload"].to_pylist()), np.float64).reshape(len(uid), -1)
            x, y = g["x"][0].as_py(), g["y"][0].as_py()
            li, ri = np.flatnonzero(blk == x), np.flatnonzero(blk == y)
            if not len(li) or not len(ri):
                continue
            linked = v[li] @ v[ri].T >= cosine
            if x == y:
                np.fill_diagonal(linked, False)  # a class's own copies are added once, below
                out = [(uid[li], linked @ copies[ri])]
            else:
                out = [(uid[li], linked @ copies[ri]), (uid[ri], copies[li] @ linked)]
            for u, n in out:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n.astype(np.int64))], ["uid", "n"])

    links = (dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
             .mapInArrow(count, "uid long, n long").groupBy("uid").agg(F.sum("n").alias("n")))
    whole = (classes.join(root.withColumnRenamed("node", "rep"), "rep", "left").join(links.withColumnRenamed("uid", "rep"), "rep", "left")
             .select("rep", "grp", "label", "payload", "least", F.coalesce("root", "rep").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")))
    whole = shared_table(whole, "whole")
    comp = whole.groupBy("root").agg(F.min("least").alias("component"))
    placed = whole.join(comp, "root").select("grp", "label", "payload", "n", "component")
    out = (good.join(placed, ["grp", "label", "payload"]).select("key", "n", "component")
           .unionByName(t.filter("payload is null").select("key", F.lit(0).cast("long").alias("n"), F.col("key").alias("component"))))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_links"), F.col("component").alias("component_id"),
                      F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"))


def _keys(numbers: list[int], seed: int):
    """Order keys of the passes: BITS random-hyperplane bits, the first highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weight = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            pay = batch.column("payload").to_pylist()
            size = np.array([len(p) for p in pay])
            for d in np.unique(size) if len(size) else []:
                at = np.flatnonzero(size == d)
                x = np.frombuffer(b"".join([pay[i] for i in at]), np.float64).reshape(len(at), -1)
                part = batch.take(pa.array(at))
                for n in numbers:
                    if (n, int(d)) not in planes:
                        planes[n, int(d)] = np.random.default_rng([seed, n, int(d)]).standard_normal((int(d) // 8, BITS))
                    key = ((x @ planes[n, int(d)]) > 0) @ weight
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), n, np.int32)), part.column("grp"), pa.array(key), part.column("uid"), part.column("payload")],
                        ["pass", "grp", "key", "uid", "payload"])

    return run
