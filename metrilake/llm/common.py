"""Helpers shared by the corpus operators: written tables, groups in Arrow
batches, connected components and links within groups."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrilake.session import shared_dir

#: Words end at space, \t \n \v \f \r, as Python's bytes.split() has it.
WORD = r"[^\x20\x09-\x0D]+"
#: The runs of blanks that one space does not equal already.
ODD_BLANK = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
BATCH_ROWS = 1000             # whole texts that a Python worker receives at once

FILTER_BITS = 25              # size of maybe_in's bitmap: 4 MB whatever the data

#: Odd 64-bit constants of the splitmix64 finaliser (public domain, S. Vigna).
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """Mixes unsigned 64-bit integers (a bijection)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def seeds64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random unsigned 64-bit integers."""
    base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(base + np.uint64(seed))


def small_batches(spark: SparkSession) -> None:
    """Sends whole texts to Python in batches of BATCH_ROWS rows at most, so that
    a worker's memory follows a batch of texts, not Spark's 10,000 rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def normal(text: Column) -> Column:
    """Every run of blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ODD_BLANK, " ")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the cluster's shared folder and reads it back.

    Cuts the lineage: what follows survives lost executors without running
    the steps above again, and row ids made above stay as they were written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of a partition sorted by them, one table a run.

    Holds one run and one batch; keys are integers without nulls.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(int(c[a]) for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    pa.default_memory_pool().release_unused()


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest
    node reachable.

    Contraction: every node moves to its least neighbour or itself, edges are
    drawn between the places reached, until none is left.  Least by number in
    even rounds (a star vanishes at once), by a hash of the round in odd ones
    (a long path shrinks by a constant factor).  Tables of a round are written
    to the shared folder; the driver learns only whether edges are left.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    rounds: list[DataFrame] = []
    edges = shared_table(edges, f"{name}-edges")
    while not edges.isEmpty():
        by = (lambda c: F.col(c)) if len(rounds) % 2 == 0 else (lambda c, r=len(rounds): F.xxhash64(c, F.lit(r)))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(F.struct(by("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        to = shared_table(to.select(F.col("a").alias("node"),
                                    F.least(F.struct(by("a").alias("h"), F.col("a").alias("n")), "m")["n"].alias("to")),
                          f"{name}-to")
        rounds.append(to)
        at = (edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
              .join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b"))
        edges = shared_table(
            at.filter("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(),
            f"{name}-edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].select("node", F.col("to").alias("at"))
    for to in rounds[1:]:
        nxt = to.select(F.col("node").alias("at"), F.col("to").alias("_to"))
        out = out.join(nxt, "at", "left").select("node", F.coalesce("_to", "at").alias("at"))
    if len(rounds) > 1:
        out = shared_table(out, f"{name}-at")
    least = out.groupBy("at").agg(F.min("node").alias("root"))
    return out.join(least, "at").select("node", "root")


def forest(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node it is connected to) of the boolean matrix
    rows x cols: one at most for each node."""
    nodes, at = np.unique(np.concatenate([rows, cols]), return_inverse=True)
    ri, ci = at[: len(rows)], at[len(rows):]
    far = len(nodes)
    label = np.arange(far)
    while True:
        new = label.copy()
        np.minimum.at(new, ri, np.where(linked, label[ci][None, :], far).min(axis=1))
        np.minimum.at(new, ci, np.where(linked, label[ri][:, None], far).min(axis=0))
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(far))
    return nodes[moved], nodes[label[moved]]


def group_links(members: DataFrame, payloads: DataFrame, compare: Callable[[list, list], np.ndarray], *,
                most: int, name: str) -> DataFrame:
    """Edges (a, b) that connect, within each group, what ``compare`` connects.

    members: grp long, uid long, weight long (>= 1).  payloads: uid, payload binary.
    compare(left payloads, right payloads) gives a boolean matrix.

    Groups of a weight up to ``most`` are compared in one task.  A larger group
    is dealt by hash into blocks of about that weight; its first block is
    compared with every block, which is linear in the group.  Then only members
    outside the group's largest class so far are compared with every block.
    Pairs never compared lie inside one class already, so the classes are
    exact; no task holds more than two blocks, and no pairs are emitted, only
    edges that join classes.
    """
    size = members.groupBy("grp").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("m"))
    size = size.filter("m > 1").select("grp", F.ceil(F.col("w") / F.lit(most)).cast("int").alias("nb"))
    m = shared_table(members.join(size, "grp").withColumn("blk", F.pmod(F.xxhash64("uid"), F.col("nb")).cast("int")),
                     f"{name}-members")
    one = m.filter("nb = 1").select("grp", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(2).alias("side"), "uid")
    many = m.filter("nb > 1")
    pivot = many.filter("blk = 0").select(
        "grp", F.lit(0).alias("x"), F.explode(F.expr("sequence(0, nb - 1)")).alias("y"), F.lit(0).alias("side"), "uid")
    rest = many.select("grp", F.lit(0).alias("x"), F.col("blk").alias("y"), F.lit(1).alias("side"), "uid")
    first = shared_table(_compared(one.unionByName(pivot).unionByName(rest), payloads, compare), f"{name}-first")
    if many.isEmpty():
        return first
    label = components(first, f"{name}-cc")
    thin = (many.join(label.withColumnRenamed("node", "uid"), "uid", "left")
            .select("grp", "uid", "weight", "nb", F.coalesce("root", "uid").alias("root")))
    main = (thin.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("main")))
    out = shared_table(thin.join(main, "grp").filter("root <> main").drop("root", "main"), f"{name}-outside")
    blocks = out.groupBy("grp").agg(F.ceil(F.sum("weight") / F.lit(most)).cast("int").alias("no"))
    left = (out.join(blocks, "grp").withColumn("x", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("no")).cast("int"))
            .select("grp", "x", F.explode(F.expr("sequence(0, nb - 1)")).alias("y"), F.lit(0).alias("side"), "uid"))
    right = (many.join(blocks, "grp")
             .select("grp", F.explode(F.expr("sequence(0, no - 1)")).alias("x"), F.col("blk").alias("y"),
                     F.lit(1).alias("side"), "uid"))
    return first.unionByName(shared_table(_compared(left.unionByName(right), payloads, compare), f"{name}-second"))


def _compared(dealt: DataFrame, payloads: DataFrame, compare: Callable[[list, list], np.ndarray]) -> DataFrame:
    """dealt: grp, x, y, side (0 left, 1 right, 2 both), uid; edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["grp", "x", "y"]):
            side, uid = t["side"].to_numpy(), t["uid"].to_numpy()
            li, ri = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if not len(li) or not len(ri):
                continue
            held = t["payload"].to_pylist()
            a, b = forest(compare([held[i] for i in li], [held[i] for i in ri]), uid[li], uid[ri])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return (dealt.join(payloads, "uid").select("grp", "x", "y", "side", "uid", "payload")
            .repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")
            .mapInArrow(run, "a long, b long"))


def maybe_in(fps: DataFrame) -> Callable[[str], Column]:
    """A column function that is true for every fp of fps, and for few others.

    A bitmap of 2**FILTER_BITS bits with two places a fingerprint; its size does
    not grow with the data.  It spares a shuffle of whole texts where few of
    them are wanted; when it fills up, more than those are shuffled, and the
    join behind it gives the same result.
    """
    mask = (1 << FILTER_BITS) - 1
    place = F.explode(F.array(F.col("fp").bitwiseAND(mask), F.shiftright("fp", 32).bitwiseAND(mask)))
    words = (fps.select(place.alias("p"))
             .groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("m"))
             .toArrow())
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)
    held = fps.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(fp):
        import pandas as pd

        x = fp.to_numpy()
        b = held.value
        ok = np.ones(len(x), bool)
        for p in (x & mask, (x >> 32) & mask):
            ok &= (b[p >> 5] >> (p & 31).astype(np.uint32)) & 1 > 0
        return pd.Series(ok)

    return maybe


def order_key(column: str | Column, seed: str) -> Column:
    """Hexadecimal digits that order values by chance, the same in each run and engine."""
    c = F.col(column) if isinstance(column, str) else column
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(c.cast("string"), F.lit("null"))))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
