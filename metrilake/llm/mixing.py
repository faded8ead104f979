"""Mixing sources to target weights by capped water-filling."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, order_key, shared_table

CELL_DIGITS = 3               # 16**3 cells of the seeded order for each source


def source_targets(sizes: DataFrame, *, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """sizes (source, source_size), one row a source, with rank, weight, cap and target.

    Sources by code point, null last, take the weights in turn.  The level rises
    until the targets min(cap, level * weight) sum to share * all sizes: each
    round clamps the sources above their cap (epochs * size) and shares the
    rest out among the others by weight.  A round is one aggregate over the
    sources; the driver holds the level.  If all caps together are less, every
    source gets its cap.
    """
    ranked = sizes.withColumn("null", F.isnull("source"))
    ranked = shared_table(ranked.repartitionByRange(F.col("null"), F.col("source")).sortWithinPartitions("null", "source")
                          .withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = dict(ranked.groupBy(part.alias("p")).count().collect())  # a row a partition
    start, starts = 0, {}
    for p in sorted(counts):
        starts[p] = start
        start += counts[p]
    before = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), part) if starts else F.lit(0)
    ranked = ranked.withColumn("rank", before + F.col("at").bitwiseAND((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = shared_table(ranked.select("source", "source_size", "rank", weight.alias("weight"),
                                        (F.col("source_size") * F.lit(float(epochs))).alias("cap")), "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, last = 0.0, None
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        held, free, n = ranked.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))),
                                   F.count(F.when(over, 1))).first()
        if not free:
            level = float("inf")
            break
        if n == last:
            break
        level, last = (total * share - (held or 0.0)) / free, n
    target = F.col("cap") if level == float("inf") else F.least("cap", F.lit(level) * F.col("weight"))
    return ranked.withColumn("target", target)


def mix_plan(rows: DataFrame, *, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """rows (source, size, place) as one row a source: source_size, target, whole
    and edge, a struct (place, size).

    A row is taken whole times, and once more if its (place, size) is not above
    the edge: the prefix of the source's order whose words come nearest to what
    the target wants beyond whole epochs.  Prefix sums run over cells of the
    order (16**CELL_DIGITS a source), so a source with a third of all rows is
    spread; rows are ordered only in the one cell of a source that holds its edge.
    """
    rows = rows.withColumn("cell", F.substring("place", 1, CELL_DIGITS))
    cells = shared_table(rows.groupBy("source", "cell").agg(F.sum("size").alias("words")), "cells")
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = source_targets(sizes, weights=weights, share=share, epochs=epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = shared_table(goal.select("source", "source_size", "target", "whole", "rest"), "goal")
    until = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    met = cells.withColumn("until", until).join(goal.select(F.col("source").alias("g"), "rest"), F.col("source").eqNullSafe(F.col("g")))
    edge = (met.filter("until > rest").groupBy("g").agg(F.min(F.struct("cell", (F.col("until") - F.col("words")).alias("before"))).alias("e"))
            .select("g", F.col("e.cell").alias("edge_cell"), F.col("e.before").alias("before")))
    edge = shared_table(goal.join(edge, F.col("source").eqNullSafe(F.col("g")), "left").drop("g"), "edge")
    order = Window.partitionBy("source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("source", "cell", "place", "size").join(
        edge.filter("edge_cell is not null").select(F.col("source").alias("s"), "edge_cell", "before", "rest"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("edge_cell")))
    ahead = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = (inside.withColumn("ahead", ahead).filter(F.col("ahead") + F.col("size") / 2 < F.col("rest"))
            .groupBy("s").agg(F.max(F.struct("place", "size")).alias("last")))
    plan = edge.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    # before the edge cell's first row; all rows ("g" follows the hexadecimal digits) where no cell holds an edge
    before = F.struct(F.coalesce("edge_cell", F.lit("g")).alias("place"), F.lit(-1).cast("long").alias("size"))
    return shared_table(plan.select("source", "source_size", "target", "whole", F.coalesce("last", before).alias("edge")), "mix")


def _rows(docs: DataFrame, seed: str, text: str, key: str, source: str) -> list:
    return [F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            order_key(key, seed).alias("place")]


def _repeats():
    return F.col("whole") + (F.struct("place", "size") <= F.col("edge")).cast("long")


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0,
        seed: str = "mix", text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Every row of docs with what the mix takes of it.

    Returns <key>, source, size long (words of the text), source_size long,
    target double (its source's), repeats long (times the row is taken) and
    taken long (size * repeats).

    A source whose target is e times its size takes each row floor(e) times,
    and rows in a seeded order once more until the rest is reached; the row at
    the edge is taken when more than half of it is wanted, so a source misses
    its target by half a row at most.  The order hashes seed and key: reruns
    agree.  Null texts and texts without words have size 0.  Null sources form
    one source, the last.  Rows with equal or null keys share a place in the
    order, smaller sizes first, equal ones together.  An empty table gives an
    empty result; other columns are ignored.
    """
    rows = shared_table(docs.select(F.col(key).alias("key"), *_rows(docs, seed, text, key, source)), "sized")
    plan = mix_plan(rows, weights=weights, share=share, epochs=epochs).withColumnRenamed("source", "_source")
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    return out.select(F.col("key").alias(key), "source", "size", "source_size", "target", _repeats().alias("repeats"),
                      (F.col("size") * _repeats()).alias("taken"))


def mixed(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0,
          seed: str = "mix", text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs as the mix takes them: each row as often as mix says, all columns.

    Decisions follow from a row's source, size and key, so texts are not
    shuffled while the sources' plan is small enough for Spark to broadcast.
    """
    row = _rows(docs, seed, text, key, source)
    sized = shared_table(docs.select(*row), "sized")
    plan = mix_plan(sized, weights=weights, share=share, epochs=epochs)
    plan = plan.withColumnRenamed("source", "_source")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *row)
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select("row", _repeats().cast("int").alias("repeats"))
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("repeats")))).select("row.*")
