"""Sharding by minimax contiguous partition (DataFrame and SQL functions only)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import shared_table

ATOM_BITS = 16                # at most 2**16 ordered atoms
CELLS = 64                    # parts of an atom, for numbering its rows

#: Shards that a greedy pass over the ordered sizes needs for a capacity.
_NEED = """aggregate(sizes, named_struct('n', 1L, 'fill', 0L),
  (g, x) -> if(g.fill + x <= {cap}, named_struct('n', g.n, 'fill', g.fill + x), named_struct('n', g.n + 1L, 'fill', x)),
  g -> g.n)"""


def capacity_and_cuts(atoms: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for which the atoms (atom, bytes), in order, fit
    into so many shards, and the first atom of each shard but the first.

    Binary search between the larger of the mean and the largest atom, and the
    mean plus the largest atom, where a greedy pass always fits.  Among the
    partitions of that capacity each cut comes as near to even parts as it may:
    never before the cut of a greedy pass from the right, so the rest still
    fits.  Runs as SQL expressions over the array of at most 2**ATOM_BITS sizes.
    """
    one = atoms.agg(F.sort_array(F.collect_list(F.struct("atom", "bytes"))).alias("a"))
    one = one.selectExpr("a", "transform(a, x -> x.bytes) as sizes")
    one = one.selectExpr("a", "sizes", "coalesce(array_max(sizes), 0L) as top", f"cast(ceil(coalesce(aggregate(sizes, 0L, (s, x) -> s + x), 0L) / {shards}) as long) as mean")
    step = (f"transform(array((s.lo + s.hi) div 2), mid -> if({_NEED.format(cap='mid')} <= {shards}, "
            "named_struct('lo', s.lo, 'hi', mid), named_struct('lo', mid + 1L, 'hi', s.hi)))[0]")
    one = one.selectExpr("a", f"aggregate(sequence(1, 63), named_struct('lo', greatest(top, mean), 'hi', mean + top), (s, i) -> if(s.lo >= s.hi, s, {step}), s -> s.hi) as cap")
    one = one.selectExpr("a", "cap", "aggregate(a, 0L, (s, x) -> s + x.bytes) as total", """reverse(aggregate(reverse(a),
        named_struct('fill', 0L, 'next', -1L, 'cuts', cast(array() as array<long>)),
        (g, x) -> if(g.fill + x.bytes <= cap, named_struct('fill', g.fill + x.bytes, 'next', x.atom, 'cuts', g.cuts),
                     named_struct('fill', x.bytes, 'next', x.atom, 'cuts', array_append(g.cuts, g.next))), g -> g.cuts)) as back""")
    # the i-th cut from the right's greedy pass is as early as the i-th cut may come
    one = one.selectExpr("a", "cap", "total", f"concat(array_repeat(-1L, {shards} - 1 - size(back)), back) as early")
    even = f"(total - g.done + g.fill) / ({shards} - size(g.cuts))"  # what is left by the shards left
    cut = (f"g.fill + x.bytes > cap or (size(g.cuts) < {shards} - 1 and g.fill > 0 and g.fill + x.bytes / 2 >= {even} "
           "and x.atom >= early[size(g.cuts)])")
    row = one.selectExpr("cap", f"""aggregate(a, named_struct('done', 0L, 'fill', 0L, 'cuts', cast(array() as array<long>)),
        (g, x) -> if({cut}, named_struct('done', g.done + x.bytes, 'fill', x.bytes, 'cuts', array_append(g.cuts, x.atom)),
                     named_struct('done', g.done + x.bytes, 'fill', g.fill + x.bytes, 'cuts', g.cuts)), g -> g.cuts) as cuts""").first()
    return int(row["cap"] or 0), list(row["cuts"] or [])


def shard(docs: DataFrame, *, shards: int = 40, overhead: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of docs with its shard, 0 to shards - 1, and slot within it.

    Returns <key>, size long (UTF-8 bytes of the text plus overhead),
    text_crc32 long, law string ('bytes'), shard int, slot long (gapless from 0
    in each shard), grown_shard int (null: this law makes no promise for one
    more shard).

    Equal texts are one group and share a shard.  Groups are ordered by a hash
    of the text; atoms are ranges of that hash, at most 2**ATOM_BITS whatever
    the data, so an atom is one group until there are about as many groups, and
    a few neighbours after that.  The largest shard is as small as a contiguous
    partition of the atoms allows.  Null counts as the empty text (size:
    overhead, crc 0).  A single group larger than the mean shard keeps its
    shard to itself as far as the order allows.  Repeated rows and null keys
    are ordinary rows.  An empty table gives an empty result; other columns
    are ignored.

    Rows are numbered within cells of an atom (by a hash of the key), so a
    group with a third of all rows is spread over many tasks.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    hashed = F.xxhash64(body)
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("crc"),
                       F.shiftrightunsigned(hashed, 64 - ATOM_BITS).alias("atom"),
                       F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(CELLS)).alias("cell"), hashed.alias("hash"))
    rows = shared_table(rows, "sized")
    cells = shared_table(rows.groupBy("atom", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "cells")
    atoms = shared_table(cells.groupBy("atom").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), "atoms")
    _, cuts = capacity_and_cuts(atoms.select("atom", "bytes"), shards)
    first = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    of = F.size(F.filter(first, lambda c: c <= F.col("atom")))
    in_shard = F.sum("n").over(Window.partitionBy("shard").orderBy("atom")) - F.col("n")  # at most 2**ATOM_BITS rows
    placed = atoms.withColumn("shard", of).select("atom", "shard", in_shard.alias("before"))
    in_atom = F.sum("n").over(Window.partitionBy("atom").orderBy("cell")) - F.col("n")
    starts = cells.withColumn("skip", in_atom).join(placed, "atom").select("atom", "cell", "shard", (F.col("before") + F.col("skip")).alias("start"))
    number = F.row_number().over(Window.partitionBy("atom", "cell").orderBy("hash", "key")) - 1
    return rows.join(starts, ["atom", "cell"]).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + number).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
