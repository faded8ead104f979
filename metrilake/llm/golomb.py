"""Exact dedup by Golomb-coded fingerprint exchange.

Sources (blocks of rows) send each owner of a fingerprint range the sorted
distinct fingerprints they hold, as Rice-coded gaps; owners answer with a
bitmap of those that occur elsewhere too or more than once; only rows whose
bit is set (suspects) have their texts compared byte by byte, by the smallest
and largest text of each group.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, maybe_in, normal, shared_table, small_batches

BLOCK_BITS = 20               # at most 2**20 rows are one source
OWNER_ROWS = 1 << 21          # about so many rows' fingerprints meet in one owner


def rice_encode(sorted_values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """(first value, bits of a remainder, unary quotients, remainders) of
    strictly increasing unsigned 64-bit integers: the Golomb code with a power
    of two near the mean gap as its divisor."""
    first = int(sorted_values[0])
    gaps = np.diff(sorted_values) - np.uint64(1)
    if not len(gaps):
        return first, 0, b"", b""
    mean = float(gaps.astype(np.float64).mean())
    k = min(62, max(0, int(np.log2(mean * 0.6931 + 1e-9)) if mean > 1 else 0))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    rest = np.empty((len(gaps), k), np.uint8)
    for i in range(k):
        rest[:, i] = (gaps >> np.uint64(k - 1 - i)) & np.uint64(1)
    return first, k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def rice_decode(n: int, first: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = first
    if n > 1:
        ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[: n - 1]
        gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
        if k:
            bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=(n - 1) * k).reshape(n - 1, k)
            for i in range(k):
                gaps |= bits[:, i].astype(np.uint64) << np.uint64(k - 1 - i)
        out[1:] = np.uint64(first) + np.cumsum(gaps + np.uint64(1), dtype=np.uint64)
    return out


def owner_of(fp: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges of unsigned fingerprints, in order."""
    return (((fp >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


def suspects(prints: DataFrame, owners: int) -> DataFrame:
    """uid of the rows of prints (uid, fp) whose fingerprint occurs more than once.

    uid's upper bits name the source: uid >> BLOCK_BITS.
    """
    rows = prints.select(F.shiftright("uid", BLOCK_BITS).alias("src"), "uid", "fp")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["src"]):
            fp, count = np.unique(t["fp"].to_numpy().view(np.uint64), return_counts=True)
            to = owner_of(fp, owners)
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(fp)]):
                first, k, unary, rest = rice_encode(fp[a:b])
                yield pa.RecordBatch.from_pydict({
                    "src": [t["src"][0].as_py()], "owner": [int(to[a])], "n": [int(b - a)], "first": [int(np.uint64(first).view(np.int64))],
                    "k": [k], "unary": [unary], "rest": [rest], "again": [np.packbits(count[a:b] > 1).tobytes()]}, schema=sent)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["owner"]):
            got, again = [], []
            for m in t.to_pylist():
                got.append(rice_decode(m["n"], m["first"] % 2 ** 64, m["k"], m["unary"], m["rest"]))
                again.append(np.unpackbits(np.frombuffer(m["again"], np.uint8), count=m["n"]))
            known, at, count = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
            more = count > 1
            more[at[np.concatenate(again) > 0]] = True
            end = 0
            for src, g in zip(t["src"].to_pylist(), got):
                bits = more[at[end:end + len(g)]]
                end += len(g)
                if bits.any():
                    yield pa.RecordBatch.from_pydict(
                        {"src": [src], "owner": [t["owner"][0].as_py()], "n": [len(g)], "bits": [np.packbits(bits).tobytes()]}, schema=back)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["src"]):
            own = t.filter(pc.is_null(t["bits"]))
            fp = own["fp"].to_numpy().view(np.uint64)
            known, at = np.unique(fp, return_inverse=True)
            to = owner_of(known, owners)
            flag = np.zeros(len(known), bool)
            for m in t.filter(pc.is_valid(t["bits"])).select(["owner", "n", "bits"]).to_pylist():
                a = np.searchsorted(to, m["owner"])
                flag[a:a + m["n"]] = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["n"]) > 0
            uid = own["uid"].to_numpy()[flag[at]]
            if len(uid):
                yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64())], ["uid"])

    sent = pa.schema([("src", pa.int64()), ("owner", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("k", pa.int32()),
                      ("unary", pa.binary()), ("rest", pa.binary()), ("again", pa.binary())])
    back = pa.schema([("src", pa.int64()), ("owner", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
    messages = (rows.repartition("src").sortWithinPartitions("src")
                .mapInArrow(send, "src long, owner long, n long, first long, k int, unary binary, rest binary, again binary"))
    replies = (messages.repartition("owner").sortWithinPartitions("owner")
               .mapInArrow(answer, "src long, owner long, n long, bits binary"))
    none = F.lit(None)
    both = (rows.withColumns({"owner": none.cast("long"), "n": none.cast("long"), "bits": none.cast("binary")})
            .unionByName(replies.withColumns({"uid": none.cast("long"), "fp": none.cast("long")})))
    return both.repartition("src").sortWithinPartitions("src").mapInArrow(pick, "uid long")


def exact_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of docs with the row that stays of its group of equal texts.

    Returns <key>, keep_id long (the key of the row that stays), group_size
    long, kept boolean, text_sha256 string (of the normalised text).

    Texts are equal when identical after replacing each run of space and
    \\t\\n\\v\\f\\r by one space; null counts as empty, so null and empty texts
    are one group (blanks alone are another: one space).  The smallest key
    stays, null keys come last; of repeated rows one stays.  Groups of any size
    are fine: a source sends a fingerprint once, a map task two texts a group.  Other columns are ignored; an empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(key).alias("key"), normal(F.col(text)).alias("norm"))
    t = shared_table(src.select(F.monotonically_increasing_id().alias("uid"), "key", F.xxhash64("norm").alias("fp"),
                                F.unhex(F.sha2("norm", 256)).alias("sha")), "prints")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = max(width, -(-t.count() // OWNER_ROWS))
    found = shared_table(t.join(suspects(t.select("uid", "fp"), owners), "uid"), "suspects")
    order = F.struct(F.isnull("key").alias("null"), "key", "uid")
    least = found.groupBy("fp", "sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))
    group = shared_table(least.filter("size > 1").select("fp", "sha", F.col("first.key").alias("keep"),
                                                         F.col("first.uid").alias("keep_uid"), "size"), "groups")

    # byte verification: a group is whole if its smallest text is its largest; both are aggregated before anything
    # is joined, so a map task sends two texts a group, however many rows it has; rows that are no suspects are not normalised
    maybe = maybe_in(found.select(F.xxhash64("key").alias("fp")))
    texts = (docs.withColumn("_asked", F.xxhash64(F.col(key))).filter(maybe("_asked"))
             .select(F.col(key).alias("key"), normal(F.col(text)).alias("norm"))
             .select("key", "norm", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")))
    ends = texts.groupBy("fp", "sha").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    wrong = shared_table(ends.filter("low <> high").select("fp", "sha"), "wrong")
    out = (t.join(group, ["fp", "sha"], "left")
           .select("uid", "key", "fp", "sha", F.coalesce("keep", "key").alias("keep_id"), F.coalesce("size", F.lit(1)).alias("size"),
                   (F.col("uid") == F.coalesce("keep_uid", "uid")).alias("kept")))
    result = [F.col("key").alias(key), F.col("keep_id"), F.col("size").cast("long").alias("group_size"), "kept",
              F.lower(F.hex("sha")).alias("text_sha256")]
    if wrong.isEmpty():
        return out.select(*result)
    # equal hashes, unequal bytes: those groups are formed anew by the bytes themselves
    rows = (texts.join(wrong, ["fp", "sha"], "left_semi")
            .withColumn("uid", F.monotonically_increasing_id()))
    rows = shared_table(rows, "collided")
    exact = rows.groupBy("fp", "sha", "norm").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))
    anew = (rows.join(exact, ["fp", "sha", "norm"])
            .select("key", "sha", F.col("first.key").alias("keep_id"), "size", (F.col("uid") == F.col("first.uid")).alias("kept")))
    return out.join(wrong, ["fp", "sha"], "left_anti").select(*result).unionByName(anew.select(*result))
