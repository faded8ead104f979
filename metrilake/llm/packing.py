"""Lexical retrieval packing of documents into fixed windows.

Whole windows are cut from long documents first.  What is left of each, up to
a window, is packed with its like: the rests are dealt into shards by topic,
each shard is a BM25 inverted index over its rests with term statistics of all
documents, and the unused neighbours it returns for a seed fill the seed's
window greedily.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups, shared_table, small_batches
from .tokens import default_path, encoder

VOCABULARY = 1 << 16          # ids fit 16 bits; bounds every table of terms
END = 0                       # id that ends a document
SHARD_TOKENS = 1 << 20        # tokens of rests that one index holds, about
K1, B = 1.2, 0.75             # BM25


def crc(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode(docs: DataFrame, *, text: str, key: str, path: str, window: int, with_ids: bool) -> DataFrame:
    """Rows (uid, key, n, crcs, body, rest) of the documents' ids, END included: crcs holds one number for each whole
    window, body their ids if asked for, rest what is left, as 16-bit ids.  Each task adds one row of (terms,
    counts): in how many of its documents a term occurs."""
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ddl = "uid long, key long, n long, crcs array<long>, body binary, rest binary, terms array<int>, counts array<long>"
    longs = pa.list_(pa.int64())
    schema = pa.schema([("uid", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("crcs", longs), ("body", pa.binary()), ("rest", pa.binary()),
                        ("terms", pa.list_(pa.int32())), ("counts", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        seen = np.zeros(VOCABULARY, np.int64)
        end = np.array([END], np.uint16).tobytes()
        for batch in batches:
            n, crcs, body, rest = [], [], [], []
            for t in batch.column("text"):
                ids = enc(t.as_py()) + end
                held = np.frombuffer(ids, np.uint16)
                seen[np.unique(held)] += 1
                cut = len(held) // window * window
                n.append(len(held))
                crcs.append([crc(held[a:a + window]) for a in range(0, cut, window)])
                body.append(ids[:cut * 2] if with_ids else None)
                rest.append(ids[cut * 2:])
            void = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("key"), pa.array(n, pa.int64()), pa.array(crcs, longs), pa.array(body, pa.binary()), pa.array(rest, pa.binary()),
                 void.cast(schema.field("terms").type), void.cast(schema.field("counts").type)], schema=schema)
        terms = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({**{c: [None] for c in schema.names}, "terms": [terms.astype(np.int32)], "counts": [seen[terms]]}, schema=schema)

    return src.mapInArrow(run, ddl)


class Index:
    """BM25 postings of the rests of a shard.

    Terms of at least a DENSE-th of the rests stand as rows of a matrix, whose sum over a query's terms is one addition
    a rest and term; the others as lists of (rest, weight).  Together they hold no more entries than DENSE times
    the postings.  Scores are sums over all terms of the query, in the order of the ids.
    """

    DENSE = 8

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray):
        found = [np.unique(r, return_counts=True) for r in rests]
        self.terms = [t for t, _ in found]
        size = np.array([len(r) for r in rests])
        tok = np.concatenate(self.terms)
        doc = np.repeat(np.arange(len(rests), dtype=np.int32), [len(t) for t in self.terms])
        tf = np.concatenate([c for _, c in found]).astype(np.float32)
        order = np.argsort(tok, kind="stable")
        tok, doc, tf = tok[order], doc[order], tf[order]
        weight = (idf[tok] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(1.0, size.mean())))).astype(np.float32)
        df = np.bincount(tok, minlength=VOCABULARY)
        common = np.flatnonzero(df * self.DENSE >= len(rests))
        self.row = np.full(VOCABULARY, -1, np.int32)
        self.row[common] = np.arange(len(common))
        often = self.row[tok] >= 0
        self.matrix = np.zeros((len(common), len(rests)), np.float32)
        self.matrix[self.row[tok[often]], doc[often]] = weight[often]
        self.rests = np.arange(len(rests))           # the rest of each column
        self._set(tok[~often], doc[~often], weight[~often])

    def _set(self, tok: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        self.tok, self.doc, self.weight = tok, doc, weight
        self.start = np.searchsorted(tok, np.arange(VOCABULARY + 1))

    def keep(self, columns: np.ndarray) -> None:
        """Only these columns stay."""
        at = np.cumsum(columns, dtype=np.int32) - 1
        stay = columns[self.doc]
        self.matrix = self.matrix[:, columns]
        self.rests = self.rests[columns]
        self._set(self.tok[stay], at[self.doc[stay]], self.weight[stay])

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """The score of each column for a query."""
        rows = self.row[terms]
        out = self.matrix[rows[rows >= 0]].sum(axis=0, dtype=np.float32).astype(np.float64)
        spans = [slice(self.start[t], self.start[t + 1]) for t in terms[rows < 0] if self.start[t] < self.start[t + 1]]
        if spans:
            out += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), minlength=len(out))
        return out


def falling(score: np.ndarray, some: int = 32) -> Iterator[int]:
    """The places of positive scores, the highest first, ties in their order; few are sorted unless more are asked for."""
    n = len(score)
    done = np.inf
    while True:
        low = np.partition(score, n - some)[n - some] if some < n else 0.0
        near = np.flatnonzero((score >= low) & (score > 0) & (score < done))
        yield from near[np.argsort(-score[near], kind="stable")].tolist()
        if low <= 0:
            return
        done, some = low, some * 8


def fill(rests: list[np.ndarray], idf: np.ndarray, window: int) -> list[list[tuple[int, int, int, bool]]]:
    """Sequences of pieces (rest number, first id, ids, whether retrieval placed it) that hold every id of the rests once.

    Seeds come in the given order; all distinct ids of a seed are its query.  A seed's window takes its unused
    neighbours by falling BM25 score (ties: the earlier one), then, where no neighbour shares a term, the next
    unused rest; the one that does not fit is cut there and its remainder seeds the next window.
    """
    size = [len(r) for r in rests]
    index = Index(rests, idf)
    unused = np.ones(len(rests), bool)
    left = len(rests)
    out: list[list[tuple[int, int, int, bool]]] = []
    nxt = 0
    seed: tuple[int, int, bool] | None = None    # a rest, its first id not yet placed, and how it was found
    while True:
        if seed is None:
            while nxt < len(rests) and not unused[nxt]:
                nxt += 1
            if nxt == len(rests):
                return out
            seed = (nxt, 0, False)
            unused[nxt] = False
            left -= 1
        i, at, found = seed
        pieces = [(i, at, size[i] - at, found)]
        room = window - pieces[0][2]
        seed = None
        if room and left:
            if left * 4 < len(index.rests) * 3:      # used rests leave the index
                index.keep(unused[index.rests])
            score = index.scores(index.terms[i])
            score[~unused[index.rests]] = 0
            near = falling(score)
            while room and left:
                k = next(near, None)
                if k is None:
                    while not unused[nxt]:
                        nxt += 1
                j = nxt if k is None else int(index.rests[k])
                unused[j] = False
                left -= 1
                take = min(room, size[j])
                pieces.append((j, 0, take, k is not None))
                room -= take
                if take < size[j]:
                    seed = (j, take, k is not None)
        out.append(pieces)


def pack(docs: DataFrame, *, window: int = 1024, text: str = "text", key: str = "doc_id", path: str | None = None,
         shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents in sequences of at most ``window`` ids.

    Returns, a row for each piece, uid long (the document's row in this call),
    <key>, start long (its document's ids before it), length long, ids_crc32
    long, doc_tokens long, sequence_id long, offset long (its place in the
    sequence, gapless from 0), by string (how the piece came there: whole, a window cut from its document; neighbour,
    found by retrieval; next, a first seed, or in order where no neighbour was left) and, if asked for, ids binary
    (little-endian unsigned 16-bit).

    A document is the ids of its whole text and END; null and empty texts are
    END alone.  Every id lies in exactly one piece.  All sequences but the last
    of a shard are full.  Copies, repeated rows and null keys are documents of
    their own.  An empty table gives an empty result; other columns are ignored.

    Term statistics count all documents.  Topics (a rest's most telling term)
    of more than ``shard_tokens`` are split by the second most telling one, and
    by hash only where both are shared by more; small ones share a shard, so an
    index is bounded whatever the data (three times ``shard_tokens`` and a
    window); the driver holds one number for each id of the vocabulary.
    """
    spark = docs.sparkSession
    small_batches(spark)
    t = shared_table(encode(docs, text=text, key=key, path=path or default_path(), window=window, with_ids=with_ids), "ids")
    stats = (t.filter("terms is not null").select(F.explode(F.arrays_zip("terms", "counts")).alias("z"))
             .groupBy(F.col("z.terms").alias("term")).agg(F.sum("z.counts").alias("df")).toArrow())
    df = np.zeros(VOCABULARY, np.float64)
    df[stats["term"].to_numpy()] = stats["df"].to_numpy()
    n = df[END]
    held = spark.sparkContext.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32))  # 256 KB
    rows = t.filter("uid is not null")

    def topic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = held.value
        for batch in batches:
            got, second = [], []
            for r in batch.column("rest"):
                ids, count = np.unique(np.frombuffer(r.as_py(), np.uint16), return_counts=True)
                value = count * idf[ids]
                best = int(np.argmax(value))
                got.append(int(ids[best]))
                value[best] = -1
                second.append(int(ids[np.argmax(value)]))  # of one id, itself
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("uid", "key", "n", "rest")], pa.array(got, pa.int32()), pa.array(second, pa.int32())],
                                             ["uid", "key", "n", "rest", "topic", "second"])

    rests = rows.filter(F.length("rest") > 0).select("uid", "key", "n", "rest").mapInArrow(topic, "uid long, key long, n long, rest binary, topic int, second int")
    rests = shared_table(rests, "rests")
    sizes = rests.groupBy("topic").agg(F.sum(F.length("rest") / 2).cast("long").alias("ids")).toArrow()
    first, parts = _shards(dict(zip(sizes["topic"].to_pylist(), sizes["ids"].to_pylist())), shard_tokens)
    places = spark.createDataFrame(pa.table({"topic": pa.array(list(first), pa.int32()), "first": pa.array(list(first.values()), pa.int64()),
                                             "parts": pa.array([parts[k] for k in first], pa.int64())}))
    placed = rests.join(F.broadcast(places), "topic")  # at most VOCABULARY rows
    dealt = placed.filter("parts = 1").select(F.col("first").alias("shard"), "uid", "key", "n", "rest")
    if max(parts.values(), default=1) > 1:
        dealt = dealt.unionByName(_split(placed.filter("parts > 1"), shard_tokens))
    names = ["uid", "key", "start", "length", "crc", "n", "seq", "offset", "by", "ids"]
    ddl = "uid long, key long, start long, length long, crc long, n long, seq long, offset long, by string, ids binary"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = held.value
        for g in groups(batches, ["shard"]):
            ids = [np.frombuffer(r, np.uint16) for r in g["rest"].to_pylist()]
            uid, keys, n = g["uid"].to_pylist(), g["key"].to_pylist(), g["n"].to_pylist()
            base = g["shard"][0].as_py() << 32
            rows = []
            for s, pieces in enumerate(fill(ids, idf, window)):
                at = 0
                for i, a, size, found in pieces:
                    part = ids[i][a:a + size]
                    rows.append((uid[i], keys[i], n[i] - len(ids[i]) + a, size, crc(part), n[i], (base + s) * 2, at,
                                 "neighbour" if found else "next", part.tobytes() if with_ids else None))
                    at += size
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:8]], pa.array(cols[8], pa.string()), pa.array(cols[9], pa.binary())], names)

    packed = dealt.repartition("shard").sortWithinPartitions("shard", "uid").mapInArrow(shards, ddl)
    full = (rows.filter(F.size("crcs") > 0).select("uid", "key", "n", "body", F.posexplode("crcs").alias("w", "crc"))
            .select("uid", "key", (F.col("w") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "crc", "n",
                    (F.monotonically_increasing_id() * 2 + 1).alias("seq"), F.lit(0).cast("long").alias("offset"), F.lit("whole").alias("by"),
                    F.expr(f"substring(body, w * {2 * window} + 1, {2 * window})").alias("ids")))
    out = packed.unionByName(full)
    return out.select("uid", F.col("key").alias(key), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
                      F.col("seq").alias("sequence_id"), "offset", "by", *(["ids"] if with_ids else []))


def _split(hot: DataFrame, most: int) -> DataFrame:
    """Shards of the rests of large topics: in the order of the second term, so that those that share it lie together;
    what more than ``most`` ids share is dealt by hash over as many shards as it needs."""
    by = Window.partitionBy("topic").orderBy("second").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = hot.groupBy("topic", "second").agg(F.sum(F.length("rest") / 2).cast("long").alias("ids"))  # a topic: at most VOCABULARY rows
    at = size.select("topic", "second", ((F.sum("ids").over(by) - F.col("ids")) / most).cast("long").alias("skip"),
                     F.ceil(F.col("ids") / most).alias("span"))
    place = F.least(F.col("skip") + F.pmod(F.xxhash64("uid"), F.col("span")), F.col("parts") - 1)
    return hot.join(at, ["topic", "second"]).select((F.col("first") + place).alias("shard"), "uid", "key", "n", "rest")


def _shards(sizes: dict[int, int], most: int) -> tuple[dict[int, int], dict[int, int]]:
    """First shard and number of shards of each topic: large topics get shards
    of their own, small ones share one in the order of their ids."""
    first, parts, at, held = {}, {}, 0, 0
    for topic in sorted(sizes):
        size = sizes[topic]
        if size > most:
            n = -(-size // most)
            first[topic], parts[topic] = at + 1, n
            at, held = at + n + 1, 0
            continue
        if held + size > most:
            at, held = at + 1, 0
        first[topic], parts[topic] = at, 1
        held += size
    return first, parts
