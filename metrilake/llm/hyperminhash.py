"""MinHash near-dedup with HyperMinHash registers.

A document's set holds its distinct word shingles as 64-bit hashes.  Every
bucket of its sketch keeps the smallest hash that falls into it, stored as the
number of leading zeros (5 bits) and the 11 mantissa bits behind them.  A
bucket that no shingle reaches is filled by further hash passes over the same
set, so short documents have full sketches too and two registers agree with a
probability equal to the Jaccard similarity (and a small collision rate).

Bands of registers are candidates; inside a band's bucket the sketches are
compared by the collision-corrected estimate; what passes is verified on the
full shingle sets.  Documents of identical text are one class from the start.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, group_links, maybe_in, mix64, seeds64, shared_table, small_batches

BITS = 8                      # 2**BITS buckets
K = 1 << BITS
MANTISSA = 11                 # bits of a register behind its leading-zero count
VALUE = 45                    # bits of a bucket's hash value
_LOW = np.uint64((1 << VALUE) - 1)
_PASSES = 1024                # hash passes; what is empty then is filled from the whole set
_SEED = seeds64(_PASSES, 1)
_LAST = seeds64(K, 2)
_MULT = seeds64(16, 3) | np.uint64(1)


class _Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words as sorted 64-bit hashes.

    A-Z are lower-cased, words end at space and \\t\\n\\v\\f\\r.  Fewer words:
    one shingle of them all.  No word: empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(w) - width + 1
    h = w[:n] * _MULT[0]
    for i in range(1, width):
        h = h + w[i:i + n] * _MULT[i % 16]
    return np.unique(mix64(h))


def sketch(h: np.ndarray) -> np.ndarray:
    """K registers (unsigned 16 bits) of a non-empty set of 64-bit hashes."""
    value = np.zeros(K, np.uint64)
    at = np.full(K, -1, np.int64)
    done = 0
    step = 1
    while done < _PASSES:
        x = mix64(h[None, :] ^ _SEED[done:done + step, None])
        t = np.arange(x.shape[0], dtype=np.uint64)[:, None]
        # bucket, pass, value: the smallest of a bucket comes from the first pass that reaches it
        key = ((x >> np.uint64(64 - BITS)) << np.uint64(56)) | (t << np.uint64(VALUE)) | (x & _LOW)
        key = np.sort(key, axis=None)
        b = (key >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        first = first[at[b[first]] < 0]
        got = b[first]
        at[got] = done + ((key[first] >> np.uint64(VALUE)) & np.uint64((1 << 11) - 1)).astype(np.int64)
        value[got] = key[first] & _LOW
        done += x.shape[0]
        if (at >= 0).all():
            break
        step = int(min(max(1, 2048 // len(h)), 512, _PASSES - done))
    empty = np.flatnonzero(at < 0)
    if len(empty):
        value[empty] = (mix64(h[None, :] ^ _LAST[empty, None]) & _LOW).min(axis=1)
        at[empty] = _PASSES
    zeros = VALUE - np.frexp(value.astype(np.float64))[1]
    zeros = np.minimum(zeros, 31).astype(np.uint64)
    behind = ((value << (zeros + np.uint64(1))) & _LOW) >> np.uint64(VALUE - MANTISSA)
    reg = (zeros << np.uint64(MANTISSA)) | behind
    return (reg ^ (at.astype(np.uint64) * np.uint64(40503) & np.uint64(0xFFFF))).astype(np.uint16)


def band_rows(threshold: float, miss: float = 1e-5) -> int:
    """The most registers a band can have so that a pair at the threshold shares
    no band with a probability of at most ``miss``."""
    return max(r for r in range(1, 17) if r == 1 or (1 - threshold ** r) ** (K // r) <= miss)


def bands(reg: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers."""
    n = K // rows
    m = reg[: n * rows].reshape(n, rows).astype(np.uint64) + np.uint64(1)
    key = (m * _MULT[None, :rows]).sum(axis=1, dtype=np.uint64) + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(key).view(np.int64)


def estimate(a: list[bytes], b: list[bytes], sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates, left x right.

    Unequal hashes agree in a register when zeros and mantissa agree; for sets
    of n and m elements that is 0.16991948 * 2**-MANTISSA * 4nm/(n+m)**2 of the
    buckets (Yu and Weber, HyperMinHash, 2017).
    """
    left = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), K)
    right = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), K)
    same = np.empty((len(a), len(b)), np.float64)
    for i in range(len(a)):
        same[i] = (left[i][None, :] == right).sum(axis=1)
    n, m = sizes_a[:, None].astype(np.float64), sizes_b[None, :].astype(np.float64)
    by_chance = 0.16991948 * 2.0 ** -MANTISSA * 4 * n * m / (n + m) ** 2
    return (same / K - by_chance) / (1 - by_chance)


def common_sizes(a: list[bytes], b: list[bytes], at_once: int = 1 << 22) -> np.ndarray:
    """Exact intersection sizes of sorted hash sets, left x right."""
    left, right = [np.frombuffer(x, np.uint64) for x in a], [np.frombuffer(x, np.uint64) for x in b]
    la, lb = np.repeat(np.arange(len(a)), [len(x) for x in left]), np.repeat(np.arange(len(b)), [len(x) for x in right])
    ha, hb = np.concatenate(left), np.concatenate(right)
    known = np.intersect1d(ha, hb)
    ia, ib = np.isin(ha, known), np.isin(hb, known)
    ca, cb = np.searchsorted(known, ha[ia]), np.searchsorted(known, hb[ib])
    la, lb = la[ia], lb[ib]
    out = np.zeros((len(a), len(b)), np.float32)
    width = max(1, at_once // max(len(a), len(b)))
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, la, cb, lb = ca[oa], la[oa], cb[ob], lb[ob]
    for c in range(0, len(known), width):
        sa, sb = slice(*np.searchsorted(ca, [c, c + width])), slice(*np.searchsorted(cb, [c, c + width]))
        w = min(width, len(known) - c)
        ma, mb = np.zeros((len(a), w), np.float32), np.zeros((len(b), w), np.float32)
        ma[la[sa], ca[sa] - c] = 1
        mb[lb[sb], cb[sb] - c] = 1
        out += ma @ mb.T
    return np.rint(out).astype(np.int64)


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", width: int = 5,
                    percent: int = 80, block_docs: int = 512, block_shingles: int = 1 << 18) -> DataFrame:
    """Every row of docs with its set size and component.

    Returns uid long (of this call), <key>, n_shingles long, component_id long
    (the smallest <key> reachable over links, its own included), kept boolean
    (<key> = component_id), first boolean (one row of each component: that of
    the smallest key, of repeated keys the smallest uid) and text_sha256 string.

    Links: 100 * intersection >= percent * union of the distinct shingles of
    ``width`` words; all links between different texts count, copies of one
    text stand behind one representative.  Null and empty texts, and texts of
    blanks, have no shingles and are linked with nothing; each is its own
    component.  A null key keeps its row; it is not a component id unless no
    row of the component has a key (then null, kept false, first true).
    Repeated rows are copies.  Other columns are ignored.

    A pair at the threshold is missed by all bands with a probability under
    1e-5, and by the sketch comparison (5 standard errors below the threshold)
    under 1e-6; there is no cap on a bucket or class (see group_links).
    """
    small_batches(docs.sparkSession)
    part = Fraction(percent, 100)
    rows = band_rows(float(part))
    low = float(part) - 5 * (float(part) * (1 - float(part)) / K) ** 0.5
    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    src = src.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, regs, keys = [], [], []
            for t in batch.column("text"):
                h = shingles(t.as_py(), width)
                n.append(len(h))
                reg = sketch(h) if len(h) else None
                regs.append(None if reg is None else len(h).to_bytes(8, "little") + reg.tobytes())
                keys.append([] if reg is None else bands(reg, rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("key"), batch.column("digest"), pa.array(n, pa.int64()),
                 pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["uid", "key", "digest", "n", "sketch", "bands"])
        _words.clear()
        pa.default_memory_pool().release_unused()

    t = shared_table(
        src.select(F.monotonically_increasing_id().alias("uid"), "key", "digest", "text")
        .mapInArrow(sketches, "uid long, key long, digest binary, n long, sketch binary, bands array<long>"), "sketches")
    classes = shared_table(
        t.groupBy("digest").agg(F.min("uid").alias("rep"), F.min("key").alias("least"), F.min_by("key", "uid").alias("rep_key"),
                                F.max("n").alias("n")), "classes")

    # candidates: bands that more than one class shares; bands that hold the same classes count once
    reps = classes.filter("n > 0").select(F.col("rep").alias("uid"))
    keyed = t.select("uid", F.explode("bands").alias("band")).join(reps, "uid", "left_semi")
    shared = (keyed.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("uid")).alias("x"),
                                        F.min("uid").alias("u"))
              .filter("c > 1").groupBy("c", "x", "u").agg(F.min("band").alias("band")).select("band"))
    members = keyed.join(shared, "band").select(F.col("band").alias("grp"), "uid", F.lit(1).alias("weight"))

    def alike(a: list[bytes], b: list[bytes]) -> np.ndarray:
        na, nb = (np.array([int.from_bytes(x[:8], "little") for x in y]) for y in (a, b))
        return estimate([x[8:] for x in a], [x[8:] for x in b], na, nb) >= low

    near = group_links(members, t.select("uid", F.col("sketch").alias("payload")), alike, most=block_docs, name="near")
    family = shared_table(components(near, "family"), "families")

    # verification on the full sets, of the classes that passed only
    chosen = family.join(classes, family["node"] == classes["rep"]).select("node", "root", "rep_key", "digest")
    maybe = maybe_in(chosen.select(F.xxhash64("digest").alias("fp")))  # spares the shuffle of all other texts
    full = (src.filter("text is not null").withColumn("fp", F.xxhash64("digest")).filter(maybe("fp")).alias("s")
            .join(chosen, (F.col("s.digest") == chosen["digest"]) & F.col("s.key").eqNullSafe(chosen["rep_key"]))
            .select("node", "root", "text").dropDuplicates(["node"]))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [shingles(x.as_py(), width) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("root"), batch.column("node"), pa.array([len(x) for x in h], pa.int64()),
                 pa.array([x.tobytes() for x in h], pa.binary())], ["grp", "uid", "weight", "payload"])

    whole = shared_table(full.mapInArrow(sets, "grp long, uid long, weight long, payload binary"), "sets")

    def linked(a: list[bytes], b: list[bytes]) -> np.ndarray:
        both = common_sizes(a, b)
        n = np.array([len(x) // 8 for x in a])[:, None] + np.array([len(x) // 8 for x in b])[None, :] - both
        return both * 100 >= percent * n

    links = group_links(whole.select("grp", "uid", "weight"), whole.select("uid", "payload"), linked,
                        most=block_shingles, name="verify")
    label = components(links, "classes")
    placed = (classes.join(label, classes["rep"] == label["node"], "left")
              .select("digest", "least", "n", F.coalesce("root", "rep").alias("root")))
    least = placed.filter("n > 0").groupBy("root").agg(F.min("least").alias("component"))
    placed = shared_table(placed.join(least, "root", "left").select("digest", "root", "component"), "placed")
    out = (t.select("uid", "key", "digest", "n").join(placed, "digest")
           .withColumn("root", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("uid")))
           .withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))))
    lead = out.filter("key <=> component").groupBy(F.col("root").alias("r"), (F.col("n") > 0).alias("some")).agg(F.min("uid").alias("lead"))
    out = out.join(lead, (out["root"] == lead["r"]) & ((out["n"] > 0) == lead["some"]), "left")
    return out.select("uid", F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"),
                      F.coalesce(F.col("uid") == F.col("lead"), F.lit(False)).alias("first"),
                      F.lower(F.hex("digest")).alias("text_sha256"))

