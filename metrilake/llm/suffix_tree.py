"""Language-model scores from a probabilistic suffix tree over words.

A document is its words, A-Z lower-cased, and an end; before its first word stands
an end too.  Strings of one, two and more words are counted over all training
documents; words are kept always, longer strings where they occur twice (a fixed
number, whatever the corpus).

A context s of one or more words predicts w as

    P(w|s) = (max(c(sw) - D, 0) + e(s) P(w|parent(s))) / c(s),   e(s) = c(s) - sum of the numerators' first terms

over the kept sw; parent(s) is its longest shorter suffix in the tree, at last the
root, the unigrams plus one.  This sums to one over all words, the unknown word
included.  s stays in the tree if the divergence of P(.|s) from P(.|parent(s)) saves
its occurrences at least PRICE bits for each successor kept and PRICE bits more.
A token is scored at the state of the longest suffix of its history.

The tree is a table of strings, which nothing holds whole.  A text's score is the sum
of what its strings are worth: a word its root probability, a state the rest it passes
on to its parent, a state's successor what its probability there is above that.  Blocks
of texts ask the owners of ranges of string keys for their strings' worth, each string
once a block, and sum the answers.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table, small_batches

DEPTH = 2                     # words of the longest context
LEAST = 2                     # occurrences of a kept string at least
DISCOUNT = 0.75               # taken from every kept successor's count
PRICE = 4.0                   # bits that a state must save for itself and for each of its successors
HELD = 1 << 19                # strings that a task counts before it sends them on
BLOCK_BYTES = 1 << 21         # text of a block; a batch of texts is not cut
OWNED = 1 << 20               # strings that an owner is sent or asked for, about
TURN_BITS = 2                 # turns that contexts take, as leading bits: a part of all strings is shuffled at once
BLOCK_TURNS = 5               # turns that blocks take when they are scored
TURNS = range(-1 << TURN_BITS - 1, 1 << TURN_BITS - 1)

#: While a table is written: its shuffles are deleted then, and runs go to Python in batches of few MB.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 23)}


def fingerprint(word: bytes) -> int:
    """64 bits that stand for a word; b"" is the end."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


END = fingerprint(b"")


def tokens(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprints of the texts' distinct words and the end (first), the tokens of all texts as places among
    them, each text's end included, and the tokens of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = split.flatten()
    word = pc.binary_length(flat).to_numpy() > 0          # there are empty ones beside a text's outer blanks
    of = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
    sizes = np.bincount(of[word], minlength=len(split)).astype(np.int64) + 1
    d = flat.filter(pa.array(word)).dictionary_encode()
    prints = np.empty(len(d.dictionary) + 1, np.int64)
    prints[0] = END
    prints[1:] = np.fromiter(map(fingerprint, d.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(d.dictionary))
    inner = np.ones(int(sizes.sum()), bool)
    inner[np.cumsum(sizes) - 1] = False
    at = np.zeros(len(inner), np.int32)
    at[inner] = d.indices.to_numpy() + 1
    return prints, at, sizes


def _place(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in the sorted keys, -1 where not among them."""
    if not len(keys):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


def _starts(x: np.ndarray) -> np.ndarray:
    """Whether each of the sorted x is the first of its value."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


# --- strings ------------------------------------------------------------------------------------
def _joined(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The keys of strings: 64 bits of the prefix's key, turned, and the last word's fingerprint."""
    x = prefix.view(np.uint64)
    return (x << np.uint64(21) | x >> np.uint64(43)).view(np.int64) ^ last


def _prefix(key: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The prefix's keys of strings that end with last."""
    x = (key ^ last).view(np.uint64)
    return (x >> np.uint64(21) | x << np.uint64(43)).view(np.int64)


def _joined_column(prefix: Column, last: Column) -> Column:
    return F.shiftleft(prefix, 21).bitwiseOR(F.shiftrightunsigned(prefix, 43)).bitwiseXOR(last)


def strings(word: np.ndarray, sizes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For 2, 3, ... depth + 1 words: which tokens end a string of so many, the key of its words without the first and the
    last (0: none), of its words but the last, and its key.

    word: the tokens' fingerprints.  No string reaches over a text's start except to the end before it.
    """
    first = np.zeros(len(word), bool)
    first[np.cumsum(sizes) - sizes] = True

    def before(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[first] = END
        return out

    shorter, key, ok = np.zeros_like(word), word, np.ones(len(word), bool)
    for k in range(1, depth + 1):
        mid, prefix = before(shorter) if k > 1 else shorter, before(key)
        shorter, key = key, _joined(prefix, word)
        if k > 1:
            was = np.zeros(len(ok), bool)
            was[1:] = ok[:-1]
            ok = was & ~first
        yield ok, mid[ok], prefix[ok], key[ok]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of the batches in blocks of about BLOCK_BYTES of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("text").nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _written(df: DataFrame, name: str) -> DataFrame:
    """shared_table; the shuffles behind it are deleted when it is written."""
    conf = df.sparkSession.conf
    was = {k: conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            conf.set(k, v)
        return shared_table(df, name)
    finally:
        for k, v in was.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


# --- blocks and runs -----------------------------------------------------------------------------
def _packed(t: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(t)
    return sink.getvalue().to_pybytes()


def _unpacked(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def _array(x: np.ndarray) -> bytes:
    return _packed(pa.record_batch([pa.array(x)], ["x"]))


def _numbers(b: bytes) -> np.ndarray:
    return _unpacked(b)["x"].to_numpy()


def _gaps(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the gaps between them, byte by byte."""
    gap = np.diff(keys.view(np.uint64))
    width = (int(gap.max()).bit_length() + 7) // 8 if len(gap) else 0
    return keys[:1].tobytes() + np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _ungapped(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[0] = np.frombuffer(b, np.uint8, 8)
    if n > 1:
        planes = np.frombuffer(b, np.uint8, offset=8).reshape(-1, n - 1)
        out[1:, :len(planes)] = planes.T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64).view(np.int64)


def _runs(part: np.ndarray) -> list[tuple[int, int]]:
    """From where to where the sorted parts are equal."""
    cut = np.flatnonzero(_starts(part)).tolist()
    return list(zip(cut, [*cut[1:], len(part)]))


def _dealt(part: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """A row for each part: m, and its numbers of every column as bytes."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    runs = _runs(part)
    return pa.table({"part": pa.array([part[a] for a, _ in runs], pa.int64()), "m": pa.array([b - a for a, b in runs], pa.int64()),
                     **{c: pa.array([x[a:b].tobytes() for a, b in runs], pa.binary()) for c, x in ((c, x[order]) for c, x in columns.items())}})


def _gathered(t: pa.Table | pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    """The numbers of all rows' columns; those in _FLOATS are doubles."""
    return [np.frombuffer(b"".join(t.column(c).to_pylist()), np.float64 if c in _FLOATS else np.int64) for c in columns]


def _runs_of(keys: np.ndarray, bits: int, **columns: np.ndarray) -> pa.Table:
    """Sorted keys and their columns as rows (part, m, keys as gaps, columns as bytes); parts are leading bits."""
    part = keys >> (64 - bits)
    runs = _runs(part)
    return pa.table({"part": pa.array([part[a] for a, _ in runs], pa.int64()), "m": pa.array([b - a for a, b in runs], pa.int64()),
                     "keys": pa.array([_gaps(keys[a:b]) for a, b in runs], pa.binary()),
                     **{c: pa.array([x[a:b].tobytes() for a, b in runs], pa.binary()) for c, x in columns.items()}})


def _keys_of(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(_ungapped(b, m) for b, m in zip(t.column("keys").to_pylist(), t.column("m").to_pylist()))])


def _binary(*columns: str) -> str:
    return ", ".join(f"{c} binary" for c in columns)


_FLOATS = ("lp", "value", "rest")


def _coded(src: DataFrame) -> DataFrame:
    """Blocks of the rows, written: kept (all columns but the text), prints, at and sizes (see tokens) and their number n."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _texts(batches):
            prints, at, sizes = tokens(t["text"])
            yield pa.RecordBatch.from_pydict({"kept": [_packed(t.drop_columns(["text"]).combine_chunks())], "prints": [_array(prints)], "at": [_array(at)],
                                              "sizes": [_array(sizes)], "n": [len(at)]})

    coded = src.mapInArrow(code, "kept binary, prints binary, at binary, sizes binary, n long")
    return _written(coded.withColumn("block", F.monotonically_increasing_id()), "coded")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i, *(_numbers(batch.column(c)[i].as_py()) for c in ("prints", "at", "sizes"))


# --- the tree -----------------------------------------------------------------------------------
@dataclass
class Tree:
    """total N and kinds V of the training tokens; depth: words of the longest context; worth: the table of what strings
    add to the scores of texts, root probabilities aside, a value for each part of it; a row is a run of sorted keys that
    share their leading bits, as gaps, and their values."""

    total: int
    kinds: int
    depth: int
    worth: DataFrame
    bits: int


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The keys and counts of words, up to HELD at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= HELD:
            yield tuple(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("key", "n"))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("key", "n"))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their numbers."""
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(_starts(key))
    return (key[start], np.add.reduceat(n[order], start)) if len(key) else (key, n)


def _words(coded: DataFrame, bits: int) -> DataFrame:
    """(key, n) of all words; a task merges up to HELD of them and sends sorted runs to the owners of ranges of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent():
            key, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            yield from _runs_of(key, bits, n=n).to_batches()

        for _, _, prints, at, _ in _blocks(batches):
            held.append((prints, np.bincount(at, minlength=len(prints))))
            size += len(prints)
            if size >= HELD:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()

    def merge(t: pa.Table) -> pa.Table:
        key, n = _summed(_keys_of(t), _gathered(t, "n")[0])
        return pa.table({"key": key[n > 0], "n": n[n > 0]})

    return (coded.select("prints", "at", "sizes").mapInArrow(run, f"part long, m long, {_binary('keys', 'n')}")
            .groupBy("part").applyInArrow(merge, "key long, n long"))


def _words_dealt(counts: DataFrame, bits: int) -> DataFrame:
    """The words' keys and counts by leading bits of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _merged(batches):
            yield from _dealt(key >> (64 - bits), key=key, n=n).to_batches()

    return counts.mapInArrow(run, f"part long, m long, {_binary('key', 'n')}")


def _counted(coded: DataFrame, k: int, turn: int, bits: int, least: int) -> DataFrame:
    """The strings of k + 1 words (mid, prefix, last, n) that occur ``least`` times and whose mid (k = 1: prefix) has the
    turn's leading bits, dealt by mid (k = 1: by last).

    A task merges up to HELD strings and sends sorted runs to the owners of ranges of keys, which add them up.
    """

    def of_turn(prints: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What strings() gives of two or three words, made for the turn's tokens alone: key, last, mid."""
        first = np.zeros(len(at), bool)
        first[np.cumsum(sizes) - sizes] = True
        after = np.zeros(len(at), bool)
        after[1:] = (prints >> (64 - TURN_BITS) == turn)[at[:-1]]
        after[first] = k == 1 and END >> (64 - TURN_BITS) == turn
        i = np.flatnonzero(after)
        before = lambda i: np.where(first[i], END, prints[at[i - 1]])
        last, prefix = prints[at[i]], before(i)
        if k == 1:
            return _joined(prefix, last), last, last[:0]
        return _joined(_joined(before(i - 1), prefix), last), last, prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def sent():
            key, last, mid = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key)
            key = key[order]
            start = np.flatnonzero(_starts(key))
            n, some = np.diff(np.append(start, len(key))), order[start]
            yield from _runs_of(key[start], bits, last=last[some], mid=mid[some] if k > 1 else mid[:0], n=n).to_batches()

        for _, _, prints, at, sizes in _blocks(batches):
            if k <= 2:
                held.append(of_turn(prints, at, sizes))
            else:
                word = prints[at]
                *_, (ok, mid, _, key) = strings(word, sizes, k)
                mine = np.flatnonzero(mid >> (64 - TURN_BITS) == turn)
                held.append((key[mine], word[ok][mine], mid[mine]))
            size += len(held[-1][0])
            if size >= HELD:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()

    def merge(t: pa.Table) -> pa.Table:
        key = _keys_of(t)
        last, n = _gathered(t, "last", "n")
        mid = _gathered(t, "mid")[0] if k > 1 else np.zeros_like(key)
        order = np.argsort(key)
        start = np.flatnonzero(_starts(key[order]))
        n = np.add.reduceat(n[order], start)
        some = order[start[n >= least]]
        mid, last = mid[some], last[some]
        return _dealt(mid >> (64 - bits - TURN_BITS) if k > 1 else last >> (64 - bits), mid=mid, prefix=_prefix(key[some], last), last=last, n=n[n >= least])

    return (coded.select("prints", "at", "sizes").mapInArrow(run, f"part long, m long, {_binary('keys', 'last', 'mid', 'n')}")
            .groupBy("part").applyInArrow(merge, f"part long, m long, {_binary('mid', 'prefix', 'last', 'n')}"))


_LEVEL = _binary("mid", "prefix", "last", "n", "lp", "value", "state", "rest")


def _level(mid: np.ndarray, prefix: np.ndarray, last: np.ndarray, n: np.ndarray, c: np.ndarray, lp: np.ndarray, price: float) -> pa.Table:
    """One row of all strings of whole contexts, with lp, log10 P(last) at the longest state they end with, and value,
    what they are worth, NaN where their prefix is no state; and the prefixes that are states with what their rest is worth.

    Given is lp at the longest state that is a suffix of mid, and the prefixes' counts c.
    """
    if not len(prefix):
        return pa.table({x: pa.array([], pa.binary()) for x in ("mid", "prefix", "last", "n", "lp", "value", "state", "rest")})
    order = np.argsort(prefix)
    mid, prefix, last, n, c, lp = (x[order] for x in (mid, prefix, last, n, c, lp))
    first = _starts(prefix)
    start, of = np.flatnonzero(first), np.cumsum(first) - 1
    taken = np.maximum(n - DISCOUNT, 0.0)
    rest = (c[start] - np.add.reduceat(taken, start)) / c[start]
    p = taken / c + rest[of] * 10.0 ** lp
    log_p, log_rest = np.log10(p), np.log10(rest)
    gain = (np.add.reduceat(p * (log_p - lp), start) + np.maximum(1 - np.add.reduceat(p, start), 0.0) * log_rest) / np.log10(2)
    state = gain * c[start] >= price * (np.diff(np.append(start, len(prefix))) + 1)
    value = np.where(state[of], log_p - log_rest[of] - lp, np.nan)
    out = {"mid": mid, "prefix": prefix, "last": last, "n": n, "lp": np.where(state[of], log_p, lp), "value": value, "state": prefix[start[state]], "rest": log_rest[state]}
    return pa.table({x: pa.array([v.tobytes()], pa.binary()) for x, v in out.items()})


def _tails(k: int, mid: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The keys of strings of k + 1 words without their first word."""
    return last if k == 1 else _joined(mid, last)


def _below(level: DataFrame, k: int, turn: int, bits: int) -> DataFrame:
    """The strings of a level (key, n, lp), dealt to where they are contexts in this turn and to where they are suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mid, prefix, last, n, lp = _gathered(batch.slice(i, 1), "mid", "prefix", "last", "n", "lp")
                key, to = _joined(prefix, last), np.concatenate([prefix, _tails(k, mid, last)])
                at = np.flatnonzero(to >> (64 - TURN_BITS) == turn)
                of = at % len(key)
                yield from _dealt(to[at] >> (64 - bits - TURN_BITS), key=key[of], n=n[of], lp=lp[of]).to_batches()

    return level.select("mid", "prefix", "last", "n", "lp").mapInArrow(run, f"part long, m long, {_binary('key', 'n', 'lp')}")


def _worth(level: DataFrame, bits: int) -> DataFrame:
    """The runs of what a level's strings and states are worth; a task merges up to HELD of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent():
            key, value = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key)
            yield from _runs_of(key[order], bits, value=value[order]).to_batches()

        for batch in batches:
            for i in range(batch.num_rows):
                prefix, last, value, state, rest = _gathered(batch.slice(i, 1), "prefix", "last", "value", "state", "rest")
                listed = ~np.isnan(value)
                held.append((np.concatenate([_joined(prefix, last)[listed], state]), np.concatenate([value[listed], rest])))
                size += len(held[-1][0])
                if size >= HELD:
                    yield from sent()
                    held, size = [], 0
        if size:
            yield from sent()

    return level.select("prefix", "last", "value", "state", "rest").mapInArrow(run, f"part long, m long, {_binary('keys', 'value')}")


def fit(train: DataFrame, *, text: str = "text", depth: int = DEPTH, string_bits: int | None = None, word_bits: int | None = None,
        price: float = PRICE) -> tuple[Tree, DataFrame]:
    """The tree of the training rows, and the table (key, n) of all their words' counts.

    All strings that occur LEAST times are in the tree; string_bits, if given, leaves out those whose share of all tokens
    is below 2**-string_bits.  word_bits changes nothing: no word is broadcast.  Null texts count as empty: their end is
    a token.

    Texts are coded once.  The strings of a length are counted and valued in turns by leading bits of their mid, all words
    but the first and the last: the contexts of a turn, their strings and these strings' suffixes are known to it alone,
    so a turn's shuffles hold a part of the strings and are deleted with it.
    """
    spark = train.sparkSession
    small_batches(spark)
    coded = _coded(train.select(F.col(text).alias("text")))
    total = coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(4, (total // (OWNED << TURN_BITS)).bit_length())
    counts = _written(_words(coded, bits), "words")
    kinds = counts.count()
    least = max(LEAST, -(-total >> string_bits) if string_bits is not None else 0)
    root = np.log10(float(total + kinds + 1))

    def found(words: pa.Table, x: np.ndarray) -> np.ndarray:
        key, n = _gathered(words, "key", "n")
        order = np.argsort(key)
        return n[order[_place(key[order], x)]] if len(x) else x

    def rooted(t: pa.Table, words: pa.Table) -> pa.Table:
        prefix, last, n = _gathered(t, "prefix", "last", "n")
        return _dealt(prefix >> (64 - bits - TURN_BITS), prefix=prefix, last=last, n=n, lp=np.log10(found(words, last) + 1) - root)

    def valued_words(t: pa.Table, words: pa.Table) -> pa.Table:
        prefix, last, n, lp = _gathered(t, "prefix", "last", "n", "lp")
        # a word that is a context stands before as many tokens as it stands for
        return _level(np.zeros_like(prefix), prefix, last, n, found(words, prefix), lp, price)

    def valued(t: pa.Table, below: pa.Table) -> pa.Table:
        mid, prefix, last, n = _gathered(t, "mid", "prefix", "last", "n")
        key, c, lp = _gathered(below, "key", "n", "lp")
        if not len(mid):
            return _level(*[mid] * 6, price)
        # a kept string's first and last words are kept too, so none is missed
        order = np.argsort(key)
        key, c, lp = key[order], c[order], lp[order]
        return _level(mid, prefix, last, n, c[_place(key, prefix)], lp[_place(key, _joined(mid, last))], price)

    worth, low = [], None
    for k in range(1, depth + 1):
        done = []
        for turn in TURNS:
            kept = _counted(coded, k, turn, bits, least).groupBy("part")
            if k == 1:
                known = (kept.cogroup(_words_dealt(counts, bits).groupBy("part"))
                         .applyInArrow(rooted, f"part long, m long, {_binary('prefix', 'last', 'n', 'lp')}"))
                mine = counts.filter(F.shiftright("key", 64 - TURN_BITS) == turn)
                level = known.groupBy("part").cogroup(_words_dealt(mine, bits + TURN_BITS).groupBy("part")).applyInArrow(valued_words, _LEVEL)
            else:
                level = kept.cogroup(_below(low, k - 1, turn, bits).groupBy("part")).applyInArrow(valued, _LEVEL)
            done.append(_written(level, f"level{k}"))
            if k == depth:                       # nothing else reads the longest strings
                worth.append(_written(_worth(done[-1], bits + TURN_BITS), "worth"))
                _dropped(done.pop())
        if low is not None:
            worth.append(_written(_worth(low, bits + TURN_BITS), "worth"))
            _dropped(*lows)
        low, lows = (_union(done) if done else None), done
    _dropped(coded)
    return Tree(total, kinds, depth, _union(worth), bits + TURN_BITS), counts


# --- scoring ----------------------------------------------------------------------------------
def _all_keys(prints: np.ndarray, at: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys of a block's words, in the order of prints, and of its longer strings, one after another; and the tokens
    that end those of each length."""
    found = [(key, np.flatnonzero(ok)) for ok, _, _, key in strings(prints[at], sizes, depth)]
    return np.concatenate([prints, *[key for key, _ in found]]), [where for _, where in found]


def score(docs: DataFrame, tree: Tree, counts: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns ``keep`` (all but the text if not given; of any name) with n_tokens, n_known, train_tokens,
    base_score and score, one row for each row of docs; null texts are empty, an end alone.

    Texts are coded once, in blocks.  A block sends its distinct strings' keys to the owners of their ranges, which join
    them with the words' counts and the tree, and gets back what it asked for in the order of its keys.  Blocks take turns, so
    that what is asked and answered at once is a part of all strings; the scores are written.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, names)], F.col(text).alias("text"))
    types = dict(src.dtypes)
    depth, size = tree.depth, float(tree.total + tree.kinds + 1)

    coded = _coded(src)
    asked = coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (depth + 1)
    bits = max(4, (asked // (OWNED * BLOCK_TURNS)).bit_length())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, prints, at, sizes in _blocks(batches):
            keys = np.sort(_all_keys(prints, at, sizes, depth)[0])
            runs = _runs_of(keys[_starts(keys)], bits)
            yield from runs.add_column(0, "block", pa.array([batch.column("block")[i].as_py()] * runs.num_rows, pa.int64())).to_batches()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _merged(batches):
            order = np.argsort(key)
            runs = _runs_of(key[order], bits, n=n[order])
            yield from runs.append_column("value", pa.array([b""] * runs.num_rows, pa.binary())).to_batches()

    def strings_worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                runs = _runs_of(_keys_of(row), bits, value=_gathered(row, "value")[0])
                yield from runs.add_column(3, "n", pa.array([b""] * runs.num_rows, pa.binary())).to_batches()

    def answer(asks: pa.Table, held: pa.Table) -> pa.Table:
        is_word = pc.greater(pc.binary_length(held["n"]), 0)
        known, others = held.filter(is_word), held.filter(pc.invert(is_word))
        (counts,), (values,) = _gathered(known, "n"), _gathered(others, "value")
        word, n = _summed(_keys_of(known), counts)
        key, value = _summed(_keys_of(others), values)
        n, value = np.append(n, 0), np.append(value, 0.0)      # one more for place -1
        out = []
        for k, m in zip(asks["keys"].to_pylist(), asks["m"].to_pylist()):
            x = _ungapped(k, m)
            known, some = n[_place(word, x)], value[_place(key, x)]
            out.append((np.packbits(known > 0).tobytes(), known[known > 0].tobytes(), np.packbits(some != 0).tobytes(), some[some != 0].tobytes()))
        words, ns, others, values = zip(*out) if out else ((), (), (), ())
        return pa.table([asks["block"], asks["part"], asks["m"], *(pa.array(x, pa.binary()) for x in (words, ns, others, values))],
                        ["block", "part", "m", "is_word", "n", "is_worth", "value"])

    def total(block: pa.Table, answers: pa.Table) -> pa.Table:
        kept, (prints, at, sizes) = _unpacked(block["kept"][0].as_py()), (_numbers(block[c][0].as_py()) for c in ("prints", "at", "sizes"))
        answers = answers.sort_by("part")

        def spread(bits: str, values: str, dtype: type) -> np.ndarray:
            hit = np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8), count=m) for h, m in zip(answers[bits].to_pylist(), answers["m"].to_pylist())]) > 0
            out = np.zeros(len(hit))
            out[hit] = np.frombuffer(b"".join(answers[values].to_pylist()), dtype)
            return out

        known, worth = spread("is_word", "n", np.int64), spread("is_worth", "value", np.float64)
        keys, ends = _all_keys(prints, at, sizes, depth)
        order = np.argsort(keys)
        of = np.empty(len(keys), np.int64)
        of[order] = np.cumsum(_starts(keys[order])) - 1       # place of each string among the block's distinct ones
        doc, m = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        word = of[:len(prints)]
        base = np.bincount(doc, np.log10((known[word] + 1) / size)[at], m)
        shift = np.bincount(doc, worth[word][at], m)
        done = len(prints)
        for end in ends:
            shift += np.bincount(doc[end], worth[of[done:done + len(end)]], m)
            done += len(end)
        n_known = np.bincount(doc, (known[word] > 0)[at], m).astype(np.int64)
        return pa.table([*[kept[c] for c in names], pa.array(sizes), pa.array(n_known), pa.array(base), pa.array(base + shift)], [*names, "n", "known", "base", "score"])

    runs = f"part long, m long, {_binary('keys', 'n', 'value')}"
    schema = ", ".join([*[f"{k} {types[k]}" for k in names], "n long, known long, base double, score double"])
    out = []
    if tree.bits < bits:
        held = tree.worth.select("m", "keys", "value").mapInArrow(strings_worth, runs)
    else:
        held = tree.worth.select(F.shiftright("part", tree.bits - bits).alias("part"), "m", "keys", F.lit(b"").alias("n"), "value")
    held = counts.mapInArrow(words, runs).unionByName(held)
    for turn in range(BLOCK_TURNS):
        mine = coded.filter(F.pmod(F.xxhash64("block"), F.lit(BLOCK_TURNS)) == turn)
        asks = mine.select("block", "prints", "at", "sizes").mapInArrow(ask, "block long, part long, m long, keys binary")
        answers = asks.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(
            answer, "block long, part long, m long, is_word binary, n binary, is_worth binary, value binary")
        blocks = mine.select("block", "kept", "prints", "at", "sizes")
        out.append(_written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, schema), "scores"))
    _dropped(coded)
    return _union(out).select(*[F.col(k).alias(c) for c, k in zip(keep, names)], F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
                      F.lit(tree.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def held_out(key: str = "doc_id") -> Column:
    """Remainder 2 of crc32 of the key as text by 7; rows without key are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(True))
