"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ORDER bytes long is counted on
a bounded sample of labelled documents and then frozen.  A byte's code length
after a context follows escape method C: with n symbols seen n_s of them being
s and d distinct ones, s costs -log2(n_s / (n + d)) if n_s > 0, else the escape
-log2(d / (n + d)) and what s costs after the context without its first byte;
before the empty context all byte classes are equally likely.  The language of
the shortest code wins.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import small_batches

ORDER = 3                     # bytes of the longest context
SAMPLE_ROWS = 400             # labelled documents of a language that the trees are counted on
LEAST = 4                     # a context of ORDER bytes is kept from so many occurrences in a language


def fold(data: bytes) -> np.ndarray:
    """Bytes as symbols: A-Z as a-z, digits as one, white space as one."""
    return np.frombuffer(data.translate(_FOLD), np.uint8)


_FOLD = bytes(ord("0") if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


@dataclass
class Model:
    """Frozen trees of all languages.

    symbol maps folded bytes to 0..A-1 (0: a byte that training never saw).
    node maps the code of the last ORDER symbols to the deepest kept context.
    cost[node, symbol, language] holds the code lengths in bits.
    """

    langs: list[str]
    symbol: np.ndarray
    node: np.ndarray
    cost: np.ndarray

    @property
    def symbols(self) -> int:
        return int(self.symbol.max()) + 1

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text under each language; each starts after ORDER spaces."""
        a = self.symbols
        out = np.zeros((len(texts), len(self.langs)))
        space = self.symbol[32]
        lead = np.full(ORDER, space, self.symbol.dtype)
        for i, data in enumerate(texts):
            for part in range(0, len(data), 1 << 20):  # in pieces, contexts reaching over the cuts
                s = self.symbol[fold(data[part:part + (1 << 20)])]
                lead_s = np.concatenate([lead, s])
                lead = lead_s[-ORDER:]
                code = lead_s[:len(s)].astype(np.int32)
                for j in range(1, ORDER):
                    code = code * a + lead_s[j:j + len(s)]
                out[i] += self.cost[self.node[code], s].sum(axis=0, dtype=np.float64)
            lead = np.full(ORDER, space, self.symbol.dtype)
        return out


def build(langs: list[str], lang: np.ndarray, code: np.ndarray, count: np.ndarray) -> Model:
    """The frozen model of the counts of folded (ORDER + 1)-byte strings, first byte highest."""
    seen = np.unique(np.concatenate([((code >> (8 * i)) & 255) for i in range(ORDER + 1)] + [[32]]))
    symbol = np.zeros(256, np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    a = len(seen) + 1
    grams = np.zeros_like(code)
    for i in range(ORDER, -1, -1):
        grams = grams * a + symbol[(code >> (8 * i)) & 255]
    n_lang = len(langs)
    # code lengths by order, from the empty context up; full tables of the orders below ORDER
    cost = [np.full((1, a, n_lang), np.log2(a))]
    nodes = 1
    tables = []
    node = np.zeros(1, np.int64)      # context code -> node, of the order below
    for order in range(ORDER + 1):
        tail = grams % a ** (order + 1)
        contexts, at = np.unique(tail // a, return_inverse=True)
        last, by, times = tail % a, lang, count
        if order == ORDER:
            often = np.zeros((len(contexts), n_lang))
            np.add.at(often, (at, by), times)
            keep = often.max(axis=1) >= LEAST
            rows = keep[at]
            at, last, by, times = (np.cumsum(keep) - 1)[at[rows]], last[rows], by[rows], times[rows]
            contexts = contexts[keep]
        n = np.zeros((len(contexts), a, n_lang))
        np.add.at(n, (at, last, by), times)
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        shorter = cost[0] if order == 0 else np.concatenate(tables)[node[contexts % a ** (order - 1)]]
        with np.errstate(divide="ignore", invalid="ignore"):
            known = -np.log2(n / (total + kinds))
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
        table = np.where(n > 0, known, escape + shorter)
        if order == 0:
            full = np.zeros(1, np.int64)
            tables, nodes = [table], 1
        else:
            below = node[np.arange(a ** order) % a ** (order - 1)]
            full = below.copy()
            full[contexts] = nodes + np.arange(len(contexts))
            tables.append(table)
            nodes += len(contexts)
        node = full
    return Model(langs, symbol, node.astype(np.int32), np.concatenate(tables).astype(np.float32))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: Column | None = None,
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Counts the trees on up to sample_rows documents of each language.

    docs are training rows; rows without language or text are passed over.  The
    sample is the documents with the smallest hashes of key (the text's hash if
    none is given); whole texts are counted.  The driver receives counts of
    distinct (ORDER + 1)-byte strings of the sample.
    """
    small_batches(docs.sparkSession)
    src = docs.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.xxhash64(F.lit(11), key if key is not None else F.col(text)).alias("h"), F.col(text).alias("text"))
    # a share of each language that holds about twice the sample, so that no language is ranked whole
    sizes = dict(src.groupBy("lang").count().collect())
    if not sizes:
        return Model([], np.zeros(256, np.int32), np.zeros(1, np.int32), np.zeros((1, 1, 0), np.float32))
    langs = sorted(sizes)
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, 2.0 * sample_rows / sizes[k] + 40.0 / sizes[k]))]), F.col("lang"))
    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    near = src.filter(place < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = near.withColumn("r", rank).filter(F.col("r") <= sample_rows).select("lang", "text")
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text_ in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                s = np.concatenate([np.full(ORDER, 32, np.uint8), fold(text_.encode("utf-8", "surrogatepass"))]).astype(np.int64)
                n = len(s) - ORDER
                code = np.zeros(n, np.int64)
                for j in range(ORDER + 1):
                    code = (code << 8) | s[j:j + n]
                code, c = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), number[name], np.int32)), pa.array(code), pa.array(c.astype(np.int64))],
                                                 ["lang", "code", "n"])

    grams = sample.mapInArrow(count, "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    return build(langs, grams["lang"].to_numpy(), grams["code"].to_numpy(), grams["n"].to_numpy().astype(np.float64))


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred string, score double and bits double.

    Null texts and texts without a letter are "und" with score 0 and no bits.
    score is the share of the winner among the languages' probabilities of the
    whole text, 2 ** -bits each, so near 1 for long texts; bits is the code
    length of the winner in bits a byte.  Equal code lengths: the language
    first by name.  keep names the columns to return (all but the text if not
    given, the text itself if named).  Rows are independent; nothing is
    shuffled, nothing but the text enters a prediction.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(model)  # contexts of the bounded sample
    src = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                      F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("_text"))
    names = [f"k{i}" for i in range(len(keep))]
    kinds = dict(src.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for batch in batches:
            texts = [None if t is None else t.encode("utf-8", "surrogatepass") for t in batch.column("_text").to_pylist()]
            rows = [i for i, t in enumerate(texts) if t is not None and m.langs]
            pred, score, bits = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if rows:
                cost = m.code_lengths([texts[i] for i in rows])
                best = cost.argmin(axis=1)
                least = cost.min(axis=1)
                share = 1 / np.exp2(np.maximum(least[:, None] - cost, -1000)).sum(axis=1)
                for i, b, s, c in zip(rows, best, share, least):
                    pred[i], score[i], bits[i] = m.langs[b], s, c / len(texts[i])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(pred, pa.string()), pa.array(score),
                                              pa.array(bits, mask=np.isnan(bits))], [*names, "lang_pred", "score", "bits"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in names], "lang_pred string", "score double", "bits double"])
    got = src.mapInArrow(run, schema)
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "bits")


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the key as text, a fifth of all rows; rows without key are held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
