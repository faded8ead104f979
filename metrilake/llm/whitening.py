"""Embedding whitening from refined eigenvectors.

Entries become integers x = floor(64 c) + 1000000.  Sums and centred products of
the distinct vectors are gathered as exact integers over all partitions, so the
covariance does not depend on the order of rows.  Its eigenvectors start in
float32 and are refined by matrix multiplications in extended precision after
Ogita and Aishima; eigenvalues too close for the correction form clusters, which
are solved again inside their own subspace.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table

SCALE, OFFSET = 64, 1_000_000
MOST = 2.0 ** 52              # scaled entries from here on have no floor of their own
COMPONENTS = 16
BLOCK = 1024                  # rows of a matrix product
LIMB = 20                     # bits of a limb where products of whole entries are not exact in doubles
STEPS = 30                    # refinement steps at most; a few do


# --- eigenvectors -----------------------------------------------------------------------
def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of two or more values, in falling order, whose neighbours are at most ``near`` apart."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(values[order][:-1] - values[order][1:] > near) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """x with its columns made orthonormal in its own precision (Newton-Schulz; x is nearly so)."""
    eye = np.eye(x.shape[1], dtype=x.dtype)
    for _ in range(4):
        r = eye - x.T @ x
        x = x + x @ r / 2
        if np.abs(r).max() < 1e-17:
            break
    return x


def refined_eigh(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    float32 eigenvectors X are corrected to X + X E from R = I - X'X and S = X'AX: E_ij is
    (S_ij + l_j R_ij) / (l_j - l_i) with l_i = S_ii / (1 - R_ii), or R_ij / 2 where l_i and l_j are closer than the
    correction can part them.  Such clusters are solved as X_c'(A - m I)X_c, shifted by their mean, in doubles, and
    their columns turned.  Products are taken in long doubles.  An eigenvector's sign makes its largest entry positive.
    """
    d = len(a)
    scale = np.abs(a).max() if d else 0.0
    if not scale:
        return np.zeros(d), np.eye(d)
    a = np.asarray(a, np.longdouble) / np.longdouble(scale)
    x = _orthonormal(np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble))
    eye = np.eye(d, dtype=np.longdouble)
    norm = float(np.sqrt((a * a).sum()))
    last, turned = np.inf, False
    for _ in range(STEPS):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        value = np.diag(s) / (1 - np.diag(r))
        rest = s - np.diag(value)
        near = 2 * (np.linalg.norm(rest.astype(float), 2) + norm * np.linalg.norm(r.astype(float), 2))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > near
        e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        size = float(np.abs(e).max())
        turned = False
        for c in _clusters(value, near):
            part = _orthonormal(x[:, c])
            mean = value[c].mean()
            sub = part.T @ (a @ part) - mean * np.eye(len(c), dtype=np.longdouble)
            top = np.abs(sub).max()
            if top > 0:
                turn = np.linalg.eigh((sub / top).astype(np.float64))[1]
                x[:, c] = part @ turn.astype(np.longdouble)
                off = sub / top - np.diag(np.diag(sub / top))
                turned |= bool(np.abs(off).max() > 1e-15 and top > 1e-18)
        if size < 1e-18 or (size >= last and size < 1e-16 and not turned):
            break
        last = size
    x = _orthonormal(x)
    value = np.diag(x.T @ (a @ x))
    order = np.argsort(-value, kind="stable")
    x = x[:, order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1, 1)
    return (value[order] * np.longdouble(scale)).astype(np.float64), x.astype(np.float64)


# --- exact sums ---------------------------------------------------------------------------
def _rows(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    """The rows x d matrix of a column of lists of d longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, d)


def products(y: np.ndarray) -> np.ndarray:
    """y'y of an integer matrix as Python integers, exact whatever the entries."""
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), BLOCK):
        part = y[at:at + BLOCK]
        top = int(np.abs(part).max()) if part.size else 0
        if top * top * len(part) < 1 << 53:
            f = part.astype(np.float64)
            out += (f.T @ f).astype(np.int64).astype(object)
            continue
        limbs = []
        left = part.copy()
        while left.any():
            low = left & ((1 << LIMB) - 1)
            limbs.append(low.astype(np.float64))
            left = (left - low) >> LIMB
            if left.size and (left == -1).any() and ((left == -1) | (left == 0)).all():
                limbs.append(left.astype(np.float64))
                break
        for i, p in enumerate(limbs):
            for j, q in enumerate(limbs):
                out += (p.T @ q).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
    return out


@dataclass
class Whitening:
    """n distinct vectors of d entries, their sums, and the components (columns) with eigenvalues, falling."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray

    @property
    def d(self) -> int:
        return len(self.sums)

    @property
    def centre(self) -> list[int]:
        """The integers nearest the means."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows centred, on the components, at unit variance."""
        c = self.centre
        left = np.array([float(Fraction(s, self.n) - m) for s, m in zip(self.sums, c)])
        return ((x - np.array(c, np.int64)).astype(np.float64) - left) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sums over the entries of (n x - sum) ** 2, as Python integers."""
        c = self.centre
        y = x - np.array(c, np.int64)
        off = [s - self.n * m for s, m in zip(self.sums, c)]
        top = float(np.abs(y).max(initial=0)) * self.n + max(abs(o) for o in off)
        if top * top * self.d < 2.0 ** 62:
            t = y * np.int64(self.n) - np.array(off, np.int64)
            return (t * t).sum(axis=1).tolist()
        t = y.astype(object) * self.n - np.array(off, object)
        return (t * t).sum(axis=1).tolist()


def integers(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """df's rows with a usable vector, with the column x of longs.

    A vector is usable if it is not null or empty, has no null or non-finite entry, no entry of 2**46 or more, and as
    many entries as most of the others have (of counts equally frequent, the larger).  Columns of df stay.
    """
    e = F.col(embedding)
    whole = F.forall(e, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * SCALE < MOST))
    some = df.filter(e.isNotNull() & (F.size(e) > 0)).filter(whole)
    sizes = some.groupBy(F.size(e).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return some.filter(F.size(e) == d).withColumn("x", F.transform(e, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET))


def fit(x: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of x's distinct vectors (column x), and the table of these; none where nothing varies.

    Each partition sends d sums, then d (d + 1) / 2 sums of products: both follow the vectors' length, not the rows.
    Components without variance (an eigenvalue within rounding of zero) are not made.
    """
    fits = shared_table(x.select("x").distinct(), "whitening-fit")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                m = _rows(b.column("x"), len(b.column("x")[0]))
                n += len(m)
                part = [int(v) for v in m.sum(axis=0)] if np.abs(m).max() < (1 << 62) // len(m) else [int(v) for v in m.astype(object).sum(axis=0)]
                total = part if total is None else [p + q for p, q in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(t) for t in total]), pa.array([n] * len(total), pa.int64())],
                                             ["i", "s", "n"])

    got = (fits.mapInArrow(sums, "i int, s string, n long").groupBy("i")
           .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect())
    if not got:
        return None, fits
    n, total = got[0]["n"], [int(r["s"]) for r in got]
    d = len(total)
    white = Whitening(n, total, 0.0, np.zeros(0), np.zeros((d, 0)))
    centre = white.centre
    upper = np.triu_indices(d)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if b.num_rows:
                part = products(_rows(b.column("x"), d) - np.array(centre, np.int64))
                out = part if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0] * d + upper[1], pa.int64()), pa.array([str(v) for v in out[upper]])], ["ij", "s"])

    cross = fits.mapInArrow(crossed, "ij long, s string").groupBy("ij").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    left = [s - n * m for s, m in zip(total, centre)]     # sums about the integer centre
    v = np.zeros((d, d))
    for r in cross:
        i, j = divmod(r["ij"], d)
        v[i, j] = v[j, i] = float(Fraction(n * int(r["s"]) - left[i] * left[j], n * n))
    trace = float(np.trace(v))
    values, vectors = refined_eigh(v)
    keep = int((values > d * 2.0 ** -50 * values[0]).sum()) if trace > 0 else 0
    keep = min(keep, components)
    if not keep:
        return None, fits
    return Whitening(n, total, trace, values[:keep], vectors[:, :keep]), fits


def identity_error(fits: DataFrame, white: Whitening) -> float:
    """The largest absolute entry of the covariance of fits' whitened vectors minus the identity, measured on all of them."""
    held = fits.sparkSession.sparkContext.broadcast(white)
    k = len(white.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Whitening = held.value
        out, total = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            if b.num_rows:
                z = w.project(_rows(b.column("x"), w.d))
                out += z.T @ z
                total += z.sum(axis=0)
        ij = np.arange(k * k + k)
        yield pa.RecordBatch.from_arrays([pa.array(ij, pa.int64()), pa.array(np.concatenate([out.ravel(), total]))], ["ij", "s"])

    got = dict(fits.mapInArrow(run, "ij long, s double").groupBy("ij").agg(F.sum("s")).collect())
    mean = np.array([got[k * k + i] for i in range(k)]) / white.n
    cov = np.array([got[i] for i in range(k * k)]).reshape(k, k) / white.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(df: DataFrame, *, embedding: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector of df (see ``integers``) and component: the columns ``keep`` (all but the vector if not
    given), component int, n, deviation, deviation_exact, whitened, explained, identity_error.

    Other rows give none; repeated rows count once in the fit and are all returned.  Where fewer components have
    variance, fewer are returned; none of an empty table or of vectors all alike.  deviation is null where a long
    cannot hold it; deviation_exact, a decimal, holds up to 38 digits.  Columns of df may have any name.
    """
    keep = [c for c in df.columns if c != embedding] if keep is None else keep
    names = [f"k{i}" for i in range(len(keep))]
    src = integers(df.select(*[F.col(c).alias(k) for c, k in zip(keep, names)], F.col(embedding).alias("embedding"))).select(*names, "x")
    white, fits = fit(src, components)
    schema = ", ".join([*[f"{k} {t}" for k, t in src.dtypes if k != "x"], "component int, n long, deviation long, deviation_exact decimal(38,0), "
                        "whitened double, explained double, identity_error double"])
    back = [F.col(k).alias(c) for c, k in zip(keep, names)]
    rest = ["component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"]
    if white is None:
        return df.sparkSession.createDataFrame([], schema).select(*back, *rest)
    held = df.sparkSession.sparkContext.broadcast((white, identity_error(fits, white)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        w, error = held.value
        k = len(w.values)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                m = b.num_rows
                x = _rows(b.column("x"), w.d)
                dev = w.deviation(x)
                rows = pa.array(np.repeat(np.arange(m), k))
                each = lambda v, t: pa.array(v, t).take(rows)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(rows) for c in names], pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                     pa.array(np.full(m * k, w.n), pa.int64()), each([v if v < 1 << 63 else None for v in dev], pa.int64()),
                     each([Decimal(v) if v < 10 ** 38 else None for v in dev], pa.decimal128(38, 0)), pa.array(w.project(x).ravel()),
                     pa.array(np.tile(w.values / w.trace, m)), pa.array(np.full(m * k, error))], [*names, *rest])

    return src.mapInArrow(run, schema).select(*back, *rest)
