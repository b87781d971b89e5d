"""Embedding whitening: principal components by QDWH spectral divide and conquer, and whitened coordinates.

1. Entries become whole numbers x = floor(256 c). The fit list has each distinct x-vector once; it is made
   by a distinct over compact keys and checkpointed, so a vector that a third of all rows share is one row.
2. Counts, sums and products of the fit list are summed by Spark in whole numbers: entries are centred on the
   whole part of their mean before they are multiplied, and what the rounding of the mean leaves is taken off exactly. So
   the covariance does not depend on partitions or order, and is rounded once. Each task gives one row of
   sums, and the driver gets as many as the root of the number of tasks, whatever the number of rows.
3. The covariance (dimension x dimension) is split by spectral divide and conquer: the polar factor U of V - shift I,
   found by QDWH (dynamically weighted Halley steps, by QR while they are ill-conditioned and by Cholesky after), gives
   the projector (U + I) / 2 on the invariant subspace of all eigenvalues above the shift; bases of it and of its
   complement cut the matrix in two, and the blocks that hold wanted components are split on, down to single ones.
4. The components are broadcast (dimension x wanted numbers) and rows are whitened where they are.

Defined cases: rows with a null vector, or with null, infinite or NaN entries, are dropped, and so are vectors of another
length than most distinct ones have (of equally frequent lengths the larger counts). Null keys and
repeated rows stay. Entries of any size are handled; a deviation beyond 64 bits is null. Components whose eigenvalue is zero
to double precision can't be scaled: `whitened` is null there, and the identity error leaves them out (it is 0 if
none is left). An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.llm.common import table
from tessella.shared import checkpoint

#: Steps that a unit of an entry is divided into.
STEPS = 256
#: Components of the query.
COMPONENTS = 4
EPS = float(np.finfo(float).eps)
#: Whole numbers below this are exact as doubles.
EXACT = 1 << 53
LONG = 1 << 63


# ---- QDWH spectral divide and conquer


def polar(a: np.ndarray) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix by QDWH; None where it is singular to working precision."""
    size = len(a)
    scale = np.linalg.norm(a)
    if not scale:
        return None
    one = np.eye(size)
    x, least = a / scale, EPS / 4
    for _ in range(30):
        square = least * least
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        else:
            low = np.linalg.cholesky(one + wc * (x.T @ x))
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(low.T, np.linalg.solve(low, x.T)).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        least = min(1.0, least * (wa + wb * square) / (1 + wc * square))
        if moved < EPS ** (1 / 3) and 1 - least < 1e-8:
            break
    return x if np.linalg.norm(x @ x - one) < 1e-10 * size else None


def _range_of(projector: np.ndarray, size: int, seed: int) -> np.ndarray:
    """An orthonormal basis of the range of a projector of this rank: two steps of subspace iteration."""
    basis = projector @ np.random.default_rng(seed).standard_normal((len(projector), size))
    for _ in range(2):
        basis = projector @ np.linalg.qr(basis)[0]
    return np.linalg.qr(basis)[0]


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below some shift; None where eigenvalues don't differ."""
    size = len(a)
    diagonal = np.diag(a)
    mean = float(diagonal.mean())
    spread = float(np.linalg.norm(a - mean * np.eye(size))) / np.sqrt(size)
    for shift in (float(np.median(diagonal)), mean, *(mean + f * spread for f in (0.31, -0.31, 0.73, -0.73, 0.11, -0.11))):
        u = polar(a - shift * np.eye(size))
        if u is None:
            continue
        above = (u + np.eye(size)) / 2
        rank = round(float(np.trace(above)))
        if not 0 < rank < size:
            continue
        v1, v2 = _range_of(above, rank, size), _range_of(np.eye(size) - above, size - rank, size + 1)
        if np.linalg.norm(v1.T @ a @ v2) <= 16 * size * EPS * scale and np.linalg.norm(v1.T @ v2) < 1e-10:
            return v1, v2
    return None


def components_of(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    The largest entry of each vector is positive. Eigenvalues that agree to double precision share an invariant
    subspace, of which any basis serves.
    """
    scale = float(np.linalg.norm(a))
    found: list[np.ndarray] = []
    blocks = [np.eye(len(a))]  # bases of invariant subspaces, of falling eigenvalues; the last one is next
    while blocks and sum(b.shape[1] for b in found) < count:
        basis = blocks.pop()
        inner = basis.T @ a @ basis
        inner = (inner + inner.T) / 2
        size = len(inner)
        single = size == 1 or np.linalg.norm(inner - np.diag(np.diag(inner))) <= EPS * scale
        parts = None if single else split(inner, scale)
        if parts is None:
            found.append(basis[:, np.argsort(-np.diag(inner), kind="stable")])
        else:
            blocks += [np.linalg.qr(basis @ p)[0] for p in reversed(parts)]
    vectors = np.column_stack(found) if found else np.empty((len(a), 0))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:count]
    vectors, values = vectors[:, order], values[order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if len(order) else np.ones(0)
    return values, vectors * signs


# ---- whole-number vectors


def whole(batch: pa.Array) -> np.ndarray:
    """floor(256 c) of the vectors of a list column of equal lengths, as int64 rows; beyond 64 bits the nearest long."""
    flat = batch.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    scaled = np.floor(flat * STEPS)
    big = np.abs(scaled) >= 2.0**63
    out = np.where(big, 0, scaled).astype(np.int64)
    if big.any():
        out[big] = np.where(scaled[big] > 0, LONG - 1, -LONG)
    return out.reshape(len(batch), -1)


def packed(x: np.ndarray) -> list[bytes]:
    """A key for each row: one byte with the width of its entries, and the entries."""
    out: list[bytes] = [b""] * len(x)
    low, high = x.min(axis=1), x.max(axis=1)
    free = np.ones(len(x), bool)
    for width in (1, 2, 4, 8):
        edge = (1 << (8 * width - 1)) - 1
        rows = np.flatnonzero(free & (high <= edge) & (low >= -edge - 1))
        free[rows] = False
        data, tag, step = x[rows].astype(f"<i{width}").tobytes(), bytes([width]), width * x.shape[1]
        for k, i in enumerate(rows.tolist()):
            out[i] = tag + data[k * step : (k + 1) * step]
    return out


def unpacked(keys: list[bytes], dim: int) -> Iterator[np.ndarray]:
    """The rows of packed() keys in blocks, in any order."""
    for width in (1, 2, 4, 8):
        some = [k[1:] for k in keys if k[0] == width]
        if some:
            yield np.frombuffer(b"".join(some), f"<i{width}").astype(np.int64).reshape(len(some), dim)


def _products(x: np.ndarray) -> np.ndarray:
    """x^T x in whole numbers: by doubles where all sums are exact in them, else by Python's integers."""
    top = max(abs(int(x.max())), abs(int(x.min())))
    if top * top * len(x) < EXACT:
        y = x.astype(float)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def usable(vector: str) -> Column:
    """Whether a vector has entries and all of them are finite."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


@dataclass(frozen=True)
class Whitening:
    """A fitted model. sums: exact, by dimension; vectors: columns are components; errors: largest of whitened's covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def scales(self) -> np.ndarray:
        """Square roots of the eigenvalues; NaN for those that are zero to double precision."""
        zero = self.values <= max(self.trace, 0.0) * self.dim * EPS
        return np.sqrt(np.where(zero, np.nan, self.values))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S in whole numbers (int64, or Python's where these could overflow)."""
        top = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
        small = top * self.n + max(map(abs, self.sums)) < LONG
        return self.n * x - np.array(self.sums, np.int64) if small else self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(float) @ self.vectors / self.scales

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2; None beyond 64 bits."""
        y = self.centred(x)
        if y.dtype == object or (y.size and max(abs(int(y.max())), abs(int(y.min()))) ** 2 * self.dim >= LONG):
            y = y.astype(object)
            return [v if v < LONG else None for v in (y * y).sum(axis=1)]
        return (y * y).sum(axis=1).tolist()


def fit_list(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """dim, key: each distinct whole-number vector once, checkpointed."""
    source = df.select(F.col(vector).cast("array<double>").alias("v")).where(usable("v")).select("v", F.size("v").alias("dim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                keys = list(dict.fromkeys(packed(whole(batch.column("v").filter(pa.array(dims == dim))))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), dim, np.int32)), pa.array(keys, pa.binary())], names=["dim", "key"])

    return checkpoint(source.mapInArrow(run, "dim int, key binary").distinct())


def _sums(fitted: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray | None:
    """The sum over the fit list of the arrays that `part` makes of blocks of rows, flat; None without rows.

    Whole numbers travel as text, as they may have any size. Each task gives one row, and about the root of their number of tasks adds these up, so that the driver adds few.
    """
    number = pa.float64() if kind == "double" else pa.string()

    def one(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            values = total.ravel().tolist() if kind == "double" else [str(int(v)) for v in total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([values], pa.list_(number))], names=["sums"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in unpacked(batch.column("key").to_pylist(), dim):
                got = part(x)
                total = got if total is None else total + got
        yield from one(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for values in batch.column("sums").to_pylist():
                got = np.array([float(v) if kind == "double" else int(v) for v in values], float if kind == "double" else object)
                total = got if total is None else total + got
        yield from one(total)

    schema = f"sums array<{kind}>"
    tasks = fitted.rdd.getNumPartitions()
    rows = fitted.select("key").mapInArrow(first, schema).repartition(max(1, int(tasks**0.5))).mapInArrow(again, schema).collect()
    if not rows:
        return None
    return sum(np.array([float(v) if kind == "double" else int(v) for v in r["sums"]], float if kind == "double" else object) for r in rows)


def fit(df: DataFrame, vector: str = "embedding", count: int = COMPONENTS) -> Whitening | None:
    """Fit the first `count` components on the distinct vectors; None without any."""
    fitted = fit_list(df, vector)
    most = fitted.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return None
    dim, n = int(most["dim"]), int(most["n"])
    fitted = fitted.where(F.col("dim") == dim)
    whole_sums = lambda x: (x.astype(object) if np.abs(x.astype(float)).max() * len(x) >= 2.0**62 else x).sum(axis=0).astype(object)
    sums = [int(v) for v in _sums(fitted, dim, whole_sums, "string")]
    middle = [s // n for s in sums]
    wide = max(map(abs, middle)) >= 1 << 61

    def products(x: np.ndarray) -> np.ndarray:
        safe = not wide and max(abs(int(x.max())), abs(int(x.min()))) < 1 << 61
        y = x - np.array(middle, np.int64) if safe else x.astype(object) - np.array(middle, object)
        return _products(y)

    got = _sums(fitted, dim, products, "string")
    left = [s - n * m for s, m in zip(sums, middle)]  # sums of what was multiplied, each below n
    cov = np.array([[float(Fraction(n * int(got[i * dim + j]) - left[i] * left[j], n * n)) for j in range(dim)] for i in range(dim)])
    values, vectors = components_of(cov, min(count, dim))
    model = Whitening(n, tuple(sums), values, vectors, float(np.trace(cov)))
    return Whitening(model.n, model.sums, values, vectors, model.trace, identity_error(fitted, model))


def identity_error(fitted: DataFrame, model: Whitening) -> float:
    """The largest entry of the fit list's whitened covariance minus the identity, over components that can be scaled."""
    keep = np.flatnonzero(~np.isnan(model.scales))
    k, dim = len(keep), model.dim
    if not k:
        return 0.0

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)[:, keep]
        return np.vstack([w.T @ w, w.sum(axis=0)])

    got = _sums(fitted, dim, moments, "double").reshape(k + 1, k) / model.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error of all usable rows; no shuffle."""
    kind = df.select(key).schema[0].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    source = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(usable("v") & (F.size("v") == model.dim))
    shared = df.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        share = m.values / m.trace if m.trace > 0 else np.zeros(k)
        for batch in batches:
            rows = batch.num_rows
            x = whole(batch.column("v"))
            w = m.whitened(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, m.n, np.int64)), pa.array([d for d in m.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(w, mask=np.isnan(w)), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, m.identity_error)),
                ],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(rows, fit(rows))
