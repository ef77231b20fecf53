"""Whitening of embeddings by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson iteration.

The covariance matrix is never formed. Its product with a few vectors is one Spark job over the centred rows: each task adds up its
blocks' ``(x - mean) ((x - mean) u)``, and a few sums of the size of the vectors come back. The iteration itself works on
vectors of the dimension of the embeddings:

1. Rayleigh-Ritz on a search space gives approximate eigenpairs. One whose residual is at the level of double precision is locked, in
   order of falling eigenvalue; all further work is orthogonal to what is locked.
2. For the leading others, the correction equations, projected against the locked vectors and the approximate one, are solved by a
   few steps of MINRES, all of them in step, so that one product serves them all.
3. The corrections extend the search space, which is cut back to its best part when it grows large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from bazaarledger.llm.frames import binary_list, fresh, ship, stored

COMPONENTS = 4
#: Rows of one stored block of the fit list.
BLOCK = 4096
#: Steps of MINRES for a correction, and vectors of the search space before it is cut back.
INNER, MOST_SPACE = 3, 96
#: Approximate pairs that get a correction in a step: more than are wanted, so that close eigenvalues part sooner for equally many jobs.
AIMS = 16
#: A pair is locked when its residual is at most so many rounding units (of a double, times the largest eigenvalue).
UNITS = 256
#: Outer steps after which the iteration counts as failed: it raises, and never returns what has not converged.
MOST_OUTER = 400

Product = Callable[[np.ndarray], np.ndarray]


def _orthonormal(vectors: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns spanning what of ``vectors`` is orthogonal to ``against``; columns with nothing left are dropped."""
    kept: list[np.ndarray] = []
    for v in vectors.T:
        size = np.linalg.norm(v)
        if not size:
            continue
        v = v / size
        for _ in range(3):
            for basis in against:
                v = v - basis @ (basis.T @ v)
            for q in kept:
                v = v - q * (q @ v)
            left = np.linalg.norm(v)
            if left < 1e-8:
                break
            v = v / left
        else:
            kept.append(v)
    return np.stack(kept, axis=1) if kept else np.zeros((len(vectors), 0))


def _corrections(product: Product, locked: np.ndarray, ritz: np.ndarray, values: np.ndarray, residuals: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (I - QQ')(V - value I)(I - QQ') t = -residual, Q = locked and the Ritz vector, by MINRES per column."""
    def project(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - locked @ (locked.T @ x)
            x = x - ritz * np.sum(ritz * x, axis=0)
        return x

    def divided(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.divide(x, by, out=np.zeros_like(x), where=by > 0)

    v = project(-residuals)
    beta = np.linalg.norm(v, axis=0)
    v, before = divided(v, beta), np.zeros_like(v)
    answer, w, w_before = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    goal, off = beta.copy(), np.zeros_like(beta)
    c, c_before, s, s_before = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        # Lanczos: the next vector of the Krylov space
        image = project(product(v) - values * v) - off * before
        alpha = np.sum(v * image, axis=0)
        image = image - alpha * v
        after = np.linalg.norm(image, axis=0)
        # two earlier rotations on the new column of the tridiagonal matrix, and a new one
        above, rest = s_before * off, c_before * off
        middle, rest = c * rest + s * alpha, c * alpha - s * rest
        diagonal = np.hypot(rest, after)
        c_now, s_now = divided(rest, diagonal), divided(after, diagonal)
        c_now = np.where(diagonal > 0, c_now, 1.0)
        w_now = divided(v - middle * w - above * w_before, diagonal)
        answer = answer + goal * c_now * w_now
        goal = -s_now * goal
        before, v, off = v, divided(image, after), after
        w_before, w = w, w_now
        c_before, c, s_before, s = c, c_now, s, s_now
        if not np.any(np.abs(goal) > 0.01 * beta):
            break
    return project(answer)


def leading_eigenpairs(product: Product, dimension: int, many: int = COMPONENTS, units: float = UNITS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``many`` largest eigenvalues of a symmetric positive semi-definite matrix, given by its products.

    Falling values; as many pairs as the dimension has, if that is less. Every pair returned has a residual at the level of double
    precision; RuntimeError if that is not reached.
    """
    many = min(many, dimension)
    locked, values = np.zeros((dimension, 0)), np.zeros(0)
    space = _orthonormal(np.random.default_rng(seed).standard_normal((dimension, min(dimension, 2 * many))))
    images, scale = product(space), 0.0
    for step in range(MOST_OUTER):
        # Rayleigh-Ritz; the space is kept as its Ritz vectors, best first
        small = space.T @ images
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, space, images = theta[::-1], space @ turn[:, ::-1], images @ turn[:, ::-1]
        scale = max(scale, float(theta[0]))
        level = units * np.finfo(float).eps * scale

        def residuals(k: int) -> np.ndarray:
            out = images[:, :k] - space[:, :k] * theta[:k]
            return out - locked @ (locked.T @ out)

        aims = min(AIMS, len(theta))
        lock = int(np.cumprod(np.linalg.norm(residuals(min(many - len(values), len(theta))), axis=0) <= level).sum())
        if lock:
            # the images were turned many times: judge by new products of what is to be locked
            images[:, :lock] = product(space[:, :lock])
            lock = int(np.cumprod(np.linalg.norm(residuals(lock), axis=0) <= level).sum())
            locked, values = np.concatenate([locked, space[:, :lock]], axis=1), np.concatenate([values, theta[:lock]])
            space, images, theta = space[:, lock:], images[:, lock:], theta[lock:]
            if len(values) >= many:
                order = np.argsort(-values, kind="stable")
                return np.maximum(values[order], 0), locked[:, order]
            aims = min(AIMS, len(theta))
        if len(theta) > MOST_SPACE:
            space, images, theta = space[:, : MOST_SPACE // 3], images[:, : MOST_SPACE // 3], theta[: MOST_SPACE // 3]
        new = np.zeros((dimension, 0))
        if aims:
            new = _orthonormal(_corrections(product, locked, space[:, :aims], theta[:aims], residuals(aims), INNER), locked, space)
        if not new.shape[1]:  # the equations add nothing: a direction not seen yet, if there is one
            new = _orthonormal(np.random.default_rng(seed + step + 1).standard_normal((dimension, 1)), locked, space)
        if new.shape[1]:
            space, images = np.concatenate([space, new], axis=1), np.concatenate([images, product(new)], axis=1)
        elif not len(theta):
            break
    raise RuntimeError(f"only {len(values)} of {many} eigenpairs reached a residual of {level}")


class Whitening:
    """Mean, covariance eigenpairs and scale of a fit list. ``values`` fall, all of them positive; ``vectors`` are their columns."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, identity_error: float):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors
        self.trace, self.identity_error = trace, identity_error


def _centre(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    return (x - whole).astype(np.float64) - part


def _mean(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and fractions, so that centring loses no digit to its size."""
    both = [divmod(s, n) for s in sums]
    return np.array([w for w, _ in both], dtype=np.int64), np.array([r / n for _, r in both])


def grid(vector: Column | str, scale: float) -> Column:
    """Entries as whole numbers floor(scale * c); what a long can't hold becomes its nearest value."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(0).cast("long"))


def usable(vector: Column | str) -> Column:
    """The vector and all its entries are there and finite; false for an empty vector."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def _blocks(fit: DataFrame, x: str, dimension: int) -> DataFrame:
    """Blocks of up to BLOCK vectors as little-endian longs, in the shared folder: one row of bytes per block."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, dimension)
            yield pa.RecordBatch.from_arrays([binary_list([flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)])], ["block"])

    return stored(fit.select(x).mapInArrow(pack, "block binary"))


def _total(blocks: DataFrame, dimension: int, shape: tuple[int, ...], kind: type, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part(vectors)`` over all blocks: per task, then over groups of tasks, then of those few on the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=kind)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += part(np.frombuffer(raw, dtype="<i8").reshape(-1, dimension))
        yield pa.RecordBatch.from_arrays([binary_list([total.astype(final).tobytes()])], ["total"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=kind)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(raw, dtype=final).reshape(shape)
        yield pa.RecordBatch.from_arrays([binary_list([total.astype(final).tobytes()])], ["total"])

    final = np.int64 if kind is np.int64 else np.float64
    rows = blocks.mapInArrow(add, "total binary").repartition(16).mapInArrow(merge, "total binary").collect()  # 16 rows, whatever the input
    out = np.zeros(shape, dtype=kind)
    for row in rows:
        out += np.frombuffer(bytes(row.total), dtype=final).reshape(shape)
    return out.astype(final)


def fit_whitening(vectors: DataFrame, x: str, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors of longs in column ``x`` (each counts once, however often it occurs); None without any.

    All vectors must be of one length. As many components as there are positive eigenvalues, up to ``components``.
    """
    spark = vectors.sparkSession
    ship(spark)
    fit = vectors.select(x).distinct()
    first = vectors.select(F.size(x).alias("d")).first()
    if first is None:
        return None
    d = first.d
    blocks = _blocks(fit, x, d)
    counted = _total(blocks, d, (d + 1,), np.int64, lambda v: np.append(v.sum(axis=0), len(v)))
    n, sums = int(counted[-1]), [int(s) for s in counted[:-1]]
    whole, part = _mean(n, sums)

    def product(u: np.ndarray) -> np.ndarray:
        def one(v: np.ndarray) -> np.ndarray:
            centred = _centre(v, whole, part)
            return centred.T @ (centred @ u)

        return _total(blocks, d, u.shape, np.longdouble, one) / n

    values, columns = leading_eigenpairs(product, d, components)
    positive = values > d * UNITS * np.finfo(float).eps * values[0]
    values, columns = values[positive], columns[:, positive]
    k = len(values)

    def moments(v: np.ndarray) -> np.ndarray:
        centred = _centre(v, whole, part)
        white = centred @ columns / np.sqrt(values)
        return np.concatenate([(white.T @ white).reshape(-1), white.sum(axis=0), [np.sum(centred * centred)]])

    sums_of = _total(blocks, d, (k * k + k + 1,), np.longdouble, moments) / n
    covariance = sums_of[: k * k].reshape(k, k) - np.outer(sums_of[k * k : -1], sums_of[k * k : -1])
    return Whitening(n, sums, values, columns, float(sums_of[-1]), float(np.abs(covariance - np.eye(k)).max(initial=0)))


def whiten(df: DataFrame, vector: str, id: str, components: int = COMPONENTS, scale: float = 256.0) -> DataFrame:
    """Whitened coordinates: one row per usable row and component, (id, component, n, deviation, whitened, explained, identity_error).

    Entries are put on a grid, x = floor(scale * c); the covariance is that of the ``n`` distinct x vectors. ``component`` counts from 1
    by falling eigenvalue e; ``whitened`` is (x - mean) projected on it over sqrt(e); ``explained`` is e over the trace;
    ``deviation`` is the exact squared distance of x from the mean, times n * n (NULL where a long can't hold it);
    ``identity_error`` is how far the covariance of the whitened fit list is from the identity.

    Rows whose vector is NULL, empty or holds a NULL or non-finite entry are left out, and so are vectors of another length than the most
    frequent one (of equally frequent lengths, the longest). Repeated rows and NULL ids are carried as they are. Components without
    variance do not exist: equal vectors alone, or a single one, give no rows, as an empty table does. Extra columns are ignored.
    """
    ship(df.sparkSession)
    (x,) = fresh(df.select(id), "x")
    rows = df.where(usable(vector)).select(F.col(id), grid(vector, scale).alias(x))
    schema = StructType([df.schema[id], StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    lengths = rows.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size(x) == lengths.d)
    model, d = fit_whitening(rows, x, components), lengths.d
    n, sums, columns, k = model.n, model.sums, model.vectors / np.sqrt(model.values), len(model.values)
    whole, part = _mean(n, sums)
    explained, error = model.values / model.trace if k else np.zeros(0), model.identity_error

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            m = len(v)
            most = int(max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))) * n + max(map(abs, sums))
            kind = np.int64 if d * most * most < 2**63 else object  # Python's own integers where longs could overflow
            apart = v.astype(kind) * n - np.array(sums, dtype=kind)
            deviation = [int(s) if s < 2**63 else None for s in (apart * apart).sum(axis=1)]
            white = _centre(v, whole, part) @ columns
            again = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pa.array(deviation, pa.int64()).take(pa.array(again)), pa.array(white.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], schema.names)

    return rows.mapInArrow(apply, schema)
