"""Whitening of vectors by a block Jacobi-Davidson eigensolver.

The covariance matrix is never formed: it is known by its products with a few
vectors only, and each product is one Spark pass over the centred rows, whose
partial sums per task Spark adds up. The driver keeps a small search space.
Rayleigh-Ritz on that space gives approximate components; for each that isn't
done yet, the correction equation, projected against it and against all that
are locked, is solved by a few MINRES steps, all equations in step with each
other, so that a step is one pass. The corrections widen the space. Components
whose residual has come down to rounding are locked, in falling order, until all
are.

Entries are taken as whole numbers floor(1024 c) + 100000, so that sums and the
squared deviation are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, written

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
#: Entries at or beyond this (so that x keeps to 2^53) are not finite for our purpose.
LARGEST = 2.0**42
#: MINRES steps for each correction; a step is a pass over the rows.
INNER = 4
#: The search space is cut back to its best vectors beyond so many times the components.
SPACE = 8
MAX_OUTER = 200
EPS = float(np.finfo(np.float64).eps)

Product = Callable[[np.ndarray], np.ndarray]


class Found(NamedTuple):
    values: np.ndarray  # falling
    vectors: np.ndarray  # columns
    residuals: np.ndarray
    products: int  # passes over the operator


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what new has beyond the orthonormal columns of against."""
    out = np.empty((len(new), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v = v / size
        for _ in range(3):
            v = v - against @ (against.T @ v) - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out


def minres(product: Product, rhs: np.ndarray, shifts: np.ndarray, known: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t of (I - KK')(A - shift I)(I - KK') t = rhs, a column each, by `steps` MINRES steps in common.

    known has orthonormal columns K; rhs is orthogonal to them. Lanczos vectors
    are built column by column, and Givens rotations keep the least residual.
    """
    keep = lambda w: w - known @ (known.T @ w)
    rhs = keep(rhs)
    size = np.linalg.norm(rhs, axis=0)
    live = size > 0
    v_old, v = np.zeros_like(rhs), rhs / np.where(live, size, 1.0)
    d_old, d = np.zeros_like(rhs), np.zeros_like(rhs)
    t, beta, rest = np.zeros_like(rhs), np.zeros(rhs.shape[1]), size.copy()
    c_old, s_old = np.ones_like(size), np.zeros_like(size)
    c, s = np.ones_like(size), np.zeros_like(size)
    for _ in range(steps):
        if not live.any():
            break
        w = keep(product(v)) - shifts * v
        w = keep(w)
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v - beta * v_old
        beta_new = np.linalg.norm(w, axis=0)
        far, near, here = s_old * beta, c * c_old * beta + s * alpha, c * alpha - s * c_old * beta
        pivot = np.hypot(here, beta_new)
        live &= pivot > EPS * size
        safe = np.where(live, pivot, 1.0)
        c_old, s_old, c, s = c, s, here / safe, beta_new / safe
        d_old, d = d, (v - near * d - far * d_old) / safe
        t = t + np.where(live, c * rest, 0.0) * d
        rest = -s * rest
        live &= beta_new > EPS * size
        v_old, v, beta = v, w / np.where(beta_new > 0, beta_new, 1.0), beta_new
    return keep(t)


def eigenpairs(product: Product, size: int, wanted: int, *, inner: int = INNER, seed: int = 7) -> Found:
    """The `wanted` largest eigenpairs of a symmetric positive operator of this size.

    Residuals come down to a small multiple of rounding against the largest
    eigenvalue; where they stop falling below 1e-12 of it they count as there.
    """
    wanted = min(wanted, size)
    passes = 0

    def times(w: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(w)

    rng = np.random.default_rng(seed)
    locked = np.empty((size, 0))
    values, residuals = [], []
    space = _orthonormal(rng.standard_normal((size, min(size, wanted + 2))), locked)
    image = times(space)
    before, largest = np.inf, 0.0
    for _ in range(MAX_OUTER):
        theta, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        left = wanted - locked.shape[1]
        ritz, moved = space @ turn[:, :left], image @ turn[:, :left]
        gap = moved - theta[:left] * ritz
        gap -= locked @ (locked.T @ gap)
        norms = np.linalg.norm(gap, axis=0)
        largest = max(largest, *values[:1], float(theta[0]), 0.0)
        worst = float(norms.max())
        whole = locked.shape[1] + space.shape[1] >= size
        stalled = worst <= 1e-12 * largest and worst >= 0.5 * before
        limit = np.inf if whole and stalled else 16 * EPS * largest * (1 + 7 * stalled)
        before = worst
        done = 0
        while done < left and norms[done] <= limit:
            done += 1
        if done:
            locked = np.column_stack([locked, ritz[:, :done]])
            values += theta[:done].tolist()
            residuals += norms[:done].tolist()
            space, image = space @ turn[:, done:], image @ turn[:, done:]
            before = np.inf
        if locked.shape[1] == wanted or not space.shape[1]:
            break
        ritz, gap, theta = ritz[:, done:], gap[:, done:], theta[done:left]
        left -= done
        if space.shape[1] + left > max(SPACE * wanted, 2 * left):
            # What the space knows best stays.
            cut = max(2 * left, left + 8)
            if not done:
                space, image = space @ turn[:, :cut], image @ turn[:, :cut]
            else:
                space, image = space[:, :cut], image[:, :cut]
        known = np.column_stack([locked, ritz])
        known, _ = np.linalg.qr(known)
        fresh = minres(times, -gap, theta, known, inner)
        fresh = _orthonormal(np.column_stack([fresh, gap]) if not whole else rng.standard_normal((size, left)), np.column_stack([locked, space]))[:, :left]
        if fresh.shape[1]:
            space, image = np.column_stack([space, fresh]), np.column_stack([image, times(fresh)])
        else:
            # Nothing is left outside: products anew, without what rounding has gathered.
            space = _orthonormal(space, locked)
            image = times(space)
    order = np.argsort(-np.array(values), kind="stable")
    return Found(np.array(values)[order], locked[:, order], np.array(residuals)[order], passes)


class Fit(NamedTuple):
    n: int
    sums: list[int]  # per dimension, exact
    found: Found
    trace: float


def _whole(c: Column) -> Column:
    return F.floor(c.cast("double") * SCALE) + SHIFT


def whole_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec, x array<long>), written once and read by every pass.

    Vectors that are null or hold null, non-finite or too large (LARGEST)
    entries are left out, and so are those of another length than most have (of
    equally frequent lengths the longest counts; empty ones never do).
    """
    values = F.col("v")
    sound = F.forall(values, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    good = rows.select(F.col(vec_id).alias("vec"), F.col(vector).alias("v")).where((F.size(values) > 0) & sound)
    kept = written(good.select("vec", F.transform(values, _whole).alias("x")))
    sizes = kept.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return kept.where(F.size("x") == (sizes[0].size if sizes else 0))


def _matrix(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows' blocks of part(block), a matrix of this shape; a task adds up its own blocks, Spark those of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += part(_matrix(batch, 0, size))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "row"])

    parts = rows.select("x").mapInArrow(run, "at int, row array<double>")
    sums = parts.groupBy("at").agg(F.array(*[F.sum(F.col("row")[k]) for k in range(shape[1])]).alias("row")).collect()
    out = np.zeros(shape)
    for r in sums:
        out[r["at"]] = r["row"]
    return out


def exact_sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of each dimension: entries are added in two halves, which can't overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch, 0, size)
                columns = [np.arange(size, dtype=np.int32), np.full(size, len(x)), (x >> 31).sum(axis=0), (x & (2**31 - 1)).sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "n", "high", "low"])

    parts = rows.select("x").mapInArrow(run, "at int, n long, high long, low long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    cells = {r["at"]: r for r in parts.groupBy("at").agg(exact("n"), exact("high"), exact("low")).collect()}
    return (int(cells[0].n), [(int(cells[k].high) << 31) + int(cells[k].low) for k in range(size)]) if cells else (0, [])


def fit(rows: DataFrame, *, components: int = COMPONENTS) -> Fit | None:
    """Components of rows as from whole_vectors(); None without rows."""
    head = rows.select(F.size("x").alias("size")).first()
    if head is None:
        return None
    size = head.size
    n, sums = exact_sums(rows, size)
    mean = np.array([s / n for s in sums])  # whole numbers divide to the nearest double

    def product(w: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return y.T @ (y @ w)

        return _added(rows, part, size, w.shape) / n

    trace = float(_added(rows, lambda x: np.square(x - mean).sum(axis=0)[:, None], size, (size, 1)).sum()) / n
    found = eigenpairs(product, size, components)
    # Of both directions that in which the largest entry is positive.
    lead = found.vectors[np.abs(found.vectors).argmax(axis=0), np.arange(found.vectors.shape[1])]
    return Fit(n, sums, found._replace(vectors=found.vectors * np.where(lead < 0, -1.0, 1.0)), trace)


def _projection(model: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the matrix that whitens what is centred; components without variance are zeros in it."""
    values = model.found.values
    real = values > 1e-12 * max(values.max(initial=0.0), 0.0)
    return np.array([s / model.n for s in model.sums]), np.where(real, model.found.vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)


def identity_error(rows: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, over components with variance."""
    mean, turn = _projection(model)
    k = turn.shape[1]

    def part(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _added(rows, part, len(mean), (k + 1, k)) / model.n
    covariance = total[:k] - np.outer(total[k], total[k])
    real = np.flatnonzero(np.abs(turn).sum(axis=0) > 0)
    return float(np.abs(covariance[np.ix_(real, real)] - np.eye(len(real))).max(initial=0.0))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 per row, exact; None beyond 38 digits."""
    floors = [s // n for s in sums]
    near = x - np.array(floors)
    rest = [s - n * f for s, f in zip(sums, floors, strict=True)]
    most = n * (int(np.abs(near).max(initial=0)) + 1)
    kind = np.int64 if most * most * len(sums) < 1 << 63 else object
    z = near.astype(kind) * n - np.array(rest, kind)
    return [int(v) if int(v) < 10**38 else None for v in (z * z).sum(axis=1)]


def whitened(rows: DataFrame, model: Fit) -> DataFrame:
    """(vec, component, deviation decimal(38,0), whitened) of every row of whole_vectors() and every component."""
    vec = rows.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turn = _projection(model)
        k = turn.shape[1]
        for batch in batches:
            if len(batch):
                x = _matrix(batch, 1, len(mean))
                row = pa.array(np.repeat(np.arange(len(x)), k))
                far = pa.array(_deviations(x, model.n, model.sums), pa.decimal128(38, 0))
                columns = [batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), far.take(row), pa.array(((x - mean) @ turn).ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec", "component", "deviation", "whitened"])

    return rows.select("vec", "x").mapInArrow(run, f"vec {vec}, component int, deviation decimal(38,0), whitened double")


def whiten(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec, component, n, deviation, whitened, explained, identity_error) of every sound vector and component.

    There are as many components as dimensions at most. One without variance
    (all rows alike in it) is whitened to 0. Repeated rows count each, null ids
    stay, other columns are not looked at; without sound vectors there are no
    rows. See whole_vectors() for what is left out.
    """
    rows = whole_vectors(vectors, vec_id, vector)
    model = fit(rows, components=components)
    if model is None:
        kind = rows.schema["vec"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    share = [float(v) / model.trace if model.trace else 0.0 for v in model.found.values]
    explained = F.element_at(F.array(*map(F.lit, share)), F.col("component"))
    return whitened(rows, model).select("vec", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(identity_error(rows, model)).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings; a deviation that a long can't hold is null (the operator has it as a decimal)."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("vec").alias("vec_id"), "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")
