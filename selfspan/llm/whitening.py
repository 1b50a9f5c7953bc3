"""Whitening of embeddings by spectral divide and conquer.

Components of the covariance come from QDWH: the polar factor U of the covariance less a shift is, by dynamically weighted
Halley steps, a matrix whose eigenvalues are +1 above the shift and -1 below it, and (I + U) / 2 projects on the invariant
subspace above. Bases of both subspaces split the matrix in two blocks without coupling, each of which is split again,
until a block is one eigenvalue. Branches below the wanted components are never entered.

Spark does what grows with the rows: the distinct fit vectors, exact sums, centred products, whitening. Only the
width x width covariance reaches the driver, and components x width numbers go back with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Widest vectors whose covariance is gathered on the driver: 2048 * 2049 / 2 numbers.
WIDEST = 2048
EPS = float(np.finfo(float).eps)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix, by QDWH steps: through a QR factorisation while the weights are large,
    through a Cholesky factorisation after that. Six steps reach full precision from a condition of 1e16."""
    n = len(a)
    x, low, eye = a / np.linalg.norm(a), EPS / 2, np.eye(n)
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack((np.sqrt(wc) * x, eye)))[0]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            inverse = np.linalg.inv(np.linalg.cholesky(eye + wc * (x.T @ x)))
            new = wb / wc * x + (wa - wb / wc) * (x @ inverse.T @ inverse)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        if 1 - low < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, int]:
    """(orthogonal basis, r): the first r columns span the invariant subspace above a shift, the others the one below.

    The mean of the eigenvalues always lies between the outermost two; shifts that meet an eigenvalue leave coupling
    between the blocks, and the next one is tried.
    """
    n, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    start = np.random.default_rng(n).standard_normal((n, n))
    best = None
    for shift in (np.median(np.diag(a)), mean, *(mean + spread * s for s in (0.13, -0.13, 0.29, -0.29, 0.047, -0.047, 0.011, -0.011))):
        shifted = a - shift * np.eye(n)
        if not shifted.any():
            continue
        projector = (polar_factor(shifted) + np.eye(n)) / 2
        r = int(round(np.trace(projector)))
        if not 0 < r < n:
            continue
        basis = start
        for _ in range(2):
            basis = np.linalg.qr(np.hstack((projector @ basis[:, :r], basis[:, r:] - projector @ basis[:, r:])))[0]
        coupling = np.linalg.norm(basis[:, r:].T @ a @ basis[:, :r])
        if best is None or coupling < best[0]:
            best = (coupling, basis, r)
        if coupling <= 8 * n * EPS * np.linalg.norm(shifted):
            break
    if best is None:
        raise ArithmeticError("no shift splits the matrix")
    return best[1], best[2]


def leading_components(a: np.ndarray, count: int, noise: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of a symmetric matrix, the ``count`` largest. Eigenvalues closer than
    rounding can tell share a block whose basis is as good as any."""
    n = len(a)
    noise = len(a) * EPS * np.linalg.norm(a) if noise is None else noise
    mean = np.trace(a) / n
    if n == 1 or np.linalg.norm(a - mean * np.eye(n)) <= noise:
        return np.diag(a)[:count].copy(), np.eye(n)[:, :count]
    basis, r = split(a)
    values, vectors = [], []
    for part in (basis[:, :r], basis[:, r:]):
        wanted = count - sum(len(v) for v in values)
        if wanted > 0:
            block = part.T @ a @ part
            e, v = leading_components((block + block.T) / 2, wanted, noise)
            values.append(e)
            vectors.append(part @ v)
    e, v = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


def _matrix(column: pa.Array, dtype=np.int64) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Partial sums by dimension as high and low halves of 32 bits, which cannot overflow; the count in the last row."""
    high, low, n = np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64), 0
    for batch in batches:
        x = _matrix(batch.column("x"))
        high[:width] += (x >> 32).sum(axis=0)
        low[:width] += (x & 0xFFFFFFFF).sum(axis=0)
        n += len(x)
    low[width] = n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(high), pa.array(low)], ["at", "high", "low"])


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(number of vectors, sum of every dimension), exact."""
    parts = fit.mapInArrow(lambda b: _sums(b, width), "at long, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).toArrow().to_pylist()
    sums = [0] * (width + 1)
    for row in parts:
        sums[row["at"]] = (row["high"] << 32) + row["low"]
    return sums[width], sums[:width]


def _products(batches: Iterator[pa.RecordBatch], mean: np.ndarray, project: np.ndarray | None, centre: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Partial sums of products of centred vectors, and of the vectors, as one row an entry: the upper triangle by rows,
    then the sums."""
    width = len(mean) if project is None else project.shape[1]
    total, sums = np.zeros((width, width)), np.zeros(width)
    for batch in batches:
        x = _matrix(batch.column("x")) - mean
        if project is not None:
            x = x @ project
        if centre is not None:
            x = x - centre
        total += x.T @ x
        sums += x.sum(axis=0)
    entries = np.concatenate((total[np.triu_indices(width)], sums))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(entries))), pa.array(entries)], ["at", "v"])


def centred_products(fit: DataFrame, n: int, mean: np.ndarray, project: np.ndarray | None = None, centre: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(products, sums) over n vectors x of ``fit``, both divided by n, of x - mean, or of its projection less ``centre``."""
    width = len(mean) if project is None else project.shape[1]
    rows = fit.mapInArrow(lambda b: _products(b, mean, project, centre), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    entries = np.zeros(width * (width + 1) // 2 + width)
    entries[rows.column("at").to_numpy()] = rows.column("v").to_numpy()
    upper = np.zeros((width, width))
    upper[np.triu_indices(width)] = entries[:-width] / n
    return upper + np.triu(upper, 1).T, entries[-width:] / n


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n * x - S)^2 by row, exact; null where it does not fit a long."""
    reach = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(abs(s) for s in sums)
    if reach * reach * x.shape[1] < 1 << 63:
        gap = n * x - np.array(sums, np.int64)
        return pa.array((gap * gap).sum(axis=1))
    gap = n * x.astype(object) - np.array(sums, object)
    return pa.array([v if v < 1 << 63 else None for v in (gap * gap).sum(axis=1)], pa.int64())


def _whiten(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], mean: np.ndarray, project: np.ndarray, explained: np.ndarray, error: float) -> Iterator[pa.RecordBatch]:
    k = project.shape[1]
    for batch in batches:
        rows = batch.num_rows
        if rows:
            x = _matrix(batch.column("x"))
            at = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(at),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    _deviation(x, n, sums).take(at),
                    pa.array(((x - mean) @ project).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """One row per sound vector and leading component: vec_id, component, n, deviation, whitened, explained, identity_error.

    A vector's entries become whole numbers, floor(scale * entry). The fit list is every distinct vector of these once: n
    of them, with sums S. ``whitened`` is (x - S / n) on the component over the root of its eigenvalue.

    Rows whose vector is null or holds null or non-finite entries are dropped. Shorter vectors count as filled up with
    zeros. A null vec_id stays null and repeated rows are returned as often as they come; they are one vector of the fit
    list. Components whose eigenvalue is zero but for rounding cannot be whitened and are left out, so that one vector
    alone, or vectors that are all equal, give no rows; so does an empty table. Equal eigenvalues have any basis of their
    subspace. ``deviation`` is null where it does not fit a long. Vectors wider than ``WIDEST`` are an error. Other columns
    are not read.
    """
    spark = vectors.sparkSession
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where("v IS NOT NULL AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    width = sound.agg(F.max(F.size("v"))).first()[0] or 0
    if width > WIDEST:
        raise ValueError(f"vectors of {width} entries: the covariance of more than {WIDEST} is not gathered")
    if width == 0:
        return spark.createDataFrame([], SCHEMA)
    whole = F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = sound.select("vec_id", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))).alias("x"))
    fit = materialise(rows.select("x").distinct(), "fit-vectors")
    n, sums = exact_sums(fit, width)
    mean = np.array([s / n for s in sums])
    covariance = centred_products(fit, n, mean)[0]
    trace = float(np.trace(covariance))
    if trace <= 0:
        return spark.createDataFrame([], SCHEMA)
    values, basis = leading_components(covariance, min(components, width))
    real = values > width * EPS * trace
    values, basis = values[real], basis[:, real]
    project = basis / np.sqrt(values)
    centre = centred_products(fit, n, mean, project)[1]
    error = float(np.abs(centred_products(fit, n, mean, project, centre)[0] - np.eye(len(values))).max())
    explained = values / trace
    return rows.mapInArrow(lambda b: _whiten(b, n, sums, mean, project, explained, error), SCHEMA)
