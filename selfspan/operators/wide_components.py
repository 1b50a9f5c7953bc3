"""Leading principal components of rows of many features, without a matrix of features by features.

A block of directions is multiplied by the centred Gram matrix in one pass over the rows: tasks sum each row less the mean, times
its products with the block, and return as many numbers as the block has. The images, made orthogonal to all directions so far,
are the next block (block Lanczos); the best combinations of all directions and their residuals come from numbers already
there. After BLOCKS blocks the best directions begin anew. The driver holds features x (BLOCKS x block) numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directions beyond the wanted ones, blocks until the best begin anew, and passes at most.
GUARD = 8
BLOCKS = 10
PASSES = 80
#: Features of a piece of the sums, and numbers of a slice of rows that a task multiplies at once.
PIECE = 512
SLICE = 1 << 22


def slices(batch: pa.RecordBatch, width: int, column: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of parts of a batch."""
    step = max(1, SLICE // width)
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield at, part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, width)


def spread(entries: DataFrame, id_col: str, width: int) -> DataFrame:
    """(id, features) of ``width`` doubles from (id, at, value); places without an entry are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SLICE // width)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                made, places = np.zeros((part.num_rows, width)), part.column(1)
                made[np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy()), places.flatten().to_numpy()] = part.column(2).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(made), pa.list_(pa.float64()))], [id_col, "features"])

    lists = entries.groupBy(id_col).agg(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), F.col("value").cast("double").alias("value"))).alias("e"))
    kind = entries.schema[id_col].dataType.simpleString()
    return lists.select(id_col, "e.at", "e.value").mapInArrow(run, f"{id_col} {kind}, features array<double>")


def _images(batches: Iterator[pa.RecordBatch], mean: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's sums in pieces of features: of centred rows times their products with the block, and of the rows themselves."""
    total = np.zeros((len(mean), block.shape[1] + 1))
    for batch in batches:
        for _, x in slices(batch, len(mean)):
            x -= mean
            total += x.T @ np.hstack((x @ block, np.ones((len(x), 1))))
    pieces = [np.ascontiguousarray(total[at : at + PIECE]).tobytes() for at in range(0, len(total), PIECE)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces))), pa.array(pieces, pa.binary())], ["piece", "sums"])


def _added(key: tuple, parts: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v.as_py()) for v in parts.column("sums")], axis=0)
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["piece", "sums"])


def _squares(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = 0.0
    for batch in batches:
        for _, x in slices(batch, len(mean)):
            x -= mean
            total += float(np.vdot(x, x))
    yield pa.RecordBatch.from_arrays([pa.array([total])], ["s"])


def _orthogonal(block: np.ndarray, basis: np.ndarray, scale: float) -> np.ndarray:
    """The block less its parts in the basis, twice for the digits, as unit directions; those that vanish are left out."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    block = u[:, s > 1e-12 * scale]
    block = block - basis @ (basis.T @ block)
    return np.linalg.qr(block)[0] if block.shape[1] else block


def leading(data: DataFrame, n: int, mean: np.ndarray, k: int, tol: float = 1e-9, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """(values falling, directions as columns, sum of all values) of the k greatest values of the centred Gram matrix of the
    one column of ``data``; fewer where the rows span fewer. Ends when the residuals are within ``tol`` of the largest value, and
    raises after PASSES."""
    context, d = data.sparkSession.sparkContext, len(mean)
    total = float(data.mapInArrow(lambda b: _squares(b, mean), "s double").agg(F.sum("s")).first()[0] or 0.0)
    if total <= 1e-28 * n * float(mean @ mean):  # equal rows, but for rounding
        return np.zeros(0), np.zeros((d, 0)), 0.0
    size = min(k + GUARD, d)

    def image(block: np.ndarray) -> np.ndarray:
        shared = context.broadcast((mean, block))  # features x (block + 1) numbers
        made = data.mapInArrow(lambda b: _images(b, *shared.value), "piece long, sums binary").groupBy("piece").applyInArrow(_added, "piece long, sums binary").toArrow().sort_by("piece")
        sums = np.concatenate([np.frombuffer(v.as_py()).reshape(-1, block.shape[1] + 1) for v in made.column("sums")])
        return sums[:, :-1] - np.outer(sums[:, -1], sums[:, -1] @ block) / n  # what rounding left of the mean

    new = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, size)))[0]
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(PASSES):
        made = image(new)
        basis, images = np.hstack((basis, new)), np.hstack((images, made))
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-values)[:size]
        values, turn = values[best], turn[:, best]
        ritz, moved = basis @ turn, images @ turn
        rest = np.linalg.norm(moved - ritz * values, axis=0)[:k]
        top = max(values[0], 0.0)
        new = _orthogonal(made, basis, top)
        if not total or rest.max() <= tol * top or not new.shape[1]:
            kept = values[:k] > 1e-13 * top
            return np.maximum(values[:k][kept], 0), ritz[:, :k][:, kept], total
        if basis.shape[1] > (BLOCKS - 1) * size:
            basis, images = ritz, moved
            new = _orthogonal(moved - ritz * values, basis, top)
    raise ArithmeticError(f"directions not within {tol} after {PASSES} passes: {rest.max() / top:.3g}")
