"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors of cosine ``least`` or more lie within ``epsilon`` = sqrt(2 - 2 * least) of each other. Vectors are sorted by
label and by the cells, ``epsilon`` wide, of their projections on the leading principal directions; the sorted sequence
is cut into blocks. A projection never lengthens a distance, so blocks whose bounding boxes are further apart than
``epsilon`` cannot hold a link and are never paired. The other pairs are joined recursively: both intervals are halved
while their boxes stay close, and at the leaves cosines are computed in double precision.

Equal vectors of one label collapse to one row with a count before all that. A task returns how many links each vector
has and a spanning forest of the links, never the pairs, so a dense group of any size costs rows in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise

LEAST = 0.98
#: Leading principal directions that the grid is laid on.
DIRECTIONS = 6
#: Vectors in a block, and in a leaf of the recursion.
BLOCK = 1024
LEAF = 64
#: Blocks that one more leading cell is worth, in the key by which blocks meet.
CELLS = 64
#: Widest vectors whose covariance (width x width) is gathered; beyond it the grid lies on the first coordinates.
WIDEST = 1024


def _units(rows: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, vectors as they are), shorter ones filled up with zeros, which changes no length or product."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    lengths = rows.value_lengths().to_numpy()
    raw = np.zeros((len(rows), width))
    raw[np.arange(width) < lengths[:, None]] = rows.flatten().to_numpy(zero_copy_only=False)
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), raw


def _moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of the unit vectors' second moments, one row an entry."""
    total = np.zeros((width, width))
    for batch in batches:
        if batch.num_rows:
            u, _ = _units(batch.column("vector"), width)
            total += u.T @ u
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "x"])


def principal_directions(vectors: DataFrame, width: int, count: int) -> np.ndarray:
    """``count`` orthonormal columns; only width x width sums reach the driver."""
    if width > WIDEST:
        return np.eye(width)[:, :count]
    sums = vectors.select("vector").mapInArrow(lambda b: _moments(b, width), "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
    square = np.zeros(width * width)
    for row in sums.collect():
        square[row["at"]] = row["x"]
    return np.linalg.eigh(square.reshape(width, width))[1][:, ::-1][:, :count]


def _project(batches: Iterator[pa.RecordBatch], basis: np.ndarray, epsilon: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            p = _units(batch.column("vector"), basis.shape[0])[0] @ basis
            cells = np.floor(p / epsilon).astype(np.int64)
            extra = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(t)) for x, t in ((cells, pa.int64()), (p, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("id", "label", "copies", "vector")] + extra, ["id", "label", "copies", "vector", "cells", "spots"])


def _cut(batches: Iterator[pa.RecordBatch], block: int, width: int) -> Iterator[pa.RecordBatch]:
    """Consecutive vectors of one label as one row: ids, copies, vectors and projections as arrays, and the bounding box."""
    held = None

    def rows(table: pa.Table, end: bool) -> tuple[list, pa.Table]:
        labels = table.column("label").to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(labels[1:] != labels[:-1]) + 1, [len(labels)]))
        out, at = [], 0
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            whole = end or b < len(labels)
            for x in range(a, b, block):
                if x + block <= b or whole:
                    out.append((x, min(x + block, b)))
                    at = min(x + block, b)
        return out, table.slice(at)

    def emit(table: pa.Table, spans: list) -> Iterator[pa.RecordBatch]:
        for x, y in spans:
            part = table.slice(x, y - x).combine_chunks()
            spots = np.stack(part.column("spots").to_pylist())
            first = part.column("id")[0].as_py()
            yield pa.RecordBatch.from_pydict(
                {
                    "label": pa.array([part.column("label")[0].as_py()], pa.int64()),
                    "block": pa.array([first], pa.int64()),
                    "ids": pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                    "copies": pa.array([part.column("copies").to_pylist()], pa.list_(pa.int64())),
                    "raw": pa.array([_units(part.column("vector"), width)[1].tobytes()], pa.binary()),
                    "spots": pa.array([spots.tobytes()], pa.binary()),
                    "low": pa.array([spots.min(axis=0).tolist()], pa.list_(pa.float64())),
                    "high": pa.array([spots.max(axis=0).tolist()], pa.list_(pa.float64())),
                }
            )

    for batch in batches:
        if batch.num_rows:
            part = pa.Table.from_batches([batch])
            table = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            spans, held = rows(table, False)
            yield from emit(table, spans)
    if held is not None and held.num_rows:
        yield from emit(held, rows(held, True)[0])


_BLOCK = "label long, block long, ids array<long>, copies array<long>, raw binary, spots binary, low array<double>, high array<double>"


def _span(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index each of 0..n-1 reaches over the edges (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _join(left: dict, right: dict, least: float, epsilon: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the links between two intervals of the order, by recursive halving."""
    found_i, found_j = [], []
    slack = epsilon * (1 + 1e-9) + 1e-12

    def boxes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return p.min(axis=0), p.max(axis=0)

    def go(a: int, b: int, c: int, d: int) -> None:
        if same and c < a:
            return  # the mirror image of a pair that is joined already
        (la, ha), (lc, hc) = boxes(left["spots"][a:b]), boxes(right["spots"][c:d])
        gap = np.maximum(0, np.maximum(la - hc, lc - ha))
        if (gap * gap).sum() > slack * slack:
            return
        if b - a <= LEAF and d - c <= LEAF:
            cos = (left["raw"][a:b] @ right["raw"][c:d].T) / (left["norm"][a:b, None] * right["norm"][None, c:d])
            i, j = np.nonzero(cos >= least)
            keep = (i + a < j + c) if same else np.ones(len(i), bool)
            found_i.append(i[keep] + a)
            found_j.append(j[keep] + c)
            return
        if same and a == c:
            m = (a + b) // 2
            go(a, m, a, m)
            go(a, m, m, b)
            go(m, b, m, b)
        elif b - a >= d - c:
            go(a, (a + b) // 2, c, d)
            go((a + b) // 2, b, c, d)
        else:
            go(a, b, c, (c + d) // 2)
            go(a, b, (c + d) // 2, d)

    go(0, len(left["ids"]), 0, len(right["ids"]))
    return np.concatenate(found_i or [np.empty(0, int)]), np.concatenate(found_j or [np.empty(0, int)])


def _side(row: dict, name: str) -> dict:
    ids = np.array(row[f"ids_{name}"])
    raw = np.frombuffer(row[f"raw_{name}"], np.float64).reshape(len(ids), -1)
    scale = np.abs(raw).max(axis=1, keepdims=True)
    if ((scale > 1e100) | (scale < 1e-100)).any():
        raw = raw / scale
    return {"ids": ids, "copies": np.array(row[f"copies_{name}"]), "raw": raw, "norm": np.sqrt((raw * raw).sum(axis=1)), "spots": np.frombuffer(row[f"spots_{name}"], np.float64).reshape(len(ids), -1)}


def _links(batches: Iterator[pa.RecordBatch], least: float, epsilon: float) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks: (a, null, links of a) and the forest's edges (a, b, null)."""
    for batch in batches:
        for row in batch.to_pylist():
            same = row["block_a"] == row["block_b"]
            left = _side(row, "a")
            right = left if same else _side(row, "b")
            i, j = _join(left, right, least, epsilon, same)
            if not len(i):
                continue
            at = 0 if same else len(left["ids"])
            ids = left["ids"] if same else np.concatenate((left["ids"], right["ids"]))
            copies = left["copies"] if same else np.concatenate((left["copies"], right["copies"]))
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, i, copies[j + at])
            np.add.at(links, j + at, copies[i])
            root = _span(len(ids), i, j + at)
            linked, member = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
            n, m = len(linked), len(member)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((ids[linked], ids[member])), pa.int64()),
                    pa.array(np.concatenate((np.zeros(n, np.int64), ids[root[member]])), pa.int64(), mask=np.arange(n + m) < n),
                    pa.array(np.concatenate((links[linked], np.zeros(m, np.int64))), pa.int64(), mask=np.arange(n + m) >= n),
                ],
                ["a", "b", "n"],
            )


def _within(distinct: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b, n) of the links among distinct vectors of equal labels; ``width``: of the widest."""
    epsilon = sqrt(2 - 2 * least)
    basis = principal_directions(distinct, width, min(DIRECTIONS, width))
    kind = dict(distinct.dtypes)["vector"]
    spots = distinct.mapInArrow(lambda b: _project(b, basis, epsilon), f"id long, label long, copies long, vector {kind}, cells array<long>, spots array<double>")
    order = ["label", *(F.col("cells")[k] for k in range(basis.shape[1])), "id"]
    blocks = materialise(spots.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _cut(b, BLOCK, width), _BLOCK), "grid-blocks")

    # blocks are matched by label and as many leading cells as tell the blocks apart; of two boxes that share several cells,
    # the first one counts
    keys = min(basis.shape[1], 1 + int(log(max(1, blocks.count()), CELLS)))

    def cells(side: str, wider: int) -> DataFrame:
        out = blocks.select("label", *(F.col(c).alias(f"{c}_{side}") for c in ("block", "low", "high")))
        for k in range(keys):
            at = lambda edge: F.floor(F.col(f"{edge}_{side}")[k] / epsilon)  # noqa: B023, E731
            out = out.withColumn(f"first{k}_{side}", at("low") - wider).withColumn(f"cell{k}", F.explode(F.sequence(at("low") - wider, at("high") + wider)))
        return out

    gap = F.expr("aggregate(sequence(0, size(low_a) - 1), 0D, (s, k) -> s + pow(greatest(0D, low_a[k] - high_b[k], low_b[k] - high_a[k]), 2))")
    pairs = cells("a", 0).join(cells("b", 1), ["label", *(f"cell{k}" for k in range(keys))]).where("block_a <= block_b")
    for k in range(keys):
        pairs = pairs.where(F.col(f"cell{k}") == F.greatest(f"first{k}_a", f"first{k}_b"))
    pairs = pairs.where(gap <= (epsilon * (1 + 1e-9)) ** 2 + 1e-12).select("block_a", "block_b")
    payload = lambda s: blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in ("block", "ids", "copies", "raw", "spots")))
    work = pairs.join(payload("a"), "block_a").join(payload("b"), "block_b").repartition("block_a", "block_b")
    return work.mapInArrow(lambda b: _links(b, least, epsilon), "a long, b long, n long")


def near_duplicate_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal labels link when their cosine is ``least`` or more; vectors of different length do not. A row whose
    label or vector is null, whose vector is empty, zero or holds a null or non-finite component, has no links, is its
    own component and is kept; so is a row without vec_id, whose component_id is null. Repeated rows count as vectors of
    their own. Only ``vec_id``, ``embedding`` and ``label`` are read. An empty table gives no rows.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").alias("vector"),
        F.size("embedding").alias("width"),
        F.xxhash64("embedding").alias("one"),
        F.xxhash64(F.lit(7), "embedding").alias("two"),
    )
    sound = rows.where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND width > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vector, x -> x <> 0)"
    )
    key = ["label", "width", "one", "two"]
    distinct = materialise(sound.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.min_by("vector", "vec_id").alias("vector")), "distinct-vectors")
    widest = distinct.agg(F.max("width")).first()[0]
    if widest is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # label and length together are what must be equal: one number stands for both
    alike = distinct.select("id", F.xxhash64("label", "width").alias("label"), "copies", "vector")
    found = materialise(_within(alike, widest, least), "vector-links")
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    groups = connected_components(found.where("b IS NOT NULL").select("a", "b"), "vector-components")
    classes = distinct.select(*key, "id", "copies").join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    placed = classes.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    return rows.select("vec_id", *key, F.col("vec_id").isNotNull().alias("known")).join(placed.withColumn("known", F.lit(True)), [*key, "known"], "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
