"""Blocks of rows against all rows as a stream, without a shuffle.

Rows are packed in blocks. A task holds some blocks; each of them meets all blocks of the others one after another, read from
their files by every task. So what is written to disk is as large as the rows, and memory depends on the size of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import truncate

#: Rows of a file of blocks, about: every task opens all files.
FILE = 1 << 16


def numbers(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """The arrays of a batch, which are all of one length, as rows."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def raw(a: np.ndarray, kind: type | None = float) -> pa.Array:
    """A binary column of one row, of numbers of a kind or of the array's own."""
    return pa.array([np.ascontiguousarray(a, kind).tobytes()], pa.binary())


def array(row: dict, name: str, kind: type = float) -> np.ndarray:
    return np.frombuffer(row[name].as_buffer(), kind)


def _packed(batches: Iterator[pa.RecordBatch], size: int, names: list[str], change) -> Iterator[pa.RecordBatch]:
    made, task = 0, TaskContext.get().partitionId()
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            ids = part.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            vectors = [numbers(part, c)[order] for c in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array([made == 0]), pa.array([f"{task}/{made}"]), raw(ids[order], np.int64), *(raw(change(v), None) for v in vectors)], ["lead", "part", "ids", *names])
            made += 1


def _blocks(data: DataFrame, size: int, change) -> DataFrame:
    names = data.columns[1:]
    schema = "lead boolean, part string, ids binary, " + ", ".join(f"{c} binary" for c in names)
    return truncate(data.mapInArrow(lambda b: _packed(b, size, names, change), schema))


def blocks(data: DataFrame, n: int, size: int, change=lambda x: x) -> DataFrame:
    """(lead, ids, and a binary of each further column) of ``data`` (id, arrays of doubles or longs) of ``n`` rows: blocks of ``size``
    rows by id, written in few files; ``lead`` marks the first block of a file."""
    return _blocks(data.coalesce(-(-n // FILE)), size, change).drop("part")


def own_blocks(data: DataFrame, n: int, size: int, change=lambda x: x) -> DataFrame:
    """(part, ids, and a binary of each further column) of ``data``, for the other side: in tasks for all cores, of some blocks each."""
    return _blocks(data.repartition(parts(data, n, size)), size, change).drop("lead")


def parts(data: DataFrame, n: int, size: int) -> int:
    return max(1, min(-(-n // size), max(2 * data.sparkSession.sparkContext.defaultParallelism, -(-n // (8 * size)))))


def against_all(own: DataFrame, others: DataFrame) -> DataFrame:
    """Every row of ``own`` with all rows of ``others`` (blocks, their columns after an underscore), one after another in one task.
    The columns of ``own`` come with the first of them, and again with further leads; they are null with the rest."""
    met = others.coalesce(1)
    pairs = own.hint("shuffle_replicate_nl").crossJoin(met.select(*[F.col(c).alias(f"_{c}") for c in met.columns]))
    return pairs.select(*[F.when(F.col("_lead"), F.col(c)).alias(c) for c in own.columns], *[f"_{c}" for c in met.columns if c != "lead"])


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict | None]]:
    """(others' row, own row where another one begins) of what ``against_all`` makes; own rows are told apart by ``part``."""
    part = None
    for batch in batches:
        names = batch.schema.names
        for k in range(batch.num_rows):
            row = {c: batch.column(i)[k] for i, c in enumerate(names)}
            begins = row["part"].is_valid and row["part"].as_py() != part
            if begins:
                part = row["part"].as_py()
            yield {c[1:]: v for c, v in row.items() if c[0] == "_"}, {c: v for c, v in row.items() if c[0] != "_"} if begins else None
