"""Nearest neighbours by collision-counting hashing.

A vector's hash is its projection on one random direction. The index deals the distinct vectors to blocks of bounded size;
a block keeps, for every direction, its vectors in the order of their projections. A query opens a window around its own
projection in each sorted array and widens all windows together (virtual rehashing), so that no hash is ever computed
again: only the vectors that newly enter a window are counted. A vector that lies in ``THRESHOLD`` of the windows is
verified by its cosine. Windows stop growing when they reach as far as the last of the nearest found.

For unit vectors at distance r, a projection differs by a normal variable of deviation r. Windows of half-width
``WINDOW * R`` hold a vector at distance R with the chance p = P(|N| <= WINDOW) each, so the number of its collisions is
binomial, and the threshold ``SURE`` deviations below ``DIRECTIONS * p`` misses it with a chance of 2 %, nearer ones with
less.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

DIRECTIONS = 128
#: Half-width of a window, in units of the radius it serves.
WINDOW = 1.0
#: Deviations of the number of collisions that the threshold lies below its mean.
SURE = 2.0
CHANCE = erf(WINDOW / sqrt(2))
THRESHOLD = floor(DIRECTIONS * CHANCE - SURE * sqrt(DIRECTIONS * CHANCE * (1 - CHANCE)))
#: The first radius, and how much one widening adds.
FIRST, WIDER = 0.125, 1.4
#: Distinct vectors in a block, and least number of blocks an index is worth cutting a small table into.
BLOCK, PARTS = 16384, 16
SEED = 12


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows in double precision, shorter ones filled up with zeros, which changes no cosine; every row is scaled by
    a power of two, which changes no bit of a cosine, so that squares neither overflow nor vanish."""
    lengths = column.value_lengths().to_numpy()
    raw = np.zeros((len(column), width))
    raw[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])


def _norms(raw: np.ndarray) -> np.ndarray:
    return np.sqrt((raw * raw).sum(axis=1))


class Block:
    """Sorted projections of some vectors."""

    def __init__(self, raw: np.ndarray, directions: np.ndarray):
        self.raw, self.norms = raw, _norms(raw)
        spots = (raw / self.norms[:, None] @ directions).T
        self.order = np.argsort(spots, axis=1).astype(np.int32)
        # one array for all directions: projections lie within +- reach, so each direction gets a stretch of its own
        self.reach = 4 * (np.abs(directions) ** 2).sum(axis=0).max() ** 0.5 + 4
        self.base = 2 * self.reach * np.arange(len(spots))
        self.sorted = (np.take_along_axis(spots, self.order, axis=1) + self.base[:, None]).ravel()
        self.flat = self.order.ravel()
        self.ends = len(raw) * np.arange(len(spots))

    def edges(self, at: np.ndarray, side: str) -> np.ndarray:
        """Where the places ``at``, one a direction, fall in the sorted arrays; within the array of their own."""
        return np.clip(np.searchsorted(self.sorted, np.clip(at, -self.reach, self.reach) + self.base, side), self.ends, self.ends + len(self.raw))

    def search(self, query: np.ndarray, norm: float, spots: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the ``want`` nearest found, and of all that tie with the last."""
        size = len(self.raw)
        counts, seen = np.zeros(size, np.int64), np.zeros(size, bool)
        places, scores = np.empty(0, np.int64), np.empty(0)
        low = high = self.edges(spots, "left")
        radius = FIRST
        while True:
            new_low, new_high = self.edges(spots - WINDOW * radius, "left"), self.edges(spots + WINDOW * radius, "right")
            entered = [self.flat[a:b] for a, b in zip(new_low, low, strict=True) if a < b] + [self.flat[a:b] for a, b in zip(high, new_high, strict=True) if a < b]
            low, high = np.minimum(low, new_low), np.maximum(high, new_high)
            if entered:
                counts += np.bincount(np.concatenate(entered), minlength=size)
            fresh = np.flatnonzero((counts >= THRESHOLD) & ~seen) if radius < 2 else np.flatnonzero(~seen)
            seen[fresh] = True
            if len(fresh):
                places = np.concatenate((places, fresh))
                scores = np.concatenate((scores, (self.raw[fresh] * query).sum(axis=1) / (self.norms[fresh] * norm)))
                if len(scores) > want:
                    kept = scores >= np.partition(scores, -want)[-want]
                    places, scores = places[kept], scores[kept]
            last = sqrt(max(0.0, 2 - 2 * scores.min())) if len(scores) >= want else 2.0
            if radius >= last:
                return places, scores
            radius = min(radius * WIDER, max(last, FIRST))


def _search(batches: Iterator[pa.RecordBatch], width: int, want: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, a block's vectors before the queries: each query's nearest of each block."""
    directions = np.random.default_rng(SEED).standard_normal((width, DIRECTIONS))
    current, ids, vectors, block = None, [], [], None
    for batch in batches:
        numbers, kinds = (batch.column(c).to_numpy() for c in ("block", "kind"))
        cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if numbers[a] != current:
                current, ids, vectors, block = numbers[a], [], [], None
            raw = _matrix(part.column("vector"), width)
            if kinds[a] == 0:
                ids.append(part.column("ids"))
                vectors.append(raw)
                continue
            if not vectors:
                continue  # no vector was dealt to this block
            if block is None:
                block, ids = Block(np.concatenate(vectors), directions), pa.chunked_array(ids)
                vectors = [block.raw]
            norms = _norms(raw)
            spots = raw / norms[:, None] @ directions
            found = [block.search(raw[i], norms[i], spots[i], want) for i in range(len(raw))]
            times = pa.array(np.repeat(np.arange(len(found)), [len(p) for p, _ in found]))
            yield pa.RecordBatch.from_arrays(
                [part.column("one").take(times), part.column("two").take(times), ids.take(pa.array(np.concatenate([p for p, _ in found]))).combine_chunks(), pa.array(np.concatenate([s for _, s in found]))],
                ["one", "two", "ids", "score"],
            )


def nearest_vectors(vectors: DataFrame, nearest: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``nearest`` candidates found by cosine, ties to the smaller id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows of another vec_id. Rows without
    vec_id and vectors that are null, empty, zero or hold a null or non-finite component take no part. Vectors of different
    length compare as if the shorter were filled up with zeros. Equal vectors are searched for, and found, as one, and
    count by their ids, so that a vector of any number of copies costs as much as another. Rows that repeat count once;
    an id with several vectors is found, and asks, with each. With fewer candidates than ``nearest``, all are returned. An
    empty table, or one without queries, gives no rows; other columns are not read.
    """
    spark, want = vectors.sparkSession, nearest + 1
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.xxhash64("embedding").alias("one"), F.xxhash64(F.lit(7), "embedding").alias("two")).where(
        "vec_id IS NOT NULL AND vector IS NOT NULL AND forall(vector, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity')) AND exists(vector, c -> c <> 0)"
    )
    # the least ids of every distinct vector: no query can be given more of them
    place = F.row_number().over(Window.partitionBy("one", "two").orderBy("vec_id"))
    least = sound.dropDuplicates(["one", "two", "vec_id"]).withColumn("place", place).where(F.col("place") <= want)
    distinct = materialise(least.groupBy("one", "two").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("vector", "vec_id").alias("vector")), "searched-vectors")
    asked = materialise(sound.where(F.col("vec_id") % every == 0).select("vec_id", "one", "two", "vector").dropDuplicates(["one", "two", "vec_id"]), "queries")
    size = distinct.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not size["n"]:
        return spark.createDataFrame([], schema)
    blocks, width = max(ceil(size["n"] / BLOCK), min(PARTS, ceil(size["n"] / 1024))), size["width"]
    queries = asked.dropDuplicates(["one", "two"]).select("one", "two", "vector")
    dealt = distinct.select(F.pmod("one", F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "one", "two", "ids", "vector").unionByName(
        queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "one", "two", F.lit(None).cast("array<long>").alias("ids"), "vector")
    )
    found = dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind").mapInArrow(lambda b: _search(b, width, want), "one long, two long, ids array<long>, score double")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("one", "two").orderBy(F.desc("score"), F.col("ids")[0]))).where(F.col("place") <= want)
    answers = best.groupBy("one", "two").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    candidates = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct((-f["score"]).alias("less"), i.alias("id")))))
    rows = asked.select("vec_id", "one", "two").join(answers, ["one", "two"]).select(F.col("vec_id").alias("query_id"), F.filter(candidates, lambda c: c["id"] != F.col("vec_id")).alias("c"))
    ranked = rows.select("query_id", F.posexplode(F.slice(F.array_sort("c"), 1, nearest)).alias("at", "c"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("c.id").alias("vec_id"), (-F.col("c.less")).alias("score"))

