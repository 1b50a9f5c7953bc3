"""What several corpus operators share: intermediate tables, hashing of byte strings, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Odd multiplier of the polynomial hash modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where none is named, a temporary one serves a
    local session; a cluster has no folder of the driver's, so there it is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write if codec is None else df.write.option("compression", codec)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table in one file, about, and files at least.
ROWS_PER_FILE, LEAST_FILES = 1 << 16, 12


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` narrow rows, in no more partitions than they need: each is a file when it is written, and a
    local file system without native code starts processes for each file."""
    return df.coalesce(max(LEAST_FILES, -(-rows // ROWS_PER_FILE)))


def text_bytes(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  (kept for the life of the worker)
    """BASE**i and BASE**-i modulo 2^64 for i < n."""
    if cache.get("n", 0) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[0] = down[0] = 1
        k = 1
        while k < size:
            up[k : 2 * k] = up[:k] * np.uint64(pow(BASE, k, 1 << 64))
            down[k : 2 * k] = down[:k] * np.uint64(pow(BASE_INVERSE, k, 1 << 64))
            k *= 2
        cache.update(n=size, up=up, down=down)
    return cache["up"][:n], cache["down"][:n]


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1) + np.uint64(seed << 32))


class RollingHash:
    """Hashes of any substrings of one byte string, from prefix sums of a polynomial modulo 2^64 over random byte codes."""

    def __init__(self, data: np.ndarray, codes: np.ndarray):
        n = len(data)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words in order: maximal runs of bytes other than space and 09-0D, A-Z lower-cased."""
    data = np.frombuffer(text_bytes(text).lower(), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    return mix(RollingHash(data, byte_codes(7)).of(start, end) + (end - start).astype(np.uint64))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``k`` words; of a shorter text, the whole sequence; of none, nothing."""
    n = len(words)
    if n == 0:
        return words
    span = min(k, n)
    out = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[i : n - span + 1 + i])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def map_groups(df: DataFrame, keys: list[str], process: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str, order: list[str] | None = None) -> DataFrame:
    """Run ``process(table, starts)`` on sorted runs of whole groups; ``starts`` holds where each group begins, and the end.
    ``order``: columns that order a group's rows.

    For groups of bounded size, which callers see to: rows are dealt and sorted by the keys, and a task holds one Arrow
    batch and the group that the next batch may continue.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def starts_of(t: pa.Table) -> np.ndarray:
            new = np.zeros(t.num_rows, bool)
            new[:1] = True
            for k in keys:
                values = t.column(k).to_numpy()
                new[1:] |= values[1:] != values[:-1]
            return np.flatnonzero(new)

        for batch in batches:
            part = pa.Table.from_batches([batch])
            table = part if held is None else pa.concat_tables([held, part]).combine_chunks()
            if not table.num_rows:
                continue
            starts = starts_of(table)
            held = table.slice(starts[-1])
            if len(starts) > 1 and (out := process(table.slice(0, starts[-1]), starts)) is not None:
                yield out
        if held is not None and held.num_rows and (out := process(held.combine_chunks(), np.array([0, held.num_rows]))) is not None:
            yield out

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def crc_mod(column: Column | str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``: the fold of a row."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


#: A node is a hub with this share of all edges, and at least so many: there are fewer than 1 / HUB_SHARE hubs.
HUB_SHARE, HUB_EDGES = 1 / 256, 256


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node each node reaches over ``edges`` (a, b).

    Alternating large-star and small-star steps over edges (u, v) with u > v: every node's neighbours are hooked to the
    smallest neighbour, until only stars remain. A node's smallest neighbour is an aggregate with map-side combining,
    and the edges look it up by an equi-join; those at a hub find it in a broadcast table instead, as there are less than
    1 / HUB_SHARE hubs, so no task takes all edges of a node. No adjacency list is gathered. Null nodes and loops are
    dropped; nodes without edges are not returned.
    """
    spark = edges.sparkSession

    def digest(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    def with_least(e: DataFrame, side: str, n: int) -> DataFrame:
        """The edges with ``m``, the smallest neighbour below the node at ``side``, or null where it has none."""
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", side)
        hubs = [r[0] for r in e.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") >= max(HUB_EDGES, n * HUB_SHARE)).select(side).collect()]
        if not hubs:
            return e.join(low, side, "left").select("u", "v", "m")
        of_hubs = spark.createDataFrame([(h,) for h in hubs], f"{side} long")
        at_hub = low.join(F.broadcast(of_hubs), side, "left_semi")
        plain = e.join(F.broadcast(of_hubs), side, "left_anti").join(low, side, "left")
        return plain.select("u", "v", "m").union(e.join(F.broadcast(of_hubs), side, "left_semi").join(F.broadcast(at_hub), side, "left").select("u", "v", "m"))

    def large_star(e: DataFrame, n: int) -> DataFrame:
        return with_least(e, "v", n).select("u", F.coalesce("m", "v").alias("v")).distinct()

    def small_star(e: DataFrame, n: int) -> DataFrame:
        hooked = with_least(e, "u", n)
        return hooked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(hooked.where("v = m").select("u", "v")).distinct()

    current = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = digest(current)
    while before[0]:
        # a step leaves no more edges than it finds
        large = materialise(packed(large_star(current, before[0]), before[0]), name)
        current = materialise(packed(small_star(large, before[0]), before[0]), name)
        after = digest(current)
        if after == before:
            break
        before = after
    star = current.groupBy("u").agg(F.min("v").alias("component"))
    leaves = star.select(F.col("u").alias("node"), "component")
    roots = star.select(F.col("component").alias("node"), "component").distinct()
    return leaves.union(roots)
