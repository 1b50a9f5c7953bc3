"""Internal cluster scores of vectors: silhouette, Davies-Bouldin, Calinski-Harabasz."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import truncate
from . import streams

#: Vectors in a block of the pairwise silhouette.
BLOCK = 1024
#: Rows whose distances to a block are found at once, which a core's cache holds.
STRIP = 256


def _centroids(df: DataFrame, keys: list[str], cluster: str, features: str) -> DataFrame:
    """(keys, cluster, n, centroid): means per coordinate, gathered as arrays of the vectors' width."""
    by = [*keys, cluster]
    means = df.select(*by, F.posexplode(features).alias("feature", "value")).groupBy(*by, "feature").agg(F.avg(F.col("value").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("feature", "m"))), lambda x: x["m"]).alias("centroid"))


def _square(a: str, b: str):
    return F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def davies_bouldin(df: DataFrame, cluster: str, features: str = "features", keys: list[str] | None = None) -> DataFrame:
    """(keys, dbi): mean over clusters of the worst (s_i + s_j) / distance; null with fewer than two clusters or as many as
    rows. ``keys`` tell several labellings stacked in one table apart."""
    keys = keys or []
    c = _centroids(df, keys, cluster, features)
    spread = df.join(c, [*keys, cluster]).groupBy(*keys, cluster).agg(F.avg(F.sqrt(_square(features, "centroid"))).alias("s"), F.first("centroid").alias("centroid"), F.count("*").alias("n"))
    a, b = spread.toDF(*keys, "a", "sa", "ca", "na"), spread.toDF(*(f"{k}_b" for k in keys), "b", "sb", "cb", "nb")
    # clusters x clusters rows; a labelling of one cluster keeps it, without a partner
    other = F.col("a") != F.col("b")
    for k in keys:
        other = other & (F.col(k) == F.col(f"{k}_b"))
    apart = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    worst = a.join(b, other, "left").groupBy(*keys, "a").agg(F.max(F.try_divide(F.col("sa") + F.col("sb"), apart)).alias("r"), F.max("na").alias("n"))
    return worst.groupBy(*keys).agg(F.when((F.count("*") > 1) & (F.count("*") < F.sum("n")), F.avg("r")).alias("dbi"))


def calinski_harabasz(df: DataFrame, cluster: str, features: str = "features", keys: list[str] | None = None) -> DataFrame:
    """(keys, chi): between over within dispersion, each over its degrees of freedom; same guards."""
    keys = keys or []
    c = _centroids(df, keys, cluster, features)
    # the mean of all is the clusters' means by their sizes
    mean = c.select(*keys, "n", F.posexplode("centroid").alias("feature", "m")).groupBy(*keys, "feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"))
    mean = F.broadcast(mean.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "m"))), lambda x: x["m"]).alias("mean")))
    within = df.join(c, [*keys, cluster]).groupBy(*keys).agg(F.sum(_square(features, "centroid")).alias("w"), F.count("*").alias("n"))
    between = (c.join(mean, keys) if keys else c.crossJoin(mean)).groupBy(*keys).agg(F.sum(F.col("n") * _square("centroid", "mean")).alias("b"), F.count("*").alias("kinds"))
    x = within.join(between, keys) if keys else within.crossJoin(F.broadcast(between))
    return x.select(*keys, F.when((F.col("kinds") > 1) & (F.col("kinds") < F.col("n")), F.try_divide(F.col("b") / (F.col("kinds") - 1), F.col("w") / (F.col("n") - F.col("kinds")))).alias("chi"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of x and y, about y's mean: squares of what is left lose no digits to a common offset."""
    centre = y.mean(axis=0)
    x, y = x - centre, y - centre
    one = lambda a: np.ones((len(a), 1))
    d = np.hstack((-2 * x, (x * x).sum(axis=1, keepdims=True), one(x))) @ np.hstack((y, one(y), (y * y).sum(axis=1, keepdims=True))).T
    np.maximum(d, 0, out=d)
    return np.sqrt(d, out=d)


class _Silhouettes:
    """Rows of a block with their summed distances to each cluster that has come by, and its size, in every labelling."""

    def __init__(self, ids: np.ndarray, clusters: np.ndarray, x: np.ndarray):
        self.ids, self.clusters, self.x = ids, clusters.reshape(len(ids), -1), x.reshape(len(ids), -1)
        self.places: list[dict[int, int]] = [{} for _ in self.clusters.T]
        self.sums, self.sizes = [np.zeros((0, len(ids))) for _ in self.places], [np.zeros(0) for _ in self.places]

    def take(self, ids: np.ndarray, clusters: np.ndarray, y: np.ndarray) -> None:
        """The distances are found once for all labellings."""
        groups = []
        for k, row in enumerate(clusters.reshape(len(ids), -1).T):
            kinds, at, counts = np.unique(row, return_inverse=True, return_counts=True)
            place = np.array([self.places[k].setdefault(c, len(self.places[k])) for c in kinds.tolist()])
            grow = len(self.places[k]) - len(self.sizes[k])
            self.sums[k], self.sizes[k] = np.vstack((self.sums[k], np.zeros((grow, len(self.ids))))), np.append(self.sizes[k], np.zeros(grow))
            self.sizes[k][place] += counts
            groups.append((place, np.eye(len(kinds))[at]))
        members, ends = np.hstack([member for _, member in groups]), np.cumsum([len(place) for place, _ in groups])
        y = y.reshape(len(ids), -1)
        same = np.minimum(np.searchsorted(ids, self.ids), len(ids) - 1)
        own = np.flatnonzero(ids[same] == self.ids)
        for at in range(0, len(self.ids), STRIP):
            rows = slice(at, at + STRIP)
            d = _distances(self.x[rows], y)
            here = own[(own >= at) & (own < at + STRIP)]
            d[here - at, same[here]] = 0
            for k, (part, (place, _)) in enumerate(zip(np.split((d @ members).T, ends[:-1]), groups, strict=True)):
                self.sums[k][place, rows] += part

    def scores(self) -> Iterator[tuple[int, float, int]]:
        """(labelling, sum of the rows' silhouettes, rows)."""
        for k, places in enumerate(self.places):
            at, place = np.arange(len(self.ids)), np.array([places[c] for c in self.clusters[:, k].tolist()])
            size = self.sizes[k][place]
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = self.sums[k] / self.sizes[k][:, None]
                a = self.sums[k][place, at] / (size - 1)
                mean[place, at] = np.nan
                b = np.fmin.reduce(mean, axis=0)
                s = (b - a) / np.maximum(a, b)
            s[(size == 1) | (len(places) < 2) | (np.maximum(a, b) == 0)] = 0
            yield k, float(s.sum()), len(s)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(held: _Silhouettes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held.scores(), strict=True), (pa.int32(), pa.float64(), pa.int64()), strict=True)], ["labelling", "s", "rows"])

    of, held = lambda row: (streams.array(row, "ids", np.int64), streams.array(row, "c", np.int64), streams.array(row, "v")), None
    for others, begins in streams.met(batches):
        if begins:
            if held is not None:
                yield done(held)
            held = _Silhouettes(*of(begins))
        held.take(*of(others))
    if held is not None:
        yield done(held)


def silhouette(df: DataFrame, id_col: str, cluster: str, features: str = "features", query: str = "true", keys: list[str] | None = None) -> DataFrame:
    """(keys, silhouette, rows): mean silhouette by Euclidean distance of the rows that ``query`` (over ``id``) selects
    against all rows.

    Blocks of the selected rows meet all rows as a stream, whose distances a task sums by cluster: neither pairs nor sums
    leave it, but a number a block. Labellings of the same rows stacked by ``keys`` share the distances. It is still quadratic
    in the selected rows times all rows: for very many, state a ``query``, such as ids divisible by 100. Null with fewer than
    two clusters or as many as rows; a cluster of one row scores 0.
    """
    keys = keys or []
    rows = df.select(*keys, F.col(id_col).cast("long").alias("id"), F.col(cluster).cast("long").alias("c"), F.col(features).cast("array<double>").alias("v"))
    names = [tuple(r) for r in rows.select(*keys).distinct().orderBy(*keys).collect()] if keys else [()]  # the labellings
    which = F.lit(0)
    for n, values in enumerate(names):
        for_one = F.lit(True)
        for k, v in zip(keys, values, strict=True):
            for_one = for_one & (F.col(k) == F.lit(v))
        which = F.when(for_one, n).otherwise(which)
    marked = rows.withColumn("labelling", which.cast("int"))
    each_row = marked.select("id", F.array("c").alias("c"), "v") if not keys else marked.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("labelling", "c"))), lambda x: x["c"]).alias("c"), F.first("v").alias("v"))
    sizes = marked.groupBy("labelling", F.col("c").alias("other")).agg(F.count("*").alias("n"))
    data = truncate(each_row.select("id", "c", "v"))
    chosen = data.where(query)
    n, m = data.count(), chosen.count()
    size = min(BLOCK, max(64, -(-m // (4 * df.sparkSession.sparkContext.defaultParallelism))))
    pairs = streams.against_all(streams.own_blocks(chosen, m, size), streams.blocks(data, max(n, 1), BLOCK))
    found = pairs.mapInArrow(_scored, "labelling int, s double, rows long").groupBy("labelling").agg((F.sum("s") / F.sum("rows")).alias("s"), F.sum("rows").alias("rows"))
    guard = sizes.groupBy("labelling").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    named = [F.element_at(F.array(*[F.lit(v[p]) for v in names]), F.col("labelling") + 1).alias(k) for p, k in enumerate(keys)]
    return found.join(F.broadcast(guard), "labelling").select(*named, F.when((F.col("kinds") > 1) & (F.col("kinds") < F.col("n")), F.col("s")).alias("silhouette"), "rows")
