"""How far clusters hold when the vectors are shaken."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import truncate
from . import external, many_means

#: Makes (id, cluster) of (id, features) for a number of clusters and a seed.
Clustering = Callable[[DataFrame, int, int], DataFrame]


def _uniform(*by) -> Column:
    """A number in (0, 1] that the arguments decide."""
    return (F.pmod(F.xxhash64(*by), F.lit(1 << 30)) + 1) / (1 << 30)


def shaken(rows: DataFrame, id_col: str, noise: float, seed: int, features: str = "features") -> DataFrame:
    """The vectors with Gaussian noise of standard deviation ``noise`` on every coordinate, the same for the same seed."""
    draw = lambda i: F.sqrt(-2 * F.log(_uniform(id_col, i, F.lit(seed)))) * F.cos(2 * F.pi() * _uniform(id_col, i, F.lit(-seed - 1)))
    return rows.withColumn(features, F.transform(features, lambda x, i: x + noise * draw(i)))


def k_means(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, cluster) by distributed k-means of (id, features)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("__vector", array_to_vector("features"))
    return KMeans(k=k, seed=seed, featuresCol="__vector", predictionCol="cluster").fit(data).transform(data).select(rows.columns[0], "cluster")


#: k-means runs of each clustering, of which the best counts.
RESTARTS = 3


def _shaken_means(rows: DataFrame, id_col: str, ks: list[int], runs: int, noise: float, seed: int) -> DataFrame:
    """(k, run, base, again) of every row: all clusterings of all k and copies are fitted side by side, a pass moves them all."""
    every = [many_means.Run(k, seed + t, 0.0 if r is None else noise, 0 if r is None else seed + r) for k in ks for r in (None, *range(runs)) for t in range(RESTARTS)]
    fitted = many_means.fit_runs(rows, id_col, every)
    chosen = fitted.best(lambda run: (run.k, run.noise, run.shake))
    of = rows.sparkSession.createDataFrame([(n, every[n].k, every[n].shake - seed if every[n].noise else -1) for n in chosen], "run int, k int, copy int")
    found = truncate(many_means.labels(rows, id_col, fitted, chosen).join(F.broadcast(of), "run").drop("run"))
    base = found.where("copy < 0").select("k", id_col, F.col("cluster").alias("base"))
    return found.where("copy >= 0").select("k", F.col("copy").alias("run"), id_col, F.col("cluster").alias("again")).join(base, ["k", id_col])


def stability(rows: DataFrame, ks: list[int], clustering: Clustering | None = None, runs: int = 20, noise: float = 0.01, seed: int = 42) -> DataFrame:
    """(k, stability, runs): mean agreement (ARI) of the clusters of ``rows`` (id, features) with those of ``runs`` shaken
    copies; copy r is shaken with the seed + r. Clusters are k-means', all copies of all k fitted together, or those that
    ``clustering`` makes, one call a copy."""
    id_col = rows.columns[0]
    if clustering is None:
        counts = external.contingency(_shaken_means(rows, id_col, ks, runs, noise, seed), "base", "again", ["k", "run"])
    else:
        counts = None
        for k in ks:
            base = clustering(rows, k, seed).withColumnRenamed("cluster", "base")
            for r in range(runs):
                again = clustering(shaken(rows, id_col, noise, seed + r), k, seed + r).withColumnRenamed("cluster", "again")
                part = external.contingency(base.join(again, id_col), "base", "again").select(F.lit(k).alias("k"), F.lit(r).alias("run"), "Cluster", "Label", "n")
                counts = part if counts is None else counts.union(part)
    return external.scores(counts, ["k", "run"]).groupBy("k").agg(F.avg("ARI").alias("stability"), F.count("*").alias("runs"))
