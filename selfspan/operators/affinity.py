"""Affinity graphs in long form (i, j, value), and the scores of a labelling on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import truncate
from . import eigenvectors
from .spectral import matrix


def symmetric_affinity(coefficients: DataFrame, normalise: bool = True, keys: list[str] | None = None) -> DataFrame:
    """W = |C| + |C| transposed without the diagonal, over its maximum if that is positive: (keys, i, j, w), entries above 0.
    ``keys`` tell several coefficient tables stacked in one apart."""
    keys = keys or []
    a = coefficients.select(*keys, "i", "j", F.abs("value").alias("w")).where("i <> j")
    w = a.union(a.select(*keys, "j", "i", "w")).groupBy(*keys, "i", "j").agg(F.sum("w").alias("w")).where("w > 0")
    if not normalise:
        return w
    most = F.broadcast(w.groupBy(*keys).agg(F.max("w").alias("most")))  # a row a table
    return (w.join(most, keys) if keys else w.crossJoin(most)).select(*keys, "i", "j", (F.col("w") / F.col("most")).alias("w"))


METHODS = {"symmetric": symmetric_affinity}


def affinity(coefficients: DataFrame, method: str = "symmetric", normalise: bool = True, keys: list[str] | None = None) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown affinity {method!r}")
    return METHODS[method](coefficients, normalise, keys)


def affinity_gate(w: DataFrame, nodes: DataFrame, node: str = "node") -> None:
    """Raise unless every entry (i, j, w) is finite and not negative, lies between known nodes, occurs once and equals its mirror image."""
    sound = F.coalesce(~F.isnan("w") & (F.abs("w") < float("inf")) & (F.col("w") >= 0), F.lit(False))
    known = nodes.select(F.col(node).alias("known"))
    found = w.agg(F.count_if(~sound).alias("unsound")).first()[0]
    strange = w.select(F.explode(F.array("i", "j")).alias("n")).distinct().join(known, F.col("n") == F.col("known"), "left_anti").count()
    both = w.select("i", "j", "w", F.lit(1).alias("s")).union(w.select("j", "i", "w", F.lit(-1).alias("s"))).groupBy("i", "j").agg(F.sum("s").alias("s"), F.count("*").alias("n"), F.min("w").alias("a"), F.max("w").alias("b"))
    lame = both.where("s <> 0 OR n > 2 OR abs(a - b) > 1e-12 * greatest(1, abs(b))").count()
    if found or strange or lame:
        raise ValueError(f"no affinity over these nodes: {found} unsound entries, {strange} unknown nodes, {lame} entries that are repeated or unlike their mirror image")


def _labelled(w: DataFrame, labels: DataFrame, node: str, cluster: str, keys: list[str] | None = None) -> DataFrame:
    """Entries with the clusters of both ends. Labels may have more keys than the graph has, as for several k of one graph."""
    keys = keys or []
    shared = [k for k in keys if k in w.columns]
    side = lambda s: labels.select(*keys, F.col(node).alias(s), F.col(cluster).alias(f"c{s}"))
    return w.join(side("i"), [*shared, "i"]).join(side("j"), [*keys, "j"])


def affinity_ratio(w: DataFrame, labels: DataFrame, node: str = "node", cluster: str = "cluster", keys: list[str] | None = None) -> DataFrame:
    """(keys, ratio): mean affinity within over mean between clusters over all pairs i < j; absent pairs count as 0, so the
    numbers of pairs come from the cluster sizes. Infinite when nothing lies between, null without pairs."""
    keys = keys or []
    sums = _labelled(w, labels, node, cluster, keys).where("i < j").groupBy(*keys).agg(F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w"))).alias("inside"), F.sum(F.when(F.col("ci") != F.col("cj"), F.col("w"))).alias("across"))
    sizes = labels.groupBy(*keys, cluster).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs_in"))
    both = (sizes.join(sums, keys, "left") if keys else sizes.crossJoin(F.broadcast(sums))).withColumn("pairs_out", F.col("n") * (F.col("n") - 1) / 2 - F.col("pairs_in"))
    inside, across = F.try_divide(F.coalesce("inside", F.lit(0.0)), "pairs_in"), F.try_divide(F.coalesce("across", F.lit(0.0)), "pairs_out")
    return both.select(*keys, F.when(across == 0, F.lit(float("inf"))).otherwise(inside / across).alias("ratio"))


def cluster_cuts(w: DataFrame, labels: DataFrame, node: str = "node", cluster: str = "cluster", keys: list[str] | None = None) -> DataFrame:
    """(keys, cluster, cut, association): weight leaving the cluster, and all weight of its rows."""
    return _labelled(w, labels, node, cluster, keys).groupBy(*(keys or []), F.col("ci").alias("cluster")).agg(F.coalesce(F.sum(F.when(F.col("ci") != F.col("cj"), F.col("w"))), F.lit(0.0)).alias("cut"), F.sum("w").alias("association"))


def normalised_cut(w: DataFrame, labels: DataFrame, node: str = "node", cluster: str = "cluster", keys: list[str] | None = None) -> DataFrame:
    """(keys, ncut): sum of cut over association; a cluster without weight has no term."""
    return cluster_cuts(w, labels, node, cluster, keys).groupBy(*(keys or [])).agg(F.sum(F.try_divide("cut", "association")).alias("ncut"))


def affinity_silhouette(w: DataFrame, labels: DataFrame, node: str = "node", cluster: str = "cluster", keys: list[str] | None = None) -> DataFrame:
    """(keys, silhouette) over the distances 1 - w / max w, 0 on the diagonal. A pair without an entry is at distance 1, so a
    node's summed distance to a cluster is the cluster's size less the node's weight to it: pairs are never filled in."""
    keys = keys or []
    shared = [k for k in keys if k in w.columns]
    most = F.broadcast(w.groupBy(*shared).agg(F.max("w").alias("most")))
    top = (w.join(most, shared) if shared else w.crossJoin(most)).select(*shared, "i", "j", (F.col("w") / F.col("most")).alias("w"))
    weight = _labelled(top, labels, node, cluster, keys).groupBy(*keys, "i", F.col("cj").alias("other")).agg(F.sum("w").alias("near"))
    sizes = labels.groupBy(*keys, F.col(cluster).alias("other")).agg(F.count("*").alias("n"))
    mine = labels.select(*keys, F.col(node).alias("i"), F.col(cluster).alias("own"))
    # nodes x clusters rows
    pairs = mine.join(F.broadcast(sizes), keys) if keys else mine.crossJoin(F.broadcast(sizes))
    each = pairs.join(weight, [*keys, "i", "other"], "left").withColumn("near", F.coalesce("near", F.lit(0.0)))
    same = F.col("own") == F.col("other")
    a = F.max(F.when(same, F.try_divide(F.col("n") - 1 - F.col("near"), F.col("n") - 1)))
    b = F.min(F.when(~same, (F.col("n") - F.col("near")) / F.col("n")))
    rows = each.groupBy(*keys, "i").agg(a.alias("a"), b.alias("b"), F.max(F.when(same, F.col("n"))).alias("size"))
    s = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return rows.groupBy(*keys).agg(F.when(F.count("b") > 0, F.avg(s)).alias("silhouette"))


def clean_graph(w: DataFrame) -> DataFrame:
    """Not a number and infinite become 0, weights absolute and averaged with their transpose, no diagonal."""
    sound = w.select("i", "j", F.when(F.isnan("w") | (F.abs("w") == float("inf")) | F.col("w").isNull(), 0.0).otherwise(F.abs("w")).alias("w")).where("i <> j")
    return sound.union(sound.select("j", "i", "w")).groupBy("i", "j").agg((F.sum("w") / 2).alias("w")).where("w > 0")


def laplacian_spectrum(w: DataFrame, nodes: list[int], limit: int = 4096) -> DataFrame:
    """(place, eigenvalue, gap) of the normalised Laplacian, ascending; an isolated node has a zero row; values below
    1e-12 are 0. For graphs of a bounded number of nodes (landmarks): one task decomposes the matrix."""
    if len(nodes) > limit:
        raise ValueError(f"{len(nodes)} nodes; the dense kernels take {limit}: use landmarks")
    nodes = sorted(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = matrix(batches, nodes)
        degree = a.sum(axis=1)
        scale = np.divide(1.0, np.sqrt(degree), out=np.zeros_like(degree), where=degree > 0)
        values = np.linalg.eigvalsh(np.diag((degree > 0) * 1.0) - scale[:, None] * a * scale[None, :])
        values[np.abs(values) < 1e-12] = 0
        gap = np.append(np.diff(values), np.nan)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(values) + 1), pa.int32()), pa.array(values), pa.array(gap, mask=np.isnan(gap))], ["place", "eigenvalue", "gap"])

    return clean_graph(w).select("i", "j", "w").repartition(1).mapInArrow(run, "place int, eigenvalue double, gap double")


def leading_spectrum(w: DataFrame, nodes: DataFrame, places: int, tol: float = 1e-6) -> DataFrame:
    """(place, eigenvalue, gap) of the ``places`` least eigenvalues of the normalised Laplacian, ascending, of a graph of any
    number of nodes (node); an isolated node has a zero row. The last gap is to the next eigenvalue."""
    graph = truncate(clean_graph(w))
    met = graph.select(F.col("i").alias("node")).distinct()
    alone, rest = nodes.join(met, "node", "left_anti").count(), truncate(nodes.join(met, "node", "left_semi"))
    values = np.zeros(0)
    if alone <= places and not rest.isEmpty():
        values = np.maximum(1 - eigenvectors.leading(eigenvectors.normalised(graph), rest, places + 1, tol)[0], 0)
    found = np.concatenate((np.zeros(min(alone, places + 1)), values))[: places + 1]
    found[found < 1e-12] = 0
    gap = [float(b - a) for a, b in zip(found, found[1:], strict=False)] + [None]
    return w.sparkSession.createDataFrame([(p + 1, float(v), gap[p]) for p, v in enumerate(found[:places])], "place int, eigenvalue double, gap double")


def threshold(coefficients: DataFrame, tau: float) -> DataFrame:
    """Soft threshold of the values: sign(v) * max(|v| - tau, 0)."""
    return coefficients.withColumn("value", F.signum("value") * F.greatest(F.abs("value") - tau, F.lit(0.0)))


def coefficient_structure(coefficients: DataFrame, n: int) -> DataFrame:
    """(largest, active, density, off_diagonal_density, l1): entries above max(1e-6 * largest, 1e-10) are active; density is
    over n * n entries, off_diagonal_density over n * (n - 1)."""
    most = coefficients.agg(F.coalesce(F.max(F.abs("value")), F.lit(0.0)).alias("largest"))
    bar = F.greatest(F.lit(1e-6) * F.col("largest"), F.lit(1e-10))
    return coefficients.join(F.broadcast(most), how="cross").agg(
        F.max("largest").alias("largest"), F.count_if(F.abs("value") > bar).alias("active"),
        (F.count_if(F.abs("value") > bar) / (n * n)).alias("density"),
        F.try_divide(F.count_if((F.abs("value") > bar) & (F.col("i") != F.col("j"))), F.lit(n * (n - 1))).alias("off_diagonal_density"),
        F.sum(F.abs("value")).alias("l1"),
    )
