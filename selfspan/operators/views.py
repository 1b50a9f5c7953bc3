"""The tables behind the pictures: gallery places, ordered heatmap, sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import external
from .joins import with_place


#: The internal metrics of a sweep, in the order of its columns.
INTERNAL = ["silhouette", "dbi", "chi", "affinity_silhouette", "affinity_ratio", "ncut", "eigengap"]


def gallery(labels: DataFrame, id_col: str, cluster: str, columns: int = 5, keys: list[str] | None = None) -> DataFrame:
    """(keys, cluster, id, row, column): place of each member in its cluster's gallery, by id."""
    keys = keys or []
    rows = labels.select(*keys, F.col(cluster).alias("cluster"), F.col(id_col).alias("id"))
    placed, at = with_place(rows, [*keys, "cluster"], "id", "at"), F.col("at")
    return placed.select(*keys, "cluster", "id", F.floor(at / columns).alias("row"), (at % columns).cast("long").alias("column"))


def heatmap_order(labels: DataFrame, id_col: str, cluster: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, place, id, cluster, boundary): rows by cluster and id, boundary where a cluster starts. A place is the rows of
    earlier clusters plus the place in the own one."""
    keys = keys or []
    rows = labels.select(*keys, F.col(id_col).alias("id"), F.col(cluster).alias("cluster"))
    sizes = rows.groupBy(*keys, "cluster").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("cluster")  # over the clusters, not the rows
    before = sizes.select(*keys, "cluster", F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = with_place(rows, [*keys, "cluster"], "id", "at").join(F.broadcast(before), [*keys, "cluster"])
    return placed.select(*keys, (F.col("before") + F.col("at")).alias("place"), "id", "cluster", ((F.col("at") == 0) & (F.col("before") > 0)).alias("boundary"))


def external_sweep(labellings: DataFrame, truth: str = "label") -> DataFrame:
    """(k, ARI, NMI, Purity) of stacked labellings (k, cluster, truth); each must have exactly k clusters."""
    wrong = labellings.groupBy("k").agg(F.count_distinct("cluster").alias("kinds")).where("k <> kinds")
    if not wrong.isEmpty():
        raise ValueError(f"labellings without exactly k clusters: {[r['k'] for r in wrong.collect()]}")
    counts = labellings.groupBy("k", F.col("cluster").alias("Cluster"), F.col(truth).alias("Label")).agg(F.count("*").alias("n"))
    return external.scores(counts, ["k"])


def combine_by(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row a key with all tables' metrics; what a table lacks is null."""
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), tables)


def combine_by_k(tables: list[DataFrame]) -> DataFrame:
    """One row a k with all tables' metrics; what a table lacks is null."""
    return combine_by(tables, ["k"])


def internal_sweep(table: DataFrame, ks: range, metrics: list[str]) -> DataFrame:
    """The table if it has each k once and finite metrics, else an error."""
    r = table.agg(F.count("*"), F.count_distinct("k"), F.min("k"), F.max("k"), *[F.count_if(F.col(m).isNull() | F.isnan(m) | (F.abs(m) == float("inf"))) for m in metrics]).first()
    if (r[0], r[1], r[2], r[3]) != (len(ks), len(ks), ks[0], ks[-1]) or any(r[4:]):
        raise ValueError("the sweep is incomplete or not finite")
    return table.orderBy("k")


def metric_lines(table: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, metric, k, value): the points of one line a metric, without missing ones."""
    keys = keys or []
    tall = table.select(*keys, "k", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("p")).select(*keys, "p.metric", "k", "p.value")
    return tall.where("value IS NOT NULL AND NOT isnan(value)")
