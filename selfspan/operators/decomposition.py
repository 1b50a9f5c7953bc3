"""Principal components from aggregated moments: the only thing gathered is the d x d centred Gram matrix.

Products are summed of features less their mean, which a pass before finds, so that an offset common to all rows costs no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import wide_components

#: Features up to which the whole Gram matrix is gathered, and components found beyond it.
WIDE = 2048
MOST = 512


def vectors(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, features): the columns as one array of doubles."""
    return df.select(id_col, F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))


def long_form(df: DataFrame, id_col: str, features: str = "features") -> DataFrame:
    """(id, feature, value), features numbered from 0."""
    return df.select(id_col, F.posexplode(features).alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's number of rows and sums of features, as one row."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _rows(batch)
            n, total = n + len(x), x.sum(axis=0) if total is None else total + x.sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["n", "sums"])


def means(df: DataFrame, features: str = "features") -> tuple[int, np.ndarray]:
    """(number of rows, mean of every feature): d numbers reach the driver."""
    parts = df.select(F.col(features).cast("array<double>").alias("v")).mapInArrow(_sums, "n long, sums array<double>")
    rows = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("at").collect()
    return (rows[0]["n"], np.array([r["s"] for r in rows]) / rows[0]["n"]) if rows else (0, np.zeros(0))


def _products(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's sums of centred features, and of their products for i <= j, as one row."""
    first, second = np.zeros(len(mean)), np.zeros((len(mean), len(mean)))
    for batch in batches:
        if batch.num_rows:
            x = _rows(batch) - mean
            first += x.sum(axis=0)
            second += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((first, second[np.triu_indices(len(mean))]))], pa.list_(pa.float64()))], ["sums"])


def moments(df: DataFrame, mean: np.ndarray, features: str = "features") -> DataFrame:
    """(at, s): sums of the features less ``mean`` (at < d) and, from there on, of their products for i <= j by rows: outer
    products are summed within tasks, so a task ships d * (d + 3) / 2 numbers however many rows it has."""
    parts = df.select(F.col(features).cast("array<double>").alias("v")).mapInArrow(lambda b: _products(b, mean), "sums array<double>")
    return parts.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))


def centred_gram(df: DataFrame, features: str = "features") -> DataFrame:
    """(i, j, g) for i <= j: sums of products of centred features. What rounding has left of the means is taken off again."""
    n, mean = means(df, features)
    d = len(mean)
    sums = moments(df, mean, features)
    at = df.sparkSession.createDataFrame([(d + k, int(i), int(j)) for k, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True))], "at int, i int, j int")
    rest = sums.where(F.col("at") < d)
    side = lambda k: F.broadcast(rest.select(F.col("at").alias(k), F.col("s").alias(f"s{k}")))
    return sums.join(F.broadcast(at), "at").join(side("i"), "i").join(side("j"), "j").select("i", "j", (F.col("s") - F.col("si") * F.col("sj") / n).alias("g"))


@dataclass(frozen=True)
class Components:
    """Mean (d), loadings (d x k, the largest loading of each positive), variance ratios of all d (of the k where there are more
    than WIDE features), and k."""

    mean: np.ndarray
    loadings: np.ndarray
    ratios: np.ndarray
    k: int


def fit_components(df: DataFrame, features: str = "features", threshold: float = 0.90, k: int | None = None) -> Components:
    """The fewest components whose cumulative variance ratio exceeds ``threshold``, or ``k`` of them. Of more than WIDE features
    at most MOST components are found, the leading ones by themselves."""
    n, mean = means(df, features)
    if not n:
        raise ValueError("no rows to decompose")
    d = len(mean)
    if d > WIDE:
        return _fit_wide(df.select(F.col(features).cast("array<double>").alias("v")), n, mean, threshold, k)
    rows = moments(df, mean, features).toArrow()  # d * (d + 3) / 2 numbers
    sums = np.zeros(rows.num_rows)
    sums[rows.column("at").to_numpy()] = rows.column("s").to_numpy()
    gram = np.zeros((d, d))
    gram[np.triu_indices(d)] = sums[d:]
    gram += np.triu(gram, 1).T - np.outer(sums[:d], sums[:d]) / n
    values, basis = np.linalg.eigh(gram)
    values, basis = np.maximum(values[::-1], 0), basis[:, ::-1]
    ratios = values / (values.sum() or 1.0)
    keep = min(d, int(np.searchsorted(np.cumsum(ratios), threshold, "right")) + 1) if k is None else min(k, d)
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(d)])
    return Components(mean, basis[:, :keep], ratios, keep)


def _fit_wide(data: DataFrame, n: int, mean: np.ndarray, threshold: float, k: int | None) -> Components:
    if k is not None and min(k, n) > MOST:
        raise ValueError(f"{k} components of {len(mean)} features; {MOST} at most")
    want = 16 if k is None else min(k, n)
    while True:
        values, basis, total = wide_components.leading(data, n, mean, want)
        ratios = values / (total or 1.0)
        enough = int(np.searchsorted(np.cumsum(ratios), threshold, "right")) + 1
        if k is not None or enough <= len(values) or len(values) < want:
            break
        if want == MOST:
            raise ValueError(f"{MOST} components explain {ratios.sum():.4f} of the variance, not {threshold}")
        want = min(2 * want, MOST)
    keep = len(values) if k is not None else min(enough, len(values))
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    return Components(mean, basis[:, :keep], ratios, keep)


def _wide_scores(df: DataFrame, c: Components, features: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((c.mean, c.loadings))  # at most MOST numbers a feature
    kept = [x for x in df.columns if x != features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, loadings = shared.value
        for batch in batches:
            for at, x in wide_components.slices(batch, len(mean), batch.num_columns - 1):
                made = (x - mean) @ loadings
                same = batch.slice(at, len(x))
                yield pa.RecordBatch.from_arrays([*same.columns[:-1], *(pa.array(np.ascontiguousarray(v)) for v in made.T)], [*same.schema.names[:-1], *(f"PC{i + 1}" for i in range(c.k))])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields]
    return df.select(*kept, F.col(features).cast("array<double>").alias("__v")).mapInArrow(run, ", ".join([*kinds, *(f"PC{i + 1} double" for i in range(c.k))]))


def _dot(features: Column, weights: np.ndarray, shift: float) -> Column:
    return F.aggregate(F.zip_with(features, F.lit([float(w) for w in weights]), lambda a, b: a * b), F.lit(-float(shift)), lambda s, x: s + x)


def scores(df: DataFrame, c: Components, features: str = "features") -> DataFrame:
    """The rows with PC1 to PCk in place of the features."""
    if len(c.mean) > WIDE:
        return _wide_scores(df, c, features)
    pcs = [_dot(F.col(features), c.loadings[:, k], float(c.mean @ c.loadings[:, k])).alias(f"PC{k + 1}") for k in range(c.k)]
    return df.select(*[x for x in df.columns if x != features], *pcs)


def loading_table(spark, c: Components, names: list[str]) -> DataFrame:
    kinds = ", ".join(f"PC{k + 1} double" for k in range(c.k))
    return spark.createDataFrame([(n, *map(float, row)) for n, row in zip(names, c.loadings, strict=True)], f"feature string, {kinds}")


def variance_table(spark, c: Components, retained: bool = True) -> DataFrame:
    """(component, explained, cumulative) of the retained components, or of all."""
    rows = spark.createDataFrame([(k + 1, float(r)) for k, r in enumerate(c.ratios[: c.k] if retained else c.ratios)], "component int, explained double")
    return rows.withColumn("cumulative", F.sum("explained").over(Window.orderBy("component")))


def scree(spark, c: Components, threshold: float = 0.90) -> DataFrame:
    """(component, explained, cumulative, retained) of all components: those up to the first whose cumulative ratio reaches
    the threshold are retained."""
    rows = variance_table(spark, c, retained=False)
    before = F.coalesce(F.lag("cumulative").over(Window.orderBy("component")), F.lit(0.0))
    return rows.withColumn("retained", before < threshold)


def artifacts(df: DataFrame, c: Components, id_col: str, names: list[str], threshold: float = 0.90, features: str = "features") -> dict[str, DataFrame]:
    """The tables of a decomposition by name: normalised input, scores, loadings, variance, scree, summary."""
    spark = df.sparkSession
    summary = {"features": len(c.mean), "components": c.k, "threshold": threshold, "explained": float(c.ratios[: c.k].sum()), "first component": float(c.ratios[0]) if len(c.ratios) else None}
    return {
        "normalised": df.select(id_col, *[F.col(features)[k].alias(n) for k, n in enumerate(names)]), "scores": scores(df, c, features), "loadings": loading_table(spark, c, names), "variance": variance_table(spark, c),
        "scree": scree(spark, c, threshold), "summary": spark.createDataFrame([(k, None if v is None else str(v)) for k, v in summary.items()], "Property string, Value string"),
    }


def variance_sweep(df: DataFrame, thresholds: tuple[float, ...] = (0.90, 0.95, 0.97, 0.99), features: str = "features") -> DataFrame:
    """(threshold, components): one decomposition, every threshold."""
    c = fit_components(df, features, max(thresholds))
    total = np.cumsum(c.ratios)
    return df.sparkSession.createDataFrame([(t, min(len(total), int(np.searchsorted(total, t, "right")) + 1)) for t in thresholds], "threshold double, components int")
