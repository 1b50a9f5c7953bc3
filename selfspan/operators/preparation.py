"""Imputation, scaling and group weighting of feature tables.

Statistics are one aggregate over all columns, a single row, joined back as scalars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import truncate
from .validation import nan_to_null, numeric_columns

EPS = 1e-8


def _with_statistics(df: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """Add one-row aggregates of ``df`` as columns; the single row is broadcast."""
    return df.join(F.broadcast(df.agg(*[c.alias(n) for n, c in stats.items()])), how="cross")


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with exact quantiles by name, each of a column at a share, by linear interpolation.

    Values are counted, the counts dealt out by range and written, and ranks are running sums within a range on top of the
    ranges before it: no task holds more than a range, however many distinct values a column has.
    """
    columns = sorted({c for c, _ in wanted.values()})
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")).select("e.*").where("value IS NOT NULL")
    counts = tall.groupBy("feature", "value").agg(F.count("*").alias("n"))
    ranged = truncate(counts.repartitionByRange("feature", "value").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("feature", "part").agg(F.sum("n").alias("held"))  # ranges x columns rows
    place = parts.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("held").over(Window.partitionBy("feature")))
    inside = Window.partitionBy("feature", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.join(F.broadcast(place), ["feature", "part"]).withColumn("end", F.col("before") + F.sum("n").over(inside))

    def at(c: str, share: float) -> Column:
        spot = F.lit(share) * (F.col("total") - 1)
        pick = lambda rank: F.max(F.when((F.col("feature") == c) & (F.col("end") - F.col("n") <= rank) & (rank < F.col("end")), F.col("value")))
        low, high = pick(F.floor(spot)), pick(F.ceil(spot))
        return low + (high - low) * F.max(F.when(F.col("feature") == c, spot - F.floor(spot)))

    return ranked.agg(*[at(c, share).alias(name) for name, (c, share) in wanted.items()])


def impute(df: DataFrame, method: str = "drop", id_col: str | None = None) -> DataFrame:
    """drop (rows with any null), mean, median (exact) or zero; NaN counts as missing."""
    clean = nan_to_null(df)
    columns = numeric_columns(df, (id_col,) if id_col else ())
    if method == "drop":
        # one test over an array of flags: a conjunction over many columns makes the optimizer derive constraints for each
        return clean.where(~F.exists(F.array(*[F.col(c).isNull() for c in clean.columns]), lambda gone: gone))
    if method == "zero":
        return clean.na.fill(0, columns)
    if method not in ("mean", "median"):
        raise ValueError(f"unknown imputation {method!r}")
    if method == "mean":
        joined = _with_statistics(clean, {f"{c}__fill": F.avg(c) for c in columns})
    else:
        joined = clean.crossJoin(F.broadcast(quantiles(clean, {f"{c}__fill": (c, 0.5) for c in columns}))) if columns else clean
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}__fill")) for c in columns}).select(*df.columns)


_SCALES: dict[str, tuple[dict[str, Callable[[str], Column]], Callable[[Column, Column, Column], Column]]] = {
    "standard": ({"a": F.avg, "b": F.stddev_samp}, lambda x, a, b: (x - a) / (b + EPS)),
    "population": ({"a": F.avg, "b": F.stddev_pop}, lambda x, a, b: (x - a) / (b + EPS)),
    "minmax": ({"a": F.min, "b": lambda c: F.max(c) - F.min(c)}, lambda x, a, b: (x - a) / (b + EPS)),
    "robust": ({"a": F.median, "b": lambda c: F.percentile(c, 0.75) - F.percentile(c, 0.25)}, lambda x, a, b: (x - a) / (b + EPS)),
}


def scale_statistics(df: DataFrame, method: str, id_col: str | None = None) -> DataFrame:
    """(feature, location, spread) of each numeric column."""
    stats, _ = _scale(method)
    columns = numeric_columns(df, (id_col,) if id_col else ())
    if method == "robust" and columns:
        three = quantiles(nan_to_null(df), {f"{c}__{k}": (c, share) for c in columns for k, share in (("a", 0.5), ("low", 0.25), ("high", 0.75))})
        of = lambda c, k: F.col(f"`{c}__{k}`").cast("double")
        return three.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), of(c, "a").alias("location"), (of(c, "high") - of(c, "low")).alias("spread")) for c in columns])))
    rows = [F.struct(F.lit(c).alias("feature"), stats["a"](c).cast("double").alias("location"), stats["b"](c).cast("double").alias("spread")).alias(c) for c in columns]
    return nan_to_null(df).agg(*rows).select(F.inline(F.array(*[F.col(f"`{c}`") for c in columns])))


def _scale(method: str):
    if method not in _SCALES:
        raise ValueError(f"unknown scaling {method!r}")
    return _SCALES[method]


def scale(df: DataFrame, method: str = "standard", id_col: str | None = None) -> DataFrame:
    """Numeric columns less their location over their spread: standard (sample deviation), population, minmax or robust."""
    stats, apply = _scale(method)
    columns = numeric_columns(df, (id_col,) if id_col else ())
    clean = nan_to_null(df)
    if method == "robust" and columns:
        three = quantiles(clean, {f"{c}__{k}": (c, share) for c in columns for k, share in (("a", 0.5), ("low", 0.25), ("high", 0.75))})
        joined = clean.crossJoin(F.broadcast(three.withColumns({f"{c}__b": F.col(f"{c}__high") - F.col(f"{c}__low") for c in columns})))
    else:
        joined = _with_statistics(clean, {f"{c}__{k}": f(c) for c in columns for k, f in stats.items()})
    return joined.withColumns({c: apply(F.col(c), F.col(f"{c}__a"), F.col(f"{c}__b")) for c in columns}).select(*df.columns)


#: Which names belong to which group of face features, first match wins: (group, prefixes, parts, exact names).
FACE_GROUPS = (
    ("Eyes", ("Left Eye", "Right Eye", "Eye ", "Inter-Eye"), ("EAR",), ()),
    ("Mouth", ("Mouth", "Upper Lip"), (), ("MAR",)),
    ("Eyebrows", ("Left Brow", "Right Brow", "Eyebrow", "Inner Brow", "Brow Centre"), (), ()),
)


def feature_groups(columns: list[str], rules=FACE_GROUPS) -> dict[str, list[str]]:
    """Columns by group, by name; a column no rule fits is in no group."""
    groups: dict[str, list[str]] = {group: [] for group, *_ in rules}
    for c in columns:
        for group, prefixes, parts, names in rules:
            if c.startswith(prefixes) or any(p in c for p in parts) or c in names:
                groups[group].append(c)
                break
    return groups


def group_weight(size: int, method: str = "sqrt") -> float:
    weights = {"equal": lambda n: 1.0, "inverse": lambda n: 1.0 / n, "sqrt": lambda n: n**-0.5}
    if method not in weights:
        raise ValueError(f"unknown weighting {method!r}")
    return weights[method](size)


def weight_features(df: DataFrame, groups: dict[str, list[str]], method: str = "sqrt") -> DataFrame:
    """Each grouped column times its group's weight."""
    factors = {c: group_weight(len(names), method) for names in groups.values() for c in names}
    return df.withColumns({c: F.col(c) * F.lit(w) for c, w in factors.items()})


def weight_table(spark, groups: dict[str, list[str]], method: str = "sqrt") -> DataFrame:
    rows = [(c, g, group_weight(len(names), method)) for g, names in groups.items() for c in names]
    return spark.createDataFrame(rows, "Feature string, Group string, Weight double")
