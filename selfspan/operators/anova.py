"""One-way analysis of variance of many features over clusters, with false-discovery control."""

from __future__ import annotations

from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .validation import nan_to_null


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def f_tail(f: float, d1: float, d2: float) -> float:
    """Probability that an F variable with d1, d2 degrees of freedom exceeds f."""
    if f <= 0:
        return 1.0
    if f == float("inf"):
        return 0.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x else f_tail(x, a, b) for x, a, b in zip(f, d1, d2, strict=True)], dtype="float64")


def f_statistics(df: DataFrame, cluster: str, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, groups, n, f, eta_squared) over the groups of more than one known value; features with fewer than two
    such groups are left out. Moments per feature and group are partial aggregates of the unpivoted table.

    Where nothing varies within the groups, f is infinite, or null if nothing varies between them either. Groups and features
    of one value are told by their least and greatest value, not by moments that rounding may have touched.
    """
    by = [*(keys or []), "feature"]
    tall = nan_to_null(df).select(*by[:-1], cluster, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("e")).select(*by[:-1], cluster, "e.*").where(f"x IS NOT NULL AND `{cluster}` IS NOT NULL")
    groups = tall.groupBy(*by, cluster).agg(
        F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.when(F.min("x") == F.max("x"), F.min("x")).otherwise(F.avg("x")).alias("m"), F.when(F.min("x") == F.max("x"), 0.0).otherwise(F.var_samp("x")).alias("v")
    ).where("n > 1")
    whole = groups.groupBy(*by).agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    sums = groups.join(whole, by).groupBy(*by).agg(
        F.count("*").alias("groups"), F.max("total").alias("n"), F.when(F.min("low") < F.max("high"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2))).otherwise(0.0).alias("between"), F.sum((F.col("n") - 1) * F.col("v")).alias("within")
    ).where("groups > 1")
    f = F.when(F.col("within") > 0, F.col("between") / (F.col("groups") - 1) / (F.col("within") / (F.col("n") - F.col("groups")))).when(F.col("between") > 0, float("inf"))
    return sums.select(*by, "groups", "n", f.alias("f"), F.try_divide("between", F.col("between") + F.col("within")).alias("eta_squared"))


def adjust(p_values: DataFrame, p: str = "p_value", alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg within each group of ``keys``: adds adjusted_p and significant. The table has one row a test. A test
    without a p value is no part of the family: it has no adjusted value and is not significant."""
    family = Window.partitionBy(*(keys or [F.lit(0)]))
    known = p_values.withColumn("__p", F.when(~F.isnan(p), F.col(p).cast("double")))
    ranked = known.withColumn("__rank", F.row_number().over(family.orderBy(F.asc_nulls_last("__p")))).withColumn("__m", F.count("__p").over(family))
    running = F.min(F.col("__p") * F.col("__m") / F.col("__rank")).over(family.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0))
    adjusted = ranked.withColumn("adjusted_p", F.when(F.col("__p").isNotNull(), F.least(running, F.lit(1.0))))
    return adjusted.withColumn("significant", F.coalesce(F.col("adjusted_p") <= alpha, F.lit(False))).drop("__p", "__rank", "__m")


def anova(df: DataFrame, cluster: str, features: list[str], alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """f_statistics with p_value, adjusted_p and significant, largest effect first."""
    tests = f_statistics(df, cluster, features, keys)
    p = tests.withColumn("p_value", f_p_value("f", (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")))
    return adjust(p, "p_value", alpha, keys).orderBy(*(keys or []), F.desc("eta_squared"), "feature")


def strongest(tests: DataFrame, k: int = 20) -> DataFrame:
    """The k features of largest effect."""
    return tests.orderBy(F.desc("eta_squared"), "feature").limit(k)
