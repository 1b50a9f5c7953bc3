"""Checks on feature tables: one pass of aggregates, never an action per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, reserved: tuple[str, ...] = ()) -> list[str]:
    return [c for c, kind in df.dtypes if (kind in NUMERIC or kind.startswith("decimal")) and c not in reserved]


def _is_float(df: DataFrame, c: str) -> bool:
    return dict(df.dtypes)[c] in ("float", "double")


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN becomes null, as aggregates take NaN for a number."""
    chosen = [c for c in (columns or df.columns) if _is_float(df, c)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in chosen}) if chosen else df


def missing(df: DataFrame, c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) if _is_float(df, c) else F.col(c).isNull()


def column_checks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, missing, infinite, constant) of every column, from a single aggregate that is then unpivoted.

    Constant: at most one distinct value that is not missing, told from least and greatest, so nothing is gathered.
    """
    chosen = columns or df.columns
    numeric = set(numeric_columns(df))
    aggs = []
    for c in chosen:
        there = F.when(~missing(df, c), F.col(c))
        infinite = F.count_if(F.abs(F.col(c)) == float("inf")) if c in numeric and _is_float(df, c) else F.lit(0)
        aggs.append(F.struct(F.lit(c).alias("feature"), F.count_if(missing(df, c)).alias("missing"), infinite.cast("long").alias("infinite"), F.coalesce(F.min(there) == F.max(there), F.lit(True)).alias("constant")).alias(c))
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"`{c}`") for c in chosen])))


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """(duplicates): second and further occurrences of ids; null counts as one value."""
    return df.groupBy(id_col).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def validation_report(df: DataFrame, id_col: str) -> DataFrame:
    """(check, subject, value): every finding as a row; raises on an empty table, the only check that does."""
    if df.isEmpty():
        raise ValueError("the feature table is empty")
    features = [c for c in df.columns if c != id_col]
    numeric = numeric_columns(df, (id_col,))
    spark = df.sparkSession
    ids = duplicate_ids(df, id_col).select(F.lit("duplicate ids").alias("check"), F.lit(id_col).alias("subject"), F.col("duplicates").cast("string").alias("value"))
    twice = sorted({c for c in df.columns if df.columns.count(c) > 1})
    plain = [("duplicate columns", c, "true") for c in twice] + [("not numeric", c, dict(df.dtypes)[c]) for c in features if c not in numeric]
    found = column_checks(df, features).select(
        "feature",
        F.explode(F.create_map(F.lit("missing"), F.col("missing").cast("string"), F.lit("infinite"), F.col("infinite").cast("string"), F.lit("constant"), F.when(F.col("constant"), "true"))).alias("check", "value"),
    ).where("value IS NOT NULL AND value <> '0'").select("check", F.col("feature").alias("subject"), "value")
    return ids.unionByName(found).unionByName(spark.createDataFrame(plain, "check string, subject string, value string"))


def aligned_inputs(tables: list[DataFrame], id_col: str, k: int) -> None:
    """Raise unless all tables hold the same unique, non-null ids, finite numbers and non-empty labels, and more rows than ``k``."""
    first = tables[0]
    for t in tables:
        r = t.agg(F.count("*"), F.count(id_col), F.count_distinct(id_col), *[F.count_if(missing(t, c) | (F.abs(F.col(c)) == float("inf"))) for c in numeric_columns(t, (id_col,))], *[F.count_if(F.col(c).isNull() | (F.trim(c) == "")) for c, kind in t.dtypes if kind == "string"]).first()
        if r[0] != r[1] or r[1] != r[2]:
            raise ValueError("null or repeated ids")
        if any(r[3:]):
            raise ValueError("missing, infinite or empty values")
        if r[0] <= k:
            raise ValueError("as many clusters as samples, or more")
    for t in tables[1:]:
        if not first.select(id_col).exceptAll(t.select(id_col)).isEmpty() or not t.select(id_col).exceptAll(first.select(id_col)).isEmpty():
            raise ValueError("the tables hold different ids")


def vector_gate(rows: DataFrame, id_col: str, features: str = "features") -> None:
    """Raise unless ids are unique and known, and all vectors have the same length and finite numbers."""
    sound = F.coalesce(F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    r = rows.agg(F.count("*").alias("rows"), F.count(id_col).alias("ids"), F.count_if(~sound).alias("unsound"), F.count_if(F.size(features) == 0).alias("empty"), F.min(F.size(features)).alias("least"), F.max(F.size(features)).alias("most")).first()
    repeated = duplicate_ids(rows, id_col).first()[0]
    if not r["rows"] or r["ids"] < r["rows"] or repeated or r["unsound"] or r["empty"] or r["least"] != r["most"]:
        raise ValueError(f"not a matrix of rows: {r.asDict() | {'repeated': repeated}}")
