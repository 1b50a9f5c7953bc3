"""Key-aligned joins that refuse to guess."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import truncate


def join_gate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: left_only, right_only, null_keys, repeated_keys of a one-to-one join, from one full outer join of counts."""
    side = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))  # noqa: E731  partial counts before the shuffle
    both = side(left, "l").join(side(right, "r"), key, "full_outer")
    nulls = F.sum(F.when(F.col(key).isNull(), F.coalesce("l", F.lit(0)) + F.coalesce("r", F.lit(0))).otherwise(0))
    known = F.col(key).isNotNull()
    return both.agg(
        F.count_if(known & F.col("r").isNull()).alias("left_only"),
        F.count_if(known & F.col("l").isNull()).alias("right_only"),
        F.coalesce(nulls, F.lit(0)).cast("long").alias("null_keys"),
        F.count_if(known & ((F.coalesce("l", F.lit(0)) > 1) | (F.coalesce("r", F.lit(0)) > 1))).alias("repeated_keys"),
    )


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two tables with the same unique keys; anything else raises with the counts."""
    for side in (left, right):
        if key not in side.columns:
            raise ValueError(f"no column {key!r}")
    found = join_gate(left, right, key).first().asDict()
    if any(found.values()):
        raise ValueError(f"not one to one on {key!r}: {found}")
    return left.join(right, key)


def with_place(df: DataFrame, groups: list[str], order: str, name: str) -> DataFrame:
    """Number the rows of each group from 0 in the order of a column. Rows are dealt out by range and written; a place is the
    group's rows in earlier ranges plus the place within the own one, so no task orders a whole group, however large."""
    part = truncate(df.repartitionByRange(*groups, order).withColumn("__part", F.spark_partition_id()))
    by = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    before = part.groupBy(*groups, "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(by), F.lit(0))).drop("__n")
    own = part.withColumn("__at", F.row_number().over(Window.partitionBy(*groups, "__part").orderBy(order)))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*groups, "__part")])
    return own.alias("a").join(before.alias("b"), same).select(*[f"a.{c}" for c in df.columns], (F.col("a.__at") + F.col("b.__before") - 1).alias(name))


def with_row_id(df: DataFrame, order: str, name: str = "row_id") -> DataFrame:
    """Number rows from 0 in the order of a key, without a task that sorts the table."""
    return with_place(df, [], order, name)


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys of each side that the other lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return join_gate(a, b, key).select("left_only", "right_only")


def label_gate(ids: DataFrame, labels: DataFrame, id_col: str, label: str, keys: list[str] | None = None) -> None:
    """Raise unless every labelling (told by ``keys``) has each id once, no other id, and no null label."""
    keys = keys or []
    counted = labels.groupBy(*keys, id_col).agg(F.count("*").alias("n"), F.count_if(F.col(label).isNull()).alias("unlabelled"))
    known = ids.select(id_col, F.lit(True).alias("known"))
    found = counted.join(known, id_col, "left").groupBy(*keys).agg(F.count_if(F.col("n") > 1).alias("repeated"), F.sum("unlabelled").alias("unlabelled"), F.count_if(F.col("known").isNull()).alias("strange"), F.count_if(F.col("known").isNotNull()).alias("met"))
    total = ids.count()
    wrong = found.where(f"repeated > 0 OR unlabelled > 0 OR strange > 0 OR met <> {total}")
    if not wrong.isEmpty() or (total and labels.isEmpty()):
        raise ValueError(f"labels that do not fit the {total} ids: {[r.asDict() for r in wrong.limit(20).collect()]}")


def aligned_join(features: DataFrame, labels: DataFrame, id_col: str, row_id: str = "row_id") -> tuple[DataFrame, str]:
    """Features and labels of the same rows, and how they met: by ``id_col`` where both have it, else by ``row_id``, the place
    in their order. Either way one to one: unlike ids raise with the counts of both sides."""
    by = id_col if id_col in features.columns and id_col in labels.columns else row_id
    if by == row_id and not (row_id in features.columns and row_id in labels.columns):
        raise ValueError(f"the tables share neither {id_col!r} nor {row_id!r}")
    other = [c for c in labels.columns if c == by or c not in features.columns]
    return strict_join(features, labels.select(*other), by), by
