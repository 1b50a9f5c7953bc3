"""Files in and out: image folders, feature CSVs, text reports, manifests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")


def image_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(Image, path, length, content) of the images in a folder itself, whatever the case of their endings."""
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*IMAGE_TYPES) & name.contains(".")).select(name.alias("Image"), "path", "length", "content")


def read_features(spark: SparkSession, path: str, id_col: str = "Image", numeric: list[str] | None = None) -> DataFrame:
    """A feature CSV with a header: the id as text, the rest as doubles (or only ``numeric``, other columns as text)."""
    text = read_text_rows(spark, path)
    if id_col not in text.columns:
        raise ValueError(f"no column {id_col!r} in {path}")
    chosen = numeric if numeric is not None else [c for c in text.columns if c != id_col]
    return text.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in chosen})


def read_text_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte-order mark before the header is dropped."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=False)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def input_manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, sha256) of input files, hashed where they are read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def properties(spark: SparkSession, values: dict) -> DataFrame:
    """(Property, Value) rows of a report."""
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in values.items()], "Property string, Value string")


def append_results(df: DataFrame, path: str) -> None:
    """Add rows to a result table, so that finished grid points survive a stop."""
    df.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds anything at a path."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def resolve_input(spark: SparkSession, override: str | None, *candidates: str) -> str:
    """The override if there is one, else the first candidate that exists; none is an error that names them all."""
    if override:
        return override
    for path in candidates:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(candidates)}")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short text, such as a manifest, as one file of a folder."""
    spark.createDataFrame([(line,) for line in text.splitlines()], "value string").coalesce(1).write.mode("errorifexists").text(path)
