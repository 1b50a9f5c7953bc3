"""A ledger of finished stages in a shared folder: what each read and made, so that another session takes up where one ended.

A stage is told by the settings and by the content of the tables it reads: their schema, number of rows and sums of row
hashes, which no order of rows or files changes, and which an overwritten file does. Its tables are written before its line
in the ledger, so that a line always has them.
"""

from __future__ import annotations

import json
import platform
import sys
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = "stage int, fingerprint string, tables map<string,string>, digests map<string,string>"


def content_digest(df: DataFrame) -> str:
    """Schema, number of rows and two order-free sums of row hashes."""
    hashes = [F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)") for seed in (1, 2)]
    row = df.agg(F.count("*"), *[F.coalesce(F.sum(h), F.lit(0)) for h in hashes]).first()
    # the form only: whether a column may hold nulls is not kept by files
    form = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{form} | {row[0]} {int(row[1])} {int(row[2])}"


@dataclass(frozen=True)
class Ledger:
    """The ledger in ``folder``, which driver and executors share."""

    folder: str

    def _read(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(LINE).json(f"{self.folder}/ledger")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return spark.createDataFrame([], LINE)
            raise

    def find(self, spark: SparkSession, stage: int, fingerprint: str) -> dict | None:
        """Table paths and digests of a stage that was done with this fingerprint."""
        found = self._read(spark).where((F.col("stage") == stage) & (F.col("fingerprint") == fingerprint)).first()
        return found.asDict() if found else None

    def keep(self, spark: SparkSession, stage: int, fingerprint: str, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """Write what a stage made, then its line; the tables as read back, and their digests."""
        paths, digests, out = {}, {}, {}
        for name, df in tables.items():
            paths[name] = f"{self.folder}/tables/{name}-{uuid.uuid4().hex}"
            df.write.parquet(paths[name])
            out[name] = self.load(spark, paths[name], df.schema)
            digests[name] = content_digest(out[name])
        spark.createDataFrame([(stage, fingerprint, paths, digests)], LINE).coalesce(1).write.mode("append").json(f"{self.folder}/ledger")
        return out, digests

    def load(self, spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions and session settings that a run was made with."""
    import numpy
    import pandas
    import pyarrow

    versions = {"python": sys.version.split()[0], "platform": platform.platform(), "spark": spark.version, "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}
    return versions | {k: str(v) for k, v in sorted(spark.sparkContext.getConf().getAll()) if k.startswith("spark.sql.") or k in ("spark.master", "spark.app.name")}


def write_run(spark: SparkSession, folder: str, settings: dict, records: list[dict], tables: dict[str, DataFrame]) -> str:
    """A folder of one run: its tables as CSV by name (lists as JSON), ``manifest`` and ``environment`` as JSON lines. Returns
    the folder; a run that ended early leaves what it has made."""
    for name, df in tables.items():
        flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    manifest = {"settings": settings, "records": records, "tables": {n: df.columns for n, df in tables.items()}}
    for name, value in (("manifest", manifest), ("environment", environment(spark))):
        spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return folder
