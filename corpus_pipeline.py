"""The corpus pipeline: documents to sharded training data in five stages, each written and read again.

toxicity -> near duplicates -> benchmark decontamination -> mixing -> sharding. The first four return the columns of
``documents``; the last returns the shard and place of every row.

What holds for every stage: an empty table gives no rows; null, empty and very long texts are rows like others; further
columns are kept whatever they are called, but the last stage returns its own. A row is told from others by its doc_id
and text, so rows without a doc_id are judged one by one, and so are different texts under one doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selfspan.llm import decontam, minhash_join, mixing, slot_sharding, toxicity
from selfspan.llm.common import materialise
from selfspan.llm.queries import table

#: A document is used at most so often by the mixing stage.
REPEATS = 2.0
#: Ids with several texts up to which they are broadcast (16 bytes each); beyond, they are joined.
BROADCAST_IDS = 1 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): every row in one struct, under a number that tells its doc_id and text.

    The number is the doc_id itself, but for rows without one and for further texts of an id: these get a hash of both,
    2^62 or more, so that of a group the rows with an id of their own come first. Rows of equal doc_id and text have one
    number.
    """
    h = F.xxhash64("text")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    several = rows.where("id IS NOT NULL").groupBy(F.col("id").alias("i")).agg(F.min("h").alias("first"), F.max("h").alias("last")).where("first < last").select("i", "first")
    several = materialise(several, "ids-of-several-texts")
    side = F.broadcast(several) if several.count() <= BROADCAST_IDS else several.hint("merge")
    further = F.xxhash64(F.lit("further"), "id", "h").bitwiseAND((1 << 62) - 1) + (1 << 62)
    own = F.col("id").isNotNull() & F.coalesce(F.col("h") == F.col("first"), F.lit(True))
    return rows.join(side, F.col("id") == F.col("i"), "left").select("row", F.when(own, F.col("id")).otherwise(further).alias("doc_id"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from their labels, rejects are gone; repeated rows go or stay together.
    Without labels, or with one kind of them only, the score is the share of toxic ones, and all stay or all go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest number (see ``keyed``). Of rows equal in
    doc_id and text one stays, that of the least hash of all columns. Documents without words are near nothing, but equal
    rows of them are one."""
    rows = keyed(docs)
    kept = minhash_join.near_duplicates(rows.select("doc_id", "text")).where("kept").groupBy("doc_id").agg(F.count("*").alias("times"))
    joined = rows.join(kept.hint("merge"), "doc_id")
    once = joined.where("times = 1").select("row")
    again = joined.where("times > 1").groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return once.union(again).select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values in its slots, are gone, with or without a doc_id.
    Without benchmark items all stay."""
    rows = keyed(docs)
    leaked = decontam.leaks(rows.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return rows.join(leaked.hint("merge"), "doc_id", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: every document at least once, those of small sources again. A null source is a
    source of its own."""
    return mixing.resample(docs, repeats=REPEATS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row: shards of near equal bytes, places gapless; uses of one document share a shard unless
    they outweigh a slot."""
    return slot_sharding.shard_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("mixing", mix), ("sharding", shard)]

#: A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
