"""The corpus operators as named queries over whole tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, collision_search, decontam, epsilon_grid, middle_filling, minhash_join, mixing, slot_sharding, suffix_dedup, token_counts, toxicity, url_cascade, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 400 bytes: every byte that one covers goes.

    Null and empty texts have nothing to remove; equal rows remove each other; a null doc_id stays null. An empty table gives no rows, and other columns are not read.
    """
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of documents by source.

    Null sources are a source; null and empty texts have no tokens and are used in every whole epoch; equal rows are separate documents. An empty table gives no rows, and other columns are not read.
    """
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after a revision of every text.

    Null texts are empty; every row, repeated or without doc_id, stands for itself. An empty table gives no rows, and other columns are not read.
    """
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.sample_revision())


def op4_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates by three words and 0.85.

    Texts without words link with nothing; a row without doc_id is never linked and stays; equal rows are one document. An empty table gives no rows, and other columns are not read.
    """
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, part=85, whole=100)


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores.

    A null text is empty, its one token the end; a null doc_id counts as training; equal rows count each time. An empty table gives no rows, and other columns are not read.
    """
    return backoff_lm.score_texts(table(spark, sf_dir, "documents"))


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on urls.

    A null url has an empty host, fits no rule and is allowed; equal rows are judged alike. An empty table gives no rows, and other columns are not read.
    """
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"))


def op7_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they leak.

    Null and empty texts leak nothing; rows of one doc_id, or of none, are one document; equal items leak each. An empty table gives no rows, and other columns are not read.
    """
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every row.

    A null text has size 1; null and repeated ids are ids like others, spread where they outweigh a slot. An empty table gives no rows, and other columns are not read.
    """
    return slot_sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links among vectors of equal labels.

    Unsound vectors and rows without label or vec_id link with nothing; equal vectors link with each other. An empty table gives no rows, and other columns are not read.
    """
    return epsilon_grid.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text.

    Null and empty texts score as texts without hits; a null doc_id is scored and not held out; equal rows score alike. An empty table gives no rows, and other columns are not read.
    """
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_repeated_capture_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle rewriting of every text, with checksums of the output and of the text restored from it.

    Null and empty texts have no units and stay plain; a null doc_id draws as an empty one; equal rows give equal results; texts of any length are matched whole. An empty table gives no rows, and other columns are not read.
    """
    rewritten = middle_filling.fill_in_middle(table(spark, sf_dir, "documents"))
    checksum = lambda c: F.sha2(c.cast("binary"), 256)
    restored = middle_filling.restore(F.col("output"), F.col("form"))
    return rewritten.select("doc_id", "n", "form", "prefix_chars", "middle_chars", checksum(F.col("output")).alias("output_sha256"), checksum(restored).alias("restored_sha256"))


def op12_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows found for every row whose vec_id is divisible by 50.

    Unsound vectors and rows without vec_id take no part; ties go to the smaller vec_id; equal rows count once. An empty table gives no rows, and other columns are not read.
    """
    return collision_search.nearest_vectors(table(spark, sf_dir, "embeddings"))


def op13_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound vector on the 4 leading components of the distinct ones, whitened.

    Null vectors and vectors with null or non-finite entries are dropped; a null vec_id stays null; equal rows are one of the fit list and are each returned; components without variance are left out. An empty table gives no rows, and other columns are not read.
    """
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op11_repeated_capture_fim": op11_repeated_capture_fim,
    "op12_collision_search": op12_collision_search,
    "op13_qdwh_whitening": op13_qdwh_whitening,
    "op3_edit_token_counts": op3_edit_token_counts,
    "op2_temperature_mix": op2_temperature_mix,
    "op7_template_decontam": op7_template_decontam,
    "op10_levenshtein_toxicity": op10_levenshtein_toxicity,
    "op5_backoff_lm": op5_backoff_lm,
    "op9_epsilon_grid": op9_epsilon_grid,
    "op1_suffix_dedup": op1_suffix_dedup,
    "op4_minhash_join": op4_minhash_join,
    "op6_url_cascade": op6_url_cascade,
    "op8_slot_sharding": op8_slot_sharding,
}

ORACLE = {
    "op6_url_cascade": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), r AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM p
        )
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host IN (SELECT host FROM r GROUP BY host HAVING count(*) FILTER (rule NOT IN ('org/', 'com/fr/')) > count(*) FILTER (rule IN ('org/', 'com/fr/'))) THEN 'block' ELSE 'allow' END AS verdict
        FROM r""",
}
