"""Fill-in-the-middle rewriting of texts by repeated-capture matching.

One ``fullmatch`` of ``(unit)*`` matches a whole text; the regex library keeps every repetition of the group, so the list
of its ends holds the number of units and, by two look-ups, both cuts. Nothing walks over the units. Only this step runs
in Python, on Arrow batches; the choice of form, the pieces and the joined outputs are column expressions.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word with the white space before it, or white space that ends the text. The classes share no character, so nothing is
#: ever given back, and possessive quantifiers keep long texts from piling up states to return to.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
CUTS = "n long, first long, second long"


def _cuts(unit: str):
    """(text, a, b) -> the number of units, and the places, in code points, after the smaller and the larger of a and b
    modulo one more than that number."""
    pattern = regex.compile(f"({unit})*+")

    @F.arrow_udf(CUTS)
    def cuts(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        counts, firsts, seconds = [], [], []
        for t, x, y in zip(text.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True):
            found = pattern.fullmatch(t)
            if found is None:
                raise ValueError("the unit does not cover every text")
            ends = found.ends(1)
            n = len(ends)
            low, high = sorted((x % (n + 1), y % (n + 1)))
            counts.append(n)
            firsts.append(ends[low - 1] if low else 0)
            seconds.append(ends[high - 1] if high else 0)
        return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (counts, firsts, seconds)], ["n", "first", "second"])

    return cuts


def _draw(digest: Column, at: int) -> Column:
    """The ``at``-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * at + 1, 8), 16, 10).cast("long")


def fill_in_middle(documents: DataFrame, seed: int = 42, kept_share: int = 50, spm_share: int = 80, unit: str = UNIT, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row.

    Draws come from the sha256 of ``seed:doc_id``, so a row's result depends on nothing but its own doc_id and text. Of
    100 texts, ``kept_share`` are rewritten, ``spm_share`` of 100 rewritten ones with the suffix first. A text that is
    empty or holds a sentinel stays plain, so that ``restore`` is exact.

    A null text is empty, has no units and stays plain. A null doc_id draws as an empty one; rows that repeat give equal
    results. Texts of any length are matched whole. An empty table gives no rows; other columns are not read.
    """
    p, s, m = sentinels
    text, digest = F.coalesce("text", F.lit("")), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = documents.select("doc_id", text.alias("text"), *[_draw(digest, i).alias(f"h{i + 1}") for i in range(4)])
    cut = drawn.select("*", _cuts(unit)("text", "h1", "h2").alias("c")).select("*", "c.*")
    marked = F.lit(False)
    for mark in sentinels:
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= kept_share), "plain").when(F.col("h4") % 100 < spm_share, "spm").otherwise("psm")
    prefix = F.substring("text", F.lit(1), F.col("first").cast("int"))
    middle = F.substring("text", F.col("first").cast("int") + 1, (F.col("second") - F.col("first")).cast("int"))
    suffix = F.substring("text", F.col("second").cast("int") + 1, F.lit(2**31 - 1))
    rewritten = cut.withColumn("form", form)
    return rewritten.select(
        "doc_id",
        "n",
        "form",
        F.when(F.col("form") != "plain", F.col("first")).alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("second") - F.col("first")).alias("middle_chars"),
        F.when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
        .otherwise(F.col("text"))
        .alias("output"),
    )


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that was rewritten, from the output and its form alone. Sentinels start with a character that they hold
    nowhere else, and rewritten texts hold none, so the output has exactly the three that were put in."""
    parts = F.split(output, "|".join(re.escape(mark) for mark in sentinels), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
