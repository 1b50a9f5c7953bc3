"""Benchmark decontamination by template windows, in DataFrame operations only.

Texts become templates: numbers, names (capitalised words within a sentence) and units turn into typed placeholders,
the rest is lower-cased words without punctuation. Windows of a benchmark item's template are hash-joined with those of
the documents, so a question with other numbers or names in it still meets its original. Where placeholders matched,
the slots are checked: within one alignment of item and document, equal values of the item must stand for equal values
of the document, or the windows that hold them do not count. Windows are also joined by their lower-cased words and
values, so a literal copy meets its original however few plain words it has and however it is cased or wrapped.

Only hashes are kept of the tokens, once as the template has them and once with their values, so the slots are compared
without a second look at the texts. The windows of a benchmark of proven size are broadcast to the documents, which then
are never shuffled; beyond that size both sides are dealt out by window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Tokens in a window; an item with fewer is one window.
WINDOW = 8
#: An item of fewer tokens is no evidence within a text: only a text that is nothing else leaks it.
SHORT = 4
#: Share of an item's windows, or number of them, that make a leak; at least LEAST of them where the item has so many.
SHARE, ENOUGH, LEAST = 0.25, 12, 3
#: Windows of a benchmark that are broadcast at most, by either hash: 200 bytes each.
BROADCAST_WINDOWS = 1 << 20
#: Starts every placeholder; a letter that ordinary text does not use.
MARK = "ꙮ"
UNITS = "km|cm|mm|m|mi|ft|kg|g|mg|lb|oz|l|ml|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|dollars?|euros?|cents?|percent|usd|eur"


def marked(text: Column) -> Column:
    """The lower-cased text with every number, name and unit in a placeholder that carries it in brackets."""
    s = F.translate(text, f"{MARK}⟦⟧", "   ")
    s = F.regexp_replace(s, r"(\p{N}+(?:[.,:/]\p{N}+)*)", f" {MARK}num⟦$1⟧ ")
    # what stands before a capital is looked at only where there is one
    s = F.regexp_replace(s, r"(\p{Lu}(?<=[\p{L},;⟧] \p{Lu})\p{L}*)", f"{MARK}name⟦$1⟧")
    s = F.lower(s)
    return F.regexp_replace(s, rf"({MARK}num⟦[^⟧]*⟧ {{1,2}})((?:{UNITS})(?![\p{{L}}\p{{N}}])|[%$€£°])", f"$1{MARK}unit⟦$2⟧")


def template(marked_text: Column) -> Column:
    """Tokens of the template; placeholders carry what they stand for in brackets."""
    return F.regexp_extract_all(marked_text, F.lit(rf"({MARK}(?:num|name|unit)⟦[^⟧]*⟧|[\p{{L}}]+)"), F.lit(1))


def hashed_tokens(rows: DataFrame, key: str) -> DataFrame:
    """(key, plain, full): hashes of the template's tokens, and of the lower-cased words and values as they stand."""
    tokens = rows.where("text IS NOT NULL").select(key, marked(F.col("text")).alias("s")).select(key, F.contains("s", F.lit(MARK)).alias("slotted"), template(F.col("s")).alias("v"))
    value = "if(slotted, transform(v, x -> xxhash64(if(contains(x, '⟦'), rtrim('⟧', split_part(x, '⟦', 2)), x))), transform(v, x -> xxhash64(x)))"
    full = tokens.select(key, "slotted", "v", F.expr(value).alias("full"))
    plain = "if(slotted, transform(v, x -> xxhash64(split_part(x, '⟦', 1))), full)"
    return full.select(key, F.expr(plain).alias("plain"), "full")


def windows_of(tokens: DataFrame, key: str, length: int) -> DataFrame:
    """(key, at, h, g, p, f) of every window of ``length`` tokens: its hashes without and with the values, and those of
    its tokens. Shifted copies of the token array are zipped and exploded, which stays in generated code."""
    shifted = [F.expr(f"slice({side}, {k + 1}, size(plain) - {length - 1})").alias(f"{side[0]}{k}") for side in ("plain", "full") for k in range(length)]
    rows = tokens.where(F.size("plain") >= length).select(key, F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
    p, f = ([F.col(f"w.{side}{k}") for k in range(length)] for side in "pf")
    return rows.select(key, "at", F.xxhash64(F.lit(length), *p).alias("h"), F.xxhash64(F.lit(length), *f).alias("g"), F.array(*p).alias("p"), F.array(*f).alias("f"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, item_at, h, item_f, slots, typed, length, total, typed_total, templated): all windows of the items by the hash with
    their values; ``typed`` ones, with at least half of their tokens plain words, by the hash without them as well (``templated``).
    ``slots`` are the places (k) and values of the other tokens."""
    tokens = materialise(hashed_tokens(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), "item_id"), "benchmark-tokens")
    marks = F.array(*[F.xxhash64(F.lit(f"{MARK}{kind}")) for kind in ("num", "name", "unit")])
    found = None
    for length in range(1, window + 1):
        own = tokens.where((F.size("plain") == length) if length < window else (F.size("plain") >= length))
        part = windows_of(own, "item_id", length).withColumn("length", F.lit(length)).withColumn("marks", marks)
        found = part if found is None else found.union(part)
    slots = F.expr("transform(filter(sequence(0, length - 1), k -> array_contains(marks, p[k])), k -> struct(k, xxhash64(p[k], f[k]) AS item_value))")
    rows = found.withColumn("slots", slots).withColumn("typed", F.expr("size(slots) * 2 <= length"))
    own = Window.partitionBy("item_id")
    keys = F.array_distinct(F.when(F.col("typed"), F.array("g", "h")).otherwise(F.array("g")))
    return rows.select(
        "item_id", F.col("at").alias("item_at"), F.col("f").alias("item_f"), "slots", "typed", F.col("h").alias("template_hash"), "length", F.count("*").over(own).alias("total"), F.count_if("typed").over(own).alias("typed_total"), keys.alias("keys")
    ).withColumn("h", F.explode("keys")).withColumn("templated", F.col("typed") & (F.col("h") == F.col("template_hash"))).drop("keys", "template_hash")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, enough: int = ENOUGH, least: int = LEAST) -> DataFrame:
    """One row per document and item it leaks: doc_id, item_id, windows (of the item), hits, literal_hits.

    A window is met with the very same words and values, whatever their case and spacing (``literal_hits``), or, where at
    least half of its tokens are plain words, with other values. Where an alignment maps one value of the item to two of
    the document, its windows that hold this value are not sound; ``hits`` are the item's windows met soundly or
    literally. An item of fewer than SHORT tokens is leaked only by a text of nothing else. A pair is a leak if the sound windows reach ``share`` of the windows (or those of plain words ``share`` of
    theirs) or ``enough``, and ``least`` where the item has that many, or if ``enough`` windows are literal. Null or
    empty texts and items without words match nothing; rows of one doc_id (null too) are one document; repeated items
    each match. Only ``doc_id``, ``text`` and ``item_id`` are read. Without documents or items there are no rows.
    """
    wanted = materialise(benchmark_windows(benchmark, window), "benchmark-windows")
    lengths = sorted(r[0] for r in wanted.select("length").distinct().collect()) or [window]  # 1 to window
    tokens = hashed_tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")
    small = wanted.count() <= BROADCAST_WINDOWS
    met = None
    for length in lengths:
        item = wanted.where(F.col("length") == length).drop("length")
        keyed = windows_of(tokens if length >= SHORT else tokens.where(F.size("plain") == length), "doc_id", length).select("doc_id", "at", "f", F.explode(F.when(F.col("h") == F.col("g"), F.array("g")).otherwise(F.array("g", "h"))).alias("h"))
        part = keyed.join(F.broadcast(item) if small else item.hint("merge"), "h").select(
            "doc_id", "item_id", "total", "typed_total", "typed", "templated", "item_at", (F.col("at") - F.col("item_at")).alias("offset"), (F.col("f") == F.col("item_f")).alias("literal"),
            F.expr("transform(slots, s -> struct(s.item_value AS item_value, f[s.k] AS value))").alias("slots"),
        )
        met = part if met is None else met.union(part)
    met = materialise(met, "window-hits")
    pair = ["doc_id", "item_id", "total", "typed_total"]
    aligned = [*pair, "offset"]
    # a slot value of the item maps to one value of the document within an alignment, or windows that hold it do not count;
    # only what was met as a template tells, so that further literal windows take no hit away
    slots = met.where("templated").select(*aligned, F.inline("slots")).groupBy(*aligned, "item_value").agg((F.min("value") != F.max("value")).alias("torn"))
    torn = slots.where("torn").groupBy(*aligned).agg(F.collect_set("item_value").alias("torn"))
    on = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in aligned]
    sound = ~F.coalesce(F.arrays_overlap(F.expr("transform(m.slots, s -> s.item_value)"), F.col("s.torn")), F.lit(False))
    judged = met.alias("m").join(torn.alias("s"), on, "left").select(*[f"m.{c}" for c in (*pair, "item_at", "typed", "literal")], sound.alias("sound"))
    windows = judged.groupBy(*pair, "item_at", "typed").agg(F.max("literal").alias("literal"), F.max("sound").alias("sound"))
    hits = windows.groupBy(*pair).agg(
        F.count_if(F.col("sound") | F.col("literal")).alias("hits"), F.count_if("literal").alias("literal_hits"), F.count_if("sound").alias("all_sound"), F.count_if(F.col("sound") & F.col("typed")).alias("typed_sound")
    )

    def reached(n: str, total: str) -> Column:
        return (F.col(n) > 0) & (F.col(n) >= F.least(F.col(total), F.lit(least))) & ((F.col(n) >= share * F.col(total)) | (F.col(n) >= enough))

    return hits.where(reached("all_sound", "total") | reached("typed_sound", "typed_total") | (F.col("literal_hits") >= max(enough, least))).select(
        "doc_id", "item_id", F.col("total").alias("windows"), "hits", "literal_hits"
    )
