"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power of an exponent from 0 (equal weights) to 1 (as they are). The
exponent is bisected until the weights' entropy reaches a target share of the greatest possible, or down to where the
most repeated source meets a limit of repetitions, whichever is higher.

The budget in tokens is dealt to the sources by weight. A source's documents are permuted anew in every epoch (one pass
over all of them) and taken until its quota is full; whole epochs come first, so with the default budget every document
is used at least once. The stream of a source is cut into blocks of equal quota, and each block holds every source in
its target weight, but for the one document of each source that may stand across its edge: blocks are so large that these
make up an eighth of one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Entropy of the weights to reach, as a share of that of equal weights: so near to 1, the limit of repetitions decides
#: wherever sources differ much, and the weights are made equal where they do not.
ENTROPY = 0.9999
#: Times that a document may be used at most.
REPEATS = 4.0
#: Tokens in a block, at least; and how many times the longest documents of all sources together a block holds at least.
BLOCK_TOKENS, LONGEST = 1 << 20, 8
#: Sources up to which their plan is broadcast to the documents (at 100 bytes each, 26 MB); beyond, it is joined.
BROADCAST_SOURCES = 1 << 18
#: Bisection steps that one job makes: it evaluates 2^STEPS - 1 exponents at once over the source table.
STEPS, JOBS = 5, 8
#: Documents of a source in one piece of its permutation, about: what one task orders.
PIECE = 4_096


def token_count(text: str = "text") -> Column:
    """Words of a text: runs of characters other than space and 09-0D; null has none."""
    one_each = F.regexp_replace(F.regexp_replace(F.col(text), r"[^\x20\x09-\x0D]+", "a"), r"[\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(one_each), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame) -> DataFrame:
    """(source, tokens, rows, longest) of documents that have ``source`` and ``tokens``."""
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.max("tokens").alias("longest"))


def solve_exponent(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The greatest exponent whose weights reach ``entropy``, but no less than keeps within ``repeats``.

    With the budget that uses the least repeated source once, a source's repeats are its share over the greatest share,
    to the power of exponent - 1. Both conditions are monotone, so each job halves the interval STEPS times; only sums
    over the sources reach the driver.
    """
    known = sources.where("tokens > 0")
    total, most, count = known.agg(F.sum("tokens"), F.max("tokens"), F.count("*")).first()
    if not total or count < 2:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))
    low, high = 0.0, 1.0
    cells = 1 << STEPS
    for _ in range(JOBS):
        grid = [low + (high - low) * k / cells for k in range(cells + 1)]
        power = known.select(F.explode(F.array(*[F.lit(a) for a in grid])).alias("a"), p.alias("p"), (F.col("tokens") / F.lit(float(most))).alias("q"))
        # entropy of w = p^a / z is log z - a * sum(p^a log p) / z
        sums = power.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("s"), F.max(F.pow("q", F.col("a") - 1)).alias("r"))
        rows = {r["a"]: r for r in sums.withColumn("h", (F.log("z") - F.col("a") * F.col("s") / F.col("z")) / F.log(F.lit(float(count)))).collect()}
        # flat enough, or flatter than the limit of repeats allows: go up
        fits = [a for a in grid if rows[a]["h"] >= entropy or rows[a]["r"] > repeats]
        low = max(fits, default=grid[0])
        if low >= grid[-1]:
            return high
        high = grid[grid.index(low) + 1]
        if high - low < 1e-12:
            break
    return high if low > 0 and rows[low]["r"] > repeats else low


def weights(sources: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """(source, tokens, rows, longest, weight, quota, blocks): ``budget`` tokens dealt by weight; by default as many as use
    every document of the least repeated source once. Sources without tokens get weight 0 and are used once. The sums
    over all sources are one row, joined back."""
    raw = sources.withColumn("x", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent))).otherwise(0.0))
    sums = raw.agg(F.sum("x").alias("z"), F.max(F.when(F.col("x") > 0, F.col("tokens") / F.col("x"))).alias("most"), F.sum("longest").alias("edges"))
    amount = F.lit(budget) if budget is not None else F.coalesce(F.col("most") * F.col("z"), F.lit(0.0))
    weighed = raw.crossJoin(F.broadcast(sums)).withColumn("weight", F.coalesce(F.try_divide("x", "z"), F.lit(0.0))).withColumn("amount", amount)
    blocks = F.greatest(F.lit(1), F.floor(F.col("amount") / F.greatest(F.lit(BLOCK_TOKENS), LONGEST * F.col("edges")))).cast("int")
    return weighed.select(*sources.columns, "weight", (F.col("weight") * F.col("amount")).alias("quota"), blocks.alias("blocks"))


def schedule(docs: DataFrame, plan: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    """Rows of ``docs`` (with ``source`` and ``tokens``) as often as the plan uses them, with ``epoch`` and ``block``.

    A row is used in an epoch if the tokens before it in the epoch's permutation leave room in the quota. Whole epochs
    need no order; the last, partial one is cut by running sums, taken in two levels: over pieces of a source, of about
    PIECE documents each, and within a piece. A hot source only has more pieces than others.
    """
    # a source's repeats, to within rounding, so that a quota of whole epochs does not start another
    uses = F.when(F.col("tokens_of") > 0, F.col("quota") / F.col("tokens_of")).otherwise(1.0)
    sized = plan.select(F.col("source").alias("of"), F.col("tokens").alias("tokens_of"), "quota", "blocks", F.greatest(F.lit(1), F.ceil(F.col("rows") / PIECE)).cast("long").alias("pieces"))
    sized = F.broadcast(sized) if plan.count() <= BROADCAST_SOURCES else sized.hint("merge")
    rows = docs.join(sized, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    epochs = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(uses - 1e-9) - 1).cast("int"))))
    spot = epochs.withColumn("shuffled", F.xxhash64(F.lit(seed), "epoch", *key)).withColumn("piece", F.pmod(F.col("shuffled"), F.col("pieces")))
    at = ["source", "epoch", "piece"]
    # the sizes of the pieces, a table of about rows / PIECE entries
    pieces = spot.groupBy(*at).agg(F.sum("tokens").alias("piece_tokens"))
    before = pieces.withColumn("before", F.coalesce(F.sum("piece_tokens").over(Window.partitionBy("source", "epoch").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(*at).orderBy("shuffled", *key).rowsBetween(Window.unboundedPreceding, -1)
    placed = spot.withColumn("earlier", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("a").join(
        before.drop("piece_tokens").alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in at]
    ).select("a.*", "b.before")
    start = F.col("epoch") * F.col("tokens_of") + F.col("before") + F.col("earlier")
    kept = placed.withColumn("start", start).where((F.col("start") < F.col("quota") - 1e-6) | ((F.col("epoch") == 0) & (F.col("tokens_of") == 0)) | ((F.col("epoch") == 0) & (F.col("tokens") == 0)))
    block = F.least(F.col("blocks") - 1, F.floor(F.coalesce(F.try_divide(F.col("start") * F.col("blocks"), F.col("quota")), F.lit(0.0)))).cast("int")
    return kept.withColumn("block", block).drop("pieces", "piece", "earlier", "before", "start", "tokens_of", "blocks")


def plan_of(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> tuple[DataFrame, float]:
    sources = materialise(source_tokens(docs), "sources")
    exponent = solve_exponent(sources, entropy, repeats)
    return weights(sources, exponent, budget), exponent


def mix_sources(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, seed: int = 0) -> DataFrame:
    """One row per use of a document: doc_id, source, tokens, weight, epoch, block, place.

    ``weight`` is the source's target weight; ``place`` orders a block. A small corpus is a single block. A null source is a source of its own; null or
    empty texts have no tokens, are used in every whole epoch and cost nothing. Repeated rows and null ids are separate
    documents. Only ``doc_id``, ``text`` and ``source`` are read. An empty table gives no rows.
    """
    rows = materialise(docs.select("doc_id", "source", token_count().alias("tokens"), F.xxhash64("text").alias("h")), "mix-tokens")
    plan, _ = plan_of(rows, entropy, repeats, budget)
    plan = materialise(plan, "mix-plan")
    used = schedule(rows, plan, ["doc_id", "h"], seed)
    share = plan.select(F.col("source").alias("of"), "weight")
    return used.join(share, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "tokens", "weight", "epoch", "block", F.xxhash64(F.lit(seed + 1), "block", "shuffled").alias("place"))


def resample(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, seed: int = 0) -> DataFrame:
    """``docs`` with every row as often as the schedule uses it (at least once), all columns kept, whatever they are called.

    The schedule is made over ids and token counts; texts are dealt out once, to meet their number of uses. Rows with
    equal doc_id, source and text are one document and used together. Null ids and sources are values like others; null
    and empty texts have no tokens and are used in every whole epoch. An empty table gives no rows.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("source"), F.xxhash64("text").alias("h"), token_count().alias("tokens"))
    key = ["id", "h"]
    rows = materialise(keyed.groupBy(*key, "source").agg(F.first("tokens").alias("tokens")), "mix-tokens")
    plan = materialise(plan_of(rows, entropy, repeats)[0], "mix-plan")
    uses = schedule(rows, plan, key, seed).groupBy(*key, "source").agg(F.count("*").cast("int").alias("uses"))
    d, u = keyed.drop("tokens").alias("d"), uses.hint("merge").alias("u")
    joined = d.join(u, (F.col("d.h") == F.col("u.h")) & F.col("d.id").eqNullSafe(F.col("u.id")) & F.col("d.source").eqNullSafe(F.col("u.source")))
    return joined.select("d.row", F.explode(F.sequence(F.lit(1), F.col("u.uses"))).alias("use")).select("row.*")
