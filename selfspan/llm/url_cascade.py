"""URL filtering by prefix rules and a Bloom filter cascade, in DataFrame operations only.

Level 1 of the cascade is a Bloom filter of the listed hosts. Level 2 holds those unlisted hosts of the corpus that
level 1 lets through by mistake, level 3 the listed hosts that level 2 lets through, and so on until none is left. As
the levels are built against the complete set of hosts of the corpus, walking them answers membership exactly for every
host of it, from a few bits a listed host and without a join of the pages.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (host, path, verdict): a rule fits its host and all subdomains when the url's path starts with the rule's.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Keys a level may hold: at 1.44 * 4 bits a key, 24 MB. Beyond it, membership is an equi-join.
MAX_KEYS = 1 << 25
RATE = 1 / 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path) as columns; both empty where the url is null or has no ``://``."""
    u = F.col(url)
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


class Cascade:
    """Exact membership of the hosts of one universe. ``levels``: (bits, hashes, one-row DataFrame of 64-bit words)."""

    def __init__(self, levels: list[tuple[int, int, DataFrame]]):
        self.levels = levels

    @staticmethod
    def positions(key: str, level: int, bits: int, hashes: int) -> list[Column]:
        one, two = F.xxhash64(F.lit(2 * level), F.col(key)), F.xxhash64(F.lit(2 * level + 1), F.col(key))
        return [F.pmod(F.xxhash64(one, two, F.lit(i)), F.lit(bits)) for i in range(hashes)]

    @classmethod
    def passes(cls, key: str, level: int, bits: int, hashes: int, words: DataFrame) -> Column:
        found = F.lit(True)
        for p in cls.positions(key, level, bits, hashes):
            word = F.element_at(words.scalar(), (F.shiftrightunsigned(p, 6) + 1).cast("int"))
            found = found & (F.getbit(word, (p % 64).cast("int")) == 1)
        return found

    @classmethod
    def build(cls, universe: DataFrame, key: str = "key", listed: str = "listed", rate: float = RATE) -> "Cascade":
        """``universe``: one row per distinct key, with whether it is listed. Each level is a partial aggregate (bit_or)."""
        levels, inside, outside = [], universe.where(listed), universe.where(~F.col(listed))
        n = inside.count()
        while n:
            level, hashes = len(levels), max(1, round(math.log2(1 / rate)))
            bits = 64 * math.ceil(max(64, n * 1.4427 * math.log2(1 / rate)) / 64)
            words = (
                inside.select(F.explode(F.array(*cls.positions(key, level, bits, hashes))).alias("p"))
                .groupBy(F.shiftrightunsigned("p", 6).alias("i"))
                .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("w"))
            )
            dense = universe.sparkSession.range(bits // 64).select(F.col("id").alias("i")).join(words, "i", "left")
            row = materialise(dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("w", F.lit(0).cast("long")).alias("w")))), lambda x: x["w"]).alias("words")), "cascade-level")
            levels.append((bits, hashes, row))
            inside, outside = outside.where(cls.passes(key, level, bits, hashes, row)), inside
            n = inside.count()
        return cls(levels)

    def contains(self, key: str) -> Column:
        """Whether a key of the universe is listed: the first level that turns it away decides, by its parity."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(self.passes(key, level, *self.levels[level]), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def host_list(pages: DataFrame, rules=RULES) -> DataFrame:
    """(host): the block list that the rules' verdicts teach: hosts of which the rules block more pages than they allow. Pages
    that no rule fits have no say; the cascade carries the verdict of their host over to them."""
    host, path = url_parts()
    _, verdict = rule_columns(rules)
    judged = pages.select(host.alias("host"), path.alias("path")).select("host", verdict.alias("verdict"))
    return judged.groupBy("host").agg(F.count_if(F.col("verdict") == "block").alias("blocked"), F.count_if(F.col("verdict") == "allow").alias("allowed")).where("blocked > allowed").select("host")


def judge_urls(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, max_keys: int = MAX_KEYS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The longest rule that fits decides; without one, a host is blocked if the cascade holds it. ``listed``: the block
    list, a table (host) in lower case, by default ``host_list``, learned from the pages; hosts on it that no page has, null and
    repeated ones change nothing. A null url, or one without ``://``, has an empty host and path: no rule fits, and it is
    allowed unless the empty host is listed. Repeated rows are judged alike; other columns are not read; an empty table
    gives no rows. The list meets the corpus's distinct hosts in one join; the pages are never joined or shuffled. With
    more than ``max_keys`` listed hosts of the corpus the cascade has no proven size to broadcast, and pages and hosts
    are joined instead, with the same result.
    """
    host, path = url_parts()
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    chosen = (host_list(pages, rules) if listed is None else listed.select("host").where("host IS NOT NULL").distinct()).select(F.col("host").alias("key"), F.lit(True).alias("on_list"))
    hosts = parts.groupBy(F.col("host").alias("key")).agg(F.count("*").alias("n"))
    universe = materialise(hosts.join(chosen, "key", "left").select("key", F.coalesce("on_list", F.lit(False)).alias("listed")), "hosts")
    if universe.where("listed").count() <= max_keys:
        member = Cascade.build(universe).contains("host")
        judged = parts.withColumn("listed", member)
    else:
        judged = parts.join(universe.withColumnRenamed("key", "host"), "host")
    rule, verdict = rule_columns(rules)
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict")
    )
