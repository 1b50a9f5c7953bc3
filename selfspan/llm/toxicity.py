"""Toxicity scores from a lexicon trie searched by Levenshtein automata, with context windows for quotation.

1. The lexicon is learned: words whose documents are toxic far more often than chance allows for the vocabulary tried,
   counted over a bounded sample of labelled training rows, near copies once.
2. Every word of every text is matched against the lexicon: the automaton of the word (all strings within one edit, a
   swap of neighbours being one) walks the lexicon's trie, so all terms are tried at once. Look-alikes that the training rows show to be harmless in
   their own right are exceptions, and a term with several of them is only found as it is spelled.
3. Each hit is judged by the window around it: within quotation marks, or near a word of reporting, it counts as quoted.
4. A logistic model over the counts of hits (exact or misspelled, quoted or not) gives the score. It is fitted on counts
   of rows by feature values, a table whose size does not depend on the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_long, crc_mod, materialise, mix, shingle_set, word_hashes

FOLDS, HELD_OUT = 5, 0
#: Labelled rows that the lexicon and the model are learned from, at most (those of least hash).
SAMPLE_ROWS = 50_000
#: Terms of this length or more are also found misspelled, by one edit, in words of this length or more.
FUZZY_LENGTH = 4
#: Harmless look-alikes from which on a term is not found misspelled.
CROWDED = 3
#: Share of a term's documents that must be toxic.
PRECISION = 0.8
#: Tokens to each side that decide whether a hit is quoted.
WINDOW = 6
#: Words of reporting, in the four languages of the corpus.
REPORTING = frozenset(
    "said says wrote writes quoted quote quoting called calls reported cited "
    "dit disait écrit cité citation appelé dijo escribió citó cita llamó sagte schrieb zitierte zitat nannte".split()
)
QUOTES = "\"“”„«»‹›"
TOKEN = re.compile(r"[\w@$*']+|[" + QUOTES + "]")
#: Counts of exact hits, of misspelled ones, and of the quoted ones among each.
FEATURES = ("exact", "fuzzy", "exact_quoted", "fuzzy_quoted")


class Trie:
    """A lexicon as nested dicts; the key '' marks the end of a term and holds it."""

    def __init__(self, terms):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = term

    def within_one(self, word: str) -> list[str]:
        """Terms at most one edit from ``word``: the word's Levenshtein automaton intersected with the trie.

        A state of the automaton is (letters of the word read, edits made), or (letters read, 2) within a swap, when the
        term has had the word's next letter but one and must go on with the next; from a set of states the trie's next
        letter leads to another set, and a branch is left when its set is empty.
        """
        n, found = len(word), []
        stack = [(self.root, self._close({(0, 0)}, n))]
        while stack:
            node, states = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    if any(i == n and e < 2 for i, e in states):
                        found.append(child)
                    continue
                step = set()
                for i, e in states:
                    if i < n and word[i] == ch:
                        step.add((i + 2, 1) if e == 2 else (i + 1, e))
                    if e == 0:
                        if i + 1 < n and word[i + 1] == ch:
                            step.add((i, 2))  # its letters swapped
                        step.add((i, 1))  # the term has a letter more
                        if i < n:
                            step.add((i + 1, 1))  # another letter
                if step:
                    stack.append((child, self._close(step, n)))
        return found

    @staticmethod
    def _close(states: set, n: int) -> set:
        """Also skip a letter of the word."""
        return states | {(i + 1, 1) for i, e in states if e == 0 and i < n}


class Matcher:
    """Which words are hits: 1 exact, 2 misspelled, 0 none. Remembers what it has judged, up to a bounded number of words."""

    MEMORY = 1_000_000

    def __init__(self, terms: list[str], harmless: frozenset[str] = frozenset(), crowded: frozenset[str] = frozenset()):
        self.exact, self.harmless = frozenset(terms), harmless
        fuzzy = [t for t in terms if len(t) >= FUZZY_LENGTH and t not in crowded]
        self.trie = Trie(fuzzy)
        # one edit leaves the first two letters or the last two of a term of four or more in place, or else swaps the middle
        # of four
        self.heads, self.tails = frozenset(t[:2] for t in fuzzy), frozenset(t[-2:] for t in fuzzy)
        self.frames = frozenset(t[0] + t[3] for t in fuzzy if len(t) == 4)
        self.lengths = frozenset(n for t in fuzzy for n in range(max(FUZZY_LENGTH, len(t) - 1), len(t) + 2))
        self.clean: set[str] = set()
        self.hits: dict[str, int] = {t: 1 for t in terms}

    def judge(self, word: str) -> int:
        if word in self.exact:
            return 1
        if word in self.harmless or len(word) not in self.lengths:
            return 0
        near = word[:2] in self.heads or word[-2:] in self.tails or (len(word) == 4 and word[0] + word[3] in self.frames)
        return 2 if near and self.trie.within_one(word) else 0

    def found(self, words: set[str]) -> set[str]:
        """Those of the words that are hits."""
        for word in words - self.clean:
            if word not in self.hits:
                if k := self.judge(word):
                    self.hits[word] = k
                else:
                    self.clean.add(word)
        if len(self.clean) > self.MEMORY:
            self.clean.clear()
        if len(self.hits) > self.MEMORY:
            self.hits = {t: 1 for t in self.exact}
            return {w for w in words if self.judge(w)}
        return words & self.hits.keys()

    def features(self, text: str | None) -> tuple[int, int, int, int]:
        tokens = TOKEN.findall((text or "").lower())
        hits = self.found(set(tokens))
        out = [0, 0, 0, 0]
        if hits:
            marks = np.cumsum([t in QUOTES for t in tokens])
            for i, t in enumerate(tokens):
                if t in hits:
                    kind = 0 if t in self.exact else 1
                    low, high = max(0, i - WINDOW), i + WINDOW + 1
                    around = tokens[low:high]
                    # a mark on each side within the window, the number of marks before it odd; or a word of reporting
                    quoted = (marks[i] % 2 == 1 and any(x in QUOTES for x in tokens[low:i]) and any(x in QUOTES for x in tokens[i + 1 : high])) or not REPORTING.isdisjoint(around)
                    out[kind] += 1
                    out[2 + kind] += quoted
        return tuple(out)


#: MinHash coordinates, of which near copies share one at least, mostly.
PRINTS = ("one", "two", "three", "four")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MinHash coordinates of each text."""
    for batch in batches:
        sets = [shingle_set(word_hashes(t), 3) for t in batch.column("text").to_pylist()]
        prints = [np.array([mix(s ^ np.uint64(0x70C51C * (k + 1))).min() if len(s) else 0 for s in sets], np.uint64) for k in range(len(PRINTS))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array(as_long(p)) for p in prints)], ["doc_id", "toxic", *PRINTS])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic documents, documents), combined over each batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for word in set(TOKEN.findall((text or "").lower())):
                c = counts.setdefault(word, [0, 0])
                c[0] += toxic
                c[1] += 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c[0] for c in counts.values()]), pa.array([c[1] for c in counts.values()])], ["word", "t", "n"])


def _look_alikes(batches: Iterator[pa.RecordBatch], matcher) -> Iterator[pa.RecordBatch]:
    """Words one edit from a term, with those terms."""
    m = matcher.value
    for batch in batches:
        words = batch.column("word").to_pylist()
        keep = [m.judge(w) == 2 for w in words]
        like = [m.trie.within_one(w) for w, k in zip(words, keep, strict=True) if k]
        part = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(like, pa.list_(pa.string()))], ["word", "t", "n", "terms"])


def _features(batches: Iterator[pa.RecordBatch], matcher) -> Iterator[pa.RecordBatch]:
    m = matcher.value
    for batch in batches:
        cols = list(zip(*(m.features(t) for t in batch.column("text").to_pylist()), strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, pa.int32()) for c in cols)], ["row", *FEATURES])


def count_hits(docs: DataFrame, matcher) -> DataFrame:
    """(row, counts of hits): every row as it is, in one struct, whatever its columns are called. ``matcher``: broadcast."""
    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(f, T.IntegerType()) for f in FEATURES)])
    return docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _features(b, matcher), schema)


def fit_logistic(x: np.ndarray, n: np.ndarray, t: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights (the first is the constant's) of a ridge logistic model for ``t`` successes of ``n`` in each row of ``x``; Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + penalty, x.T @ (t - n * p) - penalty @ w)
        w = w + step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def inputs(exact, fuzzy, exact_quoted, fuzzy_quoted) -> list:
    """The model's inputs from the counts, for arrays and for columns alike: any hit, the logarithm of how many, none of
    them as spelled, all of them quoted. What training rows do not show stays near 0: a misspelled hit then counts as a hit."""
    hits, quoted = exact + fuzzy, exact_quoted + fuzzy_quoted
    tests = [hits > 0, (hits > 0) & (exact == 0), (hits > 0) & (quoted >= hits)]
    any_hit, fuzzy_only, all_quoted = (F.when(c, 1.0).otherwise(0.0) if isinstance(c, Column) else c * 1.0 for c in tests)
    return [any_hit, F.log1p(hits) if isinstance(hits, Column) else np.log1p(hits), fuzzy_only, all_quoted]


class Toxicity:
    """What is learned: terms, harmless look-alikes, terms with many of them, weights."""

    def __init__(self, terms: list[str], harmless: list[str], crowded: list[str], weights: list[float]):
        self.terms, self.harmless, self.crowded, self.weights = terms, harmless, crowded, weights

    def matcher(self, spark: SparkSession):
        return spark.sparkContext.broadcast(Matcher(self.terms, frozenset(self.harmless), frozenset(self.crowded)))

    @staticmethod
    def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
        """(doc_id, toxic) of at most ``rows`` labelled training rows, near copies once: a table that may be broadcast."""
        known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(crc_mod("doc_id", FOLDS) != HELD_OUT)
        chosen = materialise(
            known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled"
        )
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
        once = texts.mapInArrow(_fingerprints, "doc_id long, toxic int, " + ", ".join(f"{p} long" for p in PRINTS))
        for p in PRINTS:
            once = once.groupBy(p, "toxic").agg(F.min_by(F.struct("doc_id", *PRINTS), F.struct("doc_id", *PRINTS)).alias("s")).select("toxic", "s.*")
        return materialise(once.select("doc_id", "toxic").distinct(), "labelled-once")

    @classmethod
    def learn(cls, docs: DataFrame, labels: DataFrame) -> "Toxicity":
        spark = docs.sparkSession
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        chosen = cls.sample(docs, labels)
        toxic, rows = (x or 0 for x in chosen.agg(F.sum("toxic"), F.count("*")).first())
        terms, harmless, crowded = [], [], frozenset()
        if 0 < toxic < rows:
            rate = toxic / rows
            words = materialise(
                texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic").mapInArrow(_word_counts, "word string, t long, n long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n")), "word-counts"
            )
            bar = log10(max(1, words.count())) + 2
            share = (F.col("t") / F.col("n"))
            benign = F.col("n") - F.col("t")
            # Chernoff's bound on the chance of so many toxic documents at the overall rate, in decimal orders
            evidence = F.col("t") * F.log10(share / rate) + F.when(benign > 0, benign * F.log10((benign / F.col("n")) / (1 - rate))).otherwise(0.0)
            strong = words.where((F.col("t") > 0) & (share >= max(PRECISION, rate)) & (F.length("word") > 1)).withColumn("evidence", evidence).where(F.col("evidence") > bar)
            terms = sorted(r["word"] for r in strong.select("word").collect())  # at most the words of SAMPLE_ROWS texts' toxic ones
            seen = spark.sparkContext.broadcast(Matcher(terms))
            near = words.mapInArrow(lambda b: _look_alikes(b, seen), "word string, t long, n long, terms array<string>").where((F.col("t") + 1.8) / (F.col("n") + 2) < 0.7)
            rows_near = near.select("word", "terms").collect()  # within one edit of a term
            harmless = sorted(r["word"] for r in rows_near)
            alike = Counter(t for r in rows_near for t in r["terms"])
            crowded = frozenset(t for t, k in alike.items() if k >= CROWDED)
        model = cls(terms, harmless, sorted(crowded), [-30.0, 0.0, 0.0, 0.0, 0.0])
        if rows:
            found = count_hits(texts.join(F.broadcast(chosen), "doc_id"), model.matcher(spark))
            table = found.groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("row.toxic").alias("t")).toPandas()
            if len(table):
                x = np.column_stack(inputs(*table[list(FEATURES)].to_numpy(float).T))
                model.weights = [float(v) for v in fit_logistic(x, table["n"].to_numpy(float), table["t"].to_numpy(float))]
        return model

    def score(self):
        """Column: probability of the label from the feature columns."""
        total = F.lit(self.weights[0])
        for w, x in zip(self.weights[1:], inputs(*(F.col(f) for f in FEATURES)), strict=True):
            total = total + F.lit(w) * x
        return 1 / (1 + F.exp(-total))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the counts of hits.

    Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0. Scores come from the text alone. A null
    or empty text has no hits and gets the score of a text without hits; so does every text when nothing could be
    learned (no labels, or only one kind), and that score is then the share of toxic rows, or next to 0 without rows. A null
    doc_id is scored and not held out. Repeated rows are scored alike. An empty table gives no rows.
    """
    model = Toxicity.learn(docs, labels)
    found = count_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model.matcher(docs.sparkSession)).withColumn("score", model.score())
    return found.withColumn("doc_id", F.col("row.doc_id")).select(
        "doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *FEATURES
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, all columns kept whatever they are called; see score_toxicity
    for odd rows."""
    model = Toxicity.learn(docs, labels)
    return count_hits(docs, model.matcher(docs.sparkSession)).where(model.score() < threshold).select("row.*")
