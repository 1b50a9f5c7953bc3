"""Language-model scores from a weighted backoff automaton of smoothed bigrams.

States are the root, the start of a text and every word of the training texts. A state's arcs are its bigrams seen in
training, weighted by their discounted relative frequency plus the backed-off share; its failure arc leads to the root and
weighs log10 of the mass the discount has freed. The discount is what the numbers of bigrams seen once and twice say, n1 /
(n1 + 2 n2). The root has an arc for every word, weighted by add-one unigrams. A text is read once from left to right: each
token takes the state's arc, or the failure arc and the root's, and the sum of weights is its log10 probability.

Texts are dealt into blocks of bounded size; a block asks for its words and bigrams, packed into one row a bucket of
hashes. A bucket sums its keys over all blocks and answers each with the slice of the automaton that its texts can touch.
A word's bigrams lie in the word's bucket, which thus knows the mass freed; only those of common words (``COMMON_SHARE``
of all training tokens or more, so at most 1 / COMMON_SHARE of them however large the corpus) and of the start are spread
over all buckets. Common words' counts are broadcast, and their masses go to every block. Most bigrams are seen once, and
then a block that has it in its own training texts needs no answer to know: only counts of two and more are sent, and of
one to blocks that have the bigram in held-out texts alone.

A row's block is a hash of its doc_id and text, so a lost task deals its rows as before. Rows that are equal in both and
together fill a good part of a block are read as one, with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, crc_mod, materialise, mix, word_hashes

FOLDS, HELD_OUT = 7, 2
#: A word with this share of the training tokens or more is common: its count is broadcast, its bigrams are spread out.
COMMON_SHARE = 4e-6
#: Text in a block, in bytes.
BLOCK_BYTES = 24 << 20
#: Tokens of a block that are held before they are counted or scored.
HOLD = 1 << 20
#: Codes of the end of a text and of its start; word hashes of that value do not matter.
END, START = np.uint64(0xE0D), np.uint64(0x57A27)
START_OF = np.array([START])
#: Equal rows of so many bytes together are read as one: there are fewer than the corpus's size over this.
HEAVY_BYTES = BLOCK_BYTES // 8
#: Rows that one row of a result stands for at most, until they are dealt out.
TOGETHER = 4096
#: States under which the numbers of bigrams seen once and twice come with the masses.
ONCE, TWICE = -1, -2
#: Partitions a block or bucket: with more of them than keys, few keys meet in one.
SPREAD = 4
#: Bits of a bigram's key. Keys meet only within a bucket or a block, some millions of them whatever the corpus: a chance
#: of about one in a hundred that any two of a bucket are one.
PAIR_BITS = 48


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, then one end."""
    return np.append(word_hashes(text), END)


def _counted(x: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    values, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return values, n if weights is None else np.bincount(at, weights, len(values)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts, combined over each Arrow batch's texts."""
    for batch in batches:
        parts = [tokens(t) for t in batch.column(0).to_pylist()]
        if parts:
            w, n = _counted(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array(as_long(w)), pa.array(n)], ["word", "c"])


class Common:
    """The common words, by their sorted hashes: index 0 to n - 1; n is the start of a text, -1 any other word."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, kinds: int, texts: int):
        order = np.argsort(words)
        self.words, self.counts, self.n = words[order], counts[order], len(words)
        self.total, self.kinds, self.texts = total, kinds, texts

    def index(self, w: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.full(len(w), -1)
        at = np.minimum(np.searchsorted(self.words, w), self.n - 1)
        return np.where(self.words[at] == w, at, -1)


def _strung(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in one line, a start before each: the words, where each text starts, the places of all tokens."""
    words = np.concatenate([x for w in texts for x in (START_OF, w)])
    starts = np.cumsum([0, *(len(w) + 1 for w in texts[:-1])])
    token = np.ones(len(words), bool)
    token[starts] = False
    return words, starts, np.flatnonzero(token)


def _pairs(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The keys of the arcs to the tokens at ``at``: PAIR_BITS of a hash of the word before and the token."""
    return mix(words[at - 1] * np.uint64(0xD6E8FEB86659FD93) + words[at]) >> np.uint64(64 - PAIR_BITS)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order of the keys, and where in it each new key begins."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(new)


def _sums(x: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x[order], starts, dtype=np.int64) if len(x) else np.zeros(0, np.int64)


def _back(x: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each group's value at all of its members."""
    out = np.empty(len(order), x.dtype)
    out[order] = np.repeat(x, np.diff(np.append(starts, len(order))))
    return out


def _bucket(key: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Ranges of the keys' upper 32 bits."""
    return ((key >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _bytes(x: np.ndarray) -> bytes:
    """Numbers from 0 up in the fewest bytes each."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _steps(keys: np.ndarray) -> bytes:
    """Rising keys: the first, then steps of as few bytes as the largest takes; that number comes before all."""
    step = np.diff(keys)
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].tobytes() + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _keys(data: bytes) -> np.ndarray:
    if len(data) == 1:
        return np.zeros(0, np.uint64)
    width = data[0]
    wide = np.zeros(((len(data) - 9) // width + 1, 8), np.uint8)
    wide[0] = np.frombuffer(data, np.uint8, 8, 1)
    wide[1:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width) if len(wide) > 1 else 0
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def _packed(keys: np.ndarray) -> bytes:
    """Keys of PAIR_BITS in any order."""
    return keys.view(np.uint8).reshape(-1, 8)[:, : PAIR_BITS // 8].tobytes()


def _loose(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) * 8 // PAIR_BITS, 8), np.uint8)
    wide[:, : PAIR_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, PAIR_BITS // 8)
    return wide.view(np.uint64).ravel()


_ASKED = "bucket int, block int, words binary, word_counts binary, fans binary, pairs binary, pair_counts binary, common_pairs binary, common_counts binary, states binary"


class Requests:
    """What one block asks for, counted as its texts come by: words that are not common and bigrams, with their counts in
    training texts."""

    def __init__(self, s: Common, buckets: int):
        self.s, self.buckets, self.waiting, self.size, self.parts = s, buckets, [], 0, []

    def add(self, w: np.ndarray, copies: int) -> None:
        """A text's words and how often it counts: 0 if it is held out."""
        self.waiting.append((w, copies))
        self.size += len(w)
        if self.size >= HOLD:
            self.count()

    def count(self) -> None:
        if self.waiting:
            s = self.s
            words, _, at = _strung([x for x, _ in self.waiting])
            weight = np.repeat([c for _, c in self.waiting], [len(x) for x, _ in self.waiting])
            rare = s.index(words[at]) < 0
            of_words, of_pairs = words[at][rare], _pairs(words, at)
            parts = []
            for keys, n in ((of_words, weight[rare]), (of_pairs, weight)):
                order, starts = _grouped(keys)
                parts.append((keys[order[starts]], _sums(n, order, starts), order[starts]))
            self.parts.append((parts[0][:2], (*parts[1][:2], words[at[parts[1][2]] - 1])))
            self.waiting, self.size = [], 0

    def answer(self, block: int) -> pa.RecordBatch:
        self.count()
        s, buckets = self.s, self.buckets
        words, counts, pairs, n, before = (np.concatenate([p[side][k] for p in self.parts]) for side, k in ((0, 0), (0, 1), (1, 0), (1, 1), (1, 2)))
        self.parts = []
        order, starts = _grouped(words)
        words, counts = words[order[starts]], _sums(counts, order, starts)
        order, starts = _grouped(pairs)
        pairs, n, before = pairs[order[starts]], _sums(n, order, starts), before[order[starts]]
        state = np.where(before == START, s.n, s.index(before))
        common, rare = np.flatnonzero(state >= 0), np.flatnonzero(state < 0)
        rare = rare[np.argsort(before[rare], kind="stable")]  # in the order of their words, each of which is among ``words``
        fans = np.searchsorted(before[rare], words, "right") - np.searchsorted(before[rare], words, "left")
        edge = np.arange(buckets + 1)
        of_words, of_common = np.searchsorted(_bucket(words, buckets), edge), np.searchsorted(_bucket(pairs[common], buckets, PAIR_BITS), edge)
        of_rare = np.append(0, np.cumsum(fans))[of_words]
        cols: list[list] = [[] for _ in range(10)]
        for k in range(buckets):
            x, y, z = slice(*of_words[k : k + 2]), rare[slice(*of_rare[k : k + 2])], common[slice(*of_common[k : k + 2])]
            if len(words[x]) or len(z):
                row = (k, block, _steps(words[x]), _bytes(counts[x]), _bytes(fans[x]), _packed(pairs[y]), _bytes(n[y]), _steps(pairs[z]), _bytes(n[z]), _bytes(state[z]))
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:2]), *(pa.array(c, pa.binary()) for c in cols[2:])], [c.split()[0] for c in _ASKED.split(", ")])


def _requests(batches: Iterator[pa.RecordBatch], common, buckets: int) -> Iterator[pa.RecordBatch]:
    """What every block in the partition, whose rows are in the order of blocks, asks for."""
    last, held = None, None
    for batch in batches:
        for text, block, held_out, copies in zip(*(batch.column(n).to_pylist() for n in ("text", "block", "held_out", "copies")), strict=True):
            if block != last:
                if held is not None:
                    yield held.answer(last)
                last, held = block, Requests(common.value, buckets)
            held.add(tokens(text), 0 if held_out else copies)
    if held is not None:
        yield held.answer(last)


def _column(asked: pa.Table, keys: str, *numbers: str) -> tuple[np.ndarray, ...]:
    """Keys of all rows one after the other, their numbers, and how many keys each row has."""
    k = [(_loose if keys == "pairs" else _keys)(b) for b in asked.column(keys).to_pylist()]
    return np.concatenate(k), *(np.concatenate([_numbers(b, len(x)) for b, x in zip(asked.column(c).to_pylist(), k, strict=True)]) for c in numbers), np.array([len(x) for x in k])


def _masses(asked: pa.Table) -> pa.Table:
    """(state, arcs): how many arcs of common words and of the start one bucket has, and of all its bigrams how many were seen
    once and twice."""
    pairs, counts, states, _ = _column(asked, "common_pairs", "common_counts", "states")
    order, starts = _grouped(pairs)
    often = _sums(counts, order, starts)
    arcs = np.bincount(states[order[starts]], often > 0)
    pairs, counts, _ = _column(asked, "pairs", "pair_counts")
    seen = np.concatenate((often, _sums(counts, *_grouped(pairs))))
    found = np.flatnonzero(arcs)
    return pa.table({"state": pa.array(np.append(found, (ONCE, TWICE)), pa.int32()), "arcs": pa.array(np.append(arcs[found], ((seen == 1).sum(), (seen == 2).sum())).astype(np.int64))})


def _answers(asked: pa.Table) -> pa.Table:
    """One bucket's answer to each block: counts of its words and of their arcs, and the arcs that the block cannot know."""
    words, counts, fans, word_rows = _column(asked, "words", "word_counts", "fans")
    order, starts = _grouped(words)
    totals = _back(_sums(counts, order, starts), order, starts)
    word_of = _back(np.arange(len(starts)), order, starts)
    pairs, own_seen, pair_rows = _column(asked, "pairs", "pair_counts")
    order, starts = _grouped(pairs)
    seen = _sums(own_seen, order, starts)
    fan = np.bincount(np.repeat(word_of, fans)[order[starts]], seen > 0, len(words))[word_of].astype(np.int64)
    seen = _back(seen, order, starts)
    common, own_often, common_rows = _column(asked, "common_pairs", "common_counts")
    order, starts = _grouped(common)
    often = _back(_sums(own_often, order, starts), order, starts)
    ends = [np.append(0, np.cumsum(r)) for r in (word_rows, pair_rows, common_rows)]
    cols: list[list] = [[] for _ in range(5)]
    for k in range(asked.num_rows):
        x, y, z = (slice(*e[k : k + 2]) for e in ends)
        arc, n, own = np.concatenate((pairs[y], common[z])), np.concatenate((seen[y], often[z])), np.concatenate((own_seen[y], own_often[z]))
        kept = np.flatnonzero((n > 1) | ((n == 1) & (own == 0)))
        kept = kept[np.argsort(arc[kept])]
        row = (_steps(words[x]), _bytes(totals[x]), _bytes(fan[x]), _steps(arc[kept]), _bytes(n[kept]))
        for col, value in zip(cols, row, strict=True):
            col.append(value)
    return pa.Table.from_arrays([asked.column("block"), *(pa.array(c, pa.binary()) for c in cols)], ["block", "words", "word_counts", "fans", "arcs", "arc_counts"])


_ANSWERS = "block int, words binary, word_counts binary, fans binary, arcs binary, arc_counts binary"
_SCORES = "copies long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Automaton:
    """The slice of the model that one block's texts can touch; ``own``: the bigrams of its own training texts, rising."""

    def __init__(self, s: Common, answers: pa.Table, own: np.ndarray):
        def table(keys: str, *numbers: str) -> tuple[np.ndarray, ...]:
            *found, _ = _column(rows, keys, *numbers)
            order = np.argsort(found[0])
            return tuple(x[order] for x in found)

        rows = answers.filter(answers.column("words").is_valid()) if answers.num_rows else answers
        nothing = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        self.s, self.fans, self.own, kinds = s, np.zeros(s.n + 1, np.int64), (own, np.ones(len(own), np.int64)), {ONCE: 0, TWICE: 0}
        self.words, self.arcs = (table("words", "word_counts", "fans"), table("arcs", "arc_counts")) if rows.num_rows else (nothing, nothing)
        for states, arcs in zip(answers.column("states").to_pylist(), answers.column("arcs_of_states").to_pylist(), strict=True):
            if states:
                at, n = np.array(states), np.array(arcs)
                self.fans[at[at >= 0]] = n[at >= 0]
                kinds |= dict(zip(at[at < 0].tolist(), n[at < 0].tolist(), strict=True))
        self.discount = (kinds[ONCE] + 1) / (kinds[ONCE] + 2 * kinds[TWICE] + 2)  # above 0 and below 1, whatever was seen

    @staticmethod
    def _find(table: tuple[np.ndarray, ...], keys: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(table[0]) or not len(keys):
            return tuple(np.zeros(len(keys), np.int64) for _ in table[1:])
        order, starts = _grouped(keys)
        wanted = keys[order[starts]]
        at = np.minimum(np.searchsorted(table[0], wanted), len(table[0]) - 1)
        same = table[0][at] == wanted
        return tuple(_back(np.where(same, x[at], 0), order, starts) for x in table[1:])

    def read(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, log10 by the root alone, log10 by the automaton) of each text."""
        s = self.s
        words, starts, at = _strung(texts)
        count, fan = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        index = s.index(words[at])
        often, rare = at[index >= 0], at[index < 0]
        count[often], fan[often] = s.counts[index[index >= 0]], self.fans[index[index >= 0]]
        count[rare], fan[rare] = self._find(self.words, words[rare])
        count[starts], fan[starts] = s.texts, self.fans[s.n]
        root = (count[at] + 1) / (s.total + s.kinds + 1)
        pairs = _pairs(words, at)
        arc = self._find(self.arcs, pairs)[0]
        unsaid = np.flatnonzero(arc == 0)
        arc[unsaid] = self._find(self.own, pairs[unsaid])[0]
        seen = count[at - 1]
        free = np.divide(self.discount * fan[at - 1], seen, out=np.ones(len(at)), where=seen > 0)  # all of a state unseen
        weight = np.maximum(arc - self.discount, 0) / np.maximum(seen, 1) + free * root
        first = starts - np.arange(len(starts))  # of each text's tokens
        return tuple(np.add.reduceat(x, first) for x in ((count[at] > 0).astype(np.int64), np.log10(root), np.log10(weight)))


def _score(left: pa.Table, right: pa.Table, common) -> pa.Table:
    s = common.value
    texts, chunks, size = [], [[]], 0
    for batch in left.select(["text"]).to_batches(max_chunksize=1024):
        for text in batch.column(0).to_pylist():
            texts.append(tokens(text))
            chunks[-1].append(len(texts) - 1)
            size += len(texts[-1])
            if size >= HOLD:
                chunks.append([])
                size = 0
    chunks = [c for c in chunks if c]
    trained = ~left.column("held_out").to_numpy().astype(bool)
    own = []
    for chunk in chunks:
        if known := [texts[k] for k in chunk if trained[k]]:
            words, _, at = _strung(known)
            own.append(np.unique(_pairs(words, at)))
    model = Automaton(s, right, np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64))
    found = [model.read([texts[k] for k in chunk]) for chunk in chunks]
    known, base, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [])
    rows = [left.column("doc_id"), left.column("held_out"), pa.array([len(t) for t in texts], pa.int64()), pa.array(known, pa.int64()), pa.array([s.total] * len(texts), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
    copies = left.column("copies").to_numpy()
    parts = -(-copies // TOGETHER)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    together = pa.array(np.minimum(np.repeat(copies, parts) - TOGETHER * place, TOGETHER).astype(np.int64))
    at = pa.array(np.repeat(np.arange(len(copies)), parts))
    return pa.Table.from_arrays([together, *(r.take(at) for r in rows)], ["copies", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_texts(docs: DataFrame, share: float = COMMON_SHARE, block_bytes: int = BLOCK_BYTES, heavy_bytes: int = HEAVY_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(doc_id as text) mod 7 is 2 are held out of all counts; a null doc_id counts as training. A null text
    is empty: its one token is the end. Repeated rows count each time. Only ``doc_id`` and ``text`` are read. An empty
    table gives no rows; with no training rows every token is unknown and both scores are those of one unseen word each.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
    )
    vocabulary = materialise(texts.where(~F.col("held_out")).select("text").mapInArrow(_count_words, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    sums = vocabulary.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == int(END), F.col("c")))).first()
    total, kinds, trained = (x or 0 for x in sums)
    frequent = vocabulary.where(F.col("c") >= max(2, share * total)).toPandas()  # at most 1 / share rows
    common = spark.sparkContext.broadcast(Common(frequent["word"].to_numpy(np.int64).view(np.uint64), frequent["c"].to_numpy(np.int64), total, kinds, trained))

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))  # and as many buckets
    keyed = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    heavy = keyed.groupBy("key").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("bytes"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("bytes") >= heavy_bytes)).select("key")
    heavy = F.broadcast(spark.createDataFrame(heavy.toPandas(), "key long"))  # at most one a HEAVY_BYTES of text
    light = keyed.join(heavy, "key", "left_anti").withColumn("copies", F.lit(1).cast("long"))
    folded = keyed.join(heavy, "key", "left_semi").groupBy("key", "doc_id", "text", "held_out").agg(F.count("*").alias("copies")).select(*light.columns)
    dealt = light.unionByName(folded).withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).drop("key").repartition(SPREAD * blocks, "block")
    asked = dealt.sortWithinPartitions("block").mapInArrow(lambda b: _requests(b, common, blocks), _ASKED).repartition(SPREAD * blocks, "bucket").groupBy("bucket")
    arcs = asked.applyInArrow(_masses, "state int, arcs long").groupBy("state").agg(F.sum("arcs").alias("arcs"))
    masses = arcs.agg(F.collect_list(F.struct("state", "arcs")).alias("m"))  # at most one a common word
    shared = spark.range(blocks).crossJoin(F.broadcast(masses)).select(F.col("id").cast("int").alias("block"), F.col("m.state").alias("states"), F.col("m.arcs").alias("arcs_of_states"))
    slices = asked.applyInArrow(_answers, _ANSWERS).unionByName(shared, allowMissingColumns=True)
    scored = dealt.groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(lambda l, r: _score(l, r, common), _SCORES)
    each = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.drop("copies", "copy")
