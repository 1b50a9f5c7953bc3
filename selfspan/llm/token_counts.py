"""Edit-aware token counts: a segment tree of pre-token counts kept with each document, re-encoded only where edits touch it.

Byte-pair merges never cross pre-tokens, so a document's count is the sum over its pre-tokens. Leaves are pre-tokens,
gathered in chunks whose sums carry a binary tree. A version of the corpus is a table: the documents, and for each the
lengths and counts of its pre-tokens and the sums of its chunks. An edit run reads a version and makes the next: a document
without edits is passed on as it is; for the others the tree is taken up from the table, not from the text, and an edit
re-splits the text from the first pre-token that could see the edited place, and stops as soon as a pre-token past the edit
starts where one started before: from there on, the splits are the old ones. Only the new pre-tokens are encoded, and only
the sums above the touched chunks change. What is written is cut into even chunks again, so trees stay balanced over any
number of versions.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer splits texts into pre-tokens: a fixed value of that tokenizer.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters past its end that can decide where a pre-token ends: "'" is one by itself unless "ll" follows.
LOOKAHEAD = 2
CHUNK = 64


class Encoder:
    """Pre-tokens and how many tokens each has. Counts are remembered, for a bounded number of pre-tokens."""

    MEMORY = 1 << 20
    loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PRE_TOKEN)
        self.known: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> "Encoder":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if new := [p for p in set(pieces) if p not in known]:  # a set less a dict view would walk the whole dict
            known.update((p, len(self.encoding.encode_ordinary(p))) for p in new)
        out = [known[p] for p in pieces]
        if len(known) > self.MEMORY:
            known.clear()
        return out


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 up: the width, then as few bytes each as the largest takes."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


class CountTree:
    """The pre-tokens of one text with their counts, summed by chunks in a binary tree whose root is the text's count."""

    def __init__(self, text: str, encoder: "Encoder | Callable[[], Encoder]", lengths: np.ndarray, leaves: np.ndarray, sums: np.ndarray | None = None):
        self.text, self.encoder, self.encoded = text, encoder, 0
        self.starts, self.leaves = np.concatenate(([0], np.cumsum(lengths))), leaves
        chunks = max(1, -(-len(leaves) // CHUNK))
        self.bounds = np.minimum(np.arange(chunks + 1) * CHUNK, len(leaves))
        self.width = 1 << (chunks - 1).bit_length()
        self.nodes = np.zeros(2 * self.width, np.int64)
        self.nodes[self.width : self.width + chunks] = self._sums() if sums is None else sums
        level = self.width
        while level > 1:
            self.nodes[level // 2 : level] = self.nodes[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    def _sums(self) -> np.ndarray:
        return np.add.reduceat(self.leaves, self.bounds[:-1]) if len(self.leaves) else np.zeros(1, np.int64)

    @classmethod
    def build(cls, text: str, encoder: "Encoder") -> "CountTree":
        """The tree of a text that has none yet: all of it is split and encoded."""
        pieces = encoder.split.findall(text)
        return cls(text, encoder, np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(encoder.counts(pieces), np.int64))

    @classmethod
    def load(cls, text: str, encoder: "Callable[[], Encoder]", tree: dict) -> "CountTree":
        """The tree as it was saved; the encoder is called for when an edit needs it."""
        return cls(text, encoder, *(_numbers(tree[c]) for c in ("lengths", "counts", "sums")))

    def save(self) -> dict:
        """What the version table keeps, in even chunks."""
        chunks = max(1, -(-len(self.leaves) // CHUNK))
        self.bounds = np.minimum(np.arange(chunks + 1) * CHUNK, len(self.leaves))
        return {"pre_tokens": len(self.leaves), "tokens": self.total, "lengths": _packed(np.diff(self.starts)), "counts": _packed(self.leaves), "sums": _packed(self._sums())}

    @property
    def total(self) -> int:
        return int(self.nodes[1])

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from ``start`` to ``end``."""
        n = len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        encoder = self.encoder if isinstance(self.encoder, Encoder) else self.encoder()
        # the first pre-token that can see the edit, and the first one after it that starts as before
        i = int(np.searchsorted(self.starts[1:], start - LOOKAHEAD + 1))
        at = int(self.starts[i]) if i < len(self.starts) else n
        pieces, stop = [], len(self.leaves)
        while at < len(self.text):
            if at >= start + len(new):
                j = int(np.searchsorted(self.starts, at - shift))
                if j < len(self.starts) - 1 and self.starts[j] == at - shift and j >= i:
                    stop = j
                    break
            piece = encoder.split.match(self.text, at).group()
            pieces.append(piece)
            at += len(piece)
        counts = np.array(encoder.counts(pieces), np.int64)
        self.encoded += len(pieces)
        first = int(self.starts[i]) if i < len(self.starts) else n
        inner = first + np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))
        self.starts = np.concatenate((self.starts[:i], inner[:-1], self.starts[stop:] + shift))
        if len(self.leaves) == stop:
            self.starts[-1] = len(self.text)
        self.leaves = np.concatenate((self.leaves[:i], counts, self.leaves[stop:]))
        chunk = min(int(np.searchsorted(self.bounds, i, "right")) - 1, len(self.bounds) - 2)
        last = min(max(int(np.searchsorted(self.bounds, max(stop - 1, i), "right")) - 1, chunk), len(self.bounds) - 2)
        self.bounds[chunk + 1 :] = np.maximum(self.bounds[chunk + 1 :], stop) - (stop - i) + len(pieces)
        for c in range(chunk, last + 1):
            k = self.width + c
            self.nodes[k] = self.leaves[self.bounds[c] : self.bounds[c + 1]].sum()
            while k > 1:
                k //= 2
                self.nodes[k] = self.nodes[2 * k] + self.nodes[2 * k + 1]


def apply_edits(tree: CountTree, edits: list[dict] | None) -> int:
    """Apply edits given in places of the original text, from the last to the first; of overlapping ones, what an earlier
    one has replaced is not replaced again. Returns how many there were."""
    done, floor = [], 0
    for e in sorted((e for e in edits or () if e is not None), key=lambda e: (e["start"] or 0, e["end"] or 0)):
        start = max(e["start"] or 0, floor)
        end = max(e["end"] or 0, start)
        done.append((start, end, e["new"] or ""))
        floor = end
    for start, end, new in reversed(done):
        tree.replace(start, end, new)
    return len(done)


_TREE = T.StructType([T.StructField("pre_tokens", T.LongType()), T.StructField("tokens", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("lengths", "counts", "sums"))])
_TREE_ARROW = pa.struct([("pre_tokens", pa.int64()), ("tokens", pa.int64()), *((c, pa.binary()) for c in ("lengths", "counts", "sums"))])


def _build(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.load(path)
    for batch in batches:
        trees = [CountTree.build(t or "", encoder).save() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(trees, _TREE_ARROW)], ["row", "tree"])


def first_version(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row, tree): every row as it is, whatever its columns, and the tree of its ``text``; all texts are encoded."""
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("tree", _TREE)])
    return docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(lambda b: _build(b, vocabulary), schema)


_CHANGE = ["edits", "encoded_again", "tokens_before"]


def _revise(batches: Iterator[pa.RecordBatch], path: str, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, trees, changes = [], [], []
        for text, tree, edits in zip(*(batch.column(n).to_pylist() for n in ("text", "tree", "edits")), strict=True):
            before = tree["tokens"]
            if edits:
                t = CountTree.load(text or "", lambda: Encoder.load(path), tree)
                n = apply_edits(t, edits)
                text, tree = t.text, t.save() if whole else {"pre_tokens": len(t.leaves), "tokens": t.total}
                changes.append((n, t.encoded, before))
            else:
                changes.append((0, 0, before))
            texts.append(text)
            trees.append(tree)
        change = [pa.array([c[k] for c in changes], pa.int64()) for k in range(3)]
        if whole:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(trees, _TREE_ARROW), *change], ["row", "text", "tree", *_CHANGE])
        else:
            sums = [pa.array([t[c] for t in trees], pa.int64()) for c in ("pre_tokens", "tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *sums, *change], ["row", "pre_tokens", "tokens", *_CHANGE])


def next_version(version: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row, tree, edits, encoded_again, tokens_before) after ``edits``, a column over ``row``: array of (start, end, new) with
    places in characters of the text, or null. Rows without edits are passed on: nothing of them is split or encoded."""
    kind = version.schema["row"].dataType
    schema = T.StructType([T.StructField("row", kind), T.StructField("text", T.StringType()), T.StructField("tree", _TREE), *(T.StructField(c, T.LongType()) for c in _CHANGE)])
    asked = version.select("row", F.col("row.text").cast("string").alias("text"), "tree", edits.cast(_EDITS).alias("edits"))
    made = asked.mapInArrow(lambda b: _revise(b, vocabulary, True), schema)
    return made.withColumn("row", F.col("row").withField("text", F.col("text"))).drop("text")


_EDITS = "array<struct<start:int,end:int,new:string>>"


def count_tokens(docs: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, pre_tokens, tokens, edits, encoded_again, tokens_after.

    The first version is written, and the edits are applied to it. ``edits``: as in ``next_version``, over ``row``. Places
    beyond the text are moved to its end; of overlapping edits the later gives way. ``tokens`` counts the text as it is,
    ``tokens_after`` the edited one, ``encoded_again`` the pre-tokens encoded for the edits. A null text is empty. Each
    row stands for itself, repeated or not. An empty table gives no rows; further columns may have any names.
    ``vocabulary``: a file every worker has.
    """
    version = materialise(first_version(docs, vocabulary), "token-trees", "zstd")
    asked = version.select(F.struct(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("tree.pre_tokens").alias("pre_tokens"), F.col("tree.tokens").alias("tokens")).alias("row"), F.col("row.text").cast("string").alias("text"), "tree", edits.cast(_EDITS).alias("edits"))
    schema = T.StructType([T.StructField("row", asked.schema["row"].dataType), T.StructField("pre_tokens", T.LongType()), T.StructField("tokens", T.LongType()), *(T.StructField(c, T.LongType()) for c in _CHANGE)])
    made = asked.mapInArrow(lambda b: _revise(b, vocabulary, False), schema)
    return made.select("row.doc_id", "row.pre_tokens", "row.tokens", "edits", "encoded_again", F.col("tokens").alias("tokens_after"))


def sample_revision(row: str = "row") -> Column:
    """A revision derived from each text itself: a third of the way in, five characters give way to the source's name;
    two thirds in, the language's name is inserted; the last ten characters go."""
    n = F.coalesce(F.length(f"{row}.text"), F.lit(0))
    place = lambda numerator: F.floor(n * numerator / 3).cast("int")
    return F.array(
        F.struct(place(1).alias("start"), (place(1) + 5).alias("end"), F.coalesce(F.col(f"{row}.source"), F.lit("")).alias("new")),
        F.struct(place(2).alias("start"), place(2).alias("end"), F.concat(F.lit(" "), F.coalesce(F.col(f"{row}.lang"), F.lit("")), F.lit("'l ")).alias("new")),
        F.struct((n - 10).alias("start"), n.alias("end"), F.lit("").alias("new")),
    )
