"""Exact removal of repeated passages by a depth-limited radix sort of all suffixes, to a depth of ``depth`` bytes.

Two suffixes agree through the depth exactly when their windows of ``depth`` bytes are equal, so the groups left after
the last digit are the repeated windows. Digits run from the most significant on, and a group of one leaves at once:

1. A suffix's first digit is a block of ``BLOCK`` bytes inside its window, at the place whose 16-byte gram has the least
   hash. The place depends on the window's bytes alone, so equal windows have equal blocks at equal offsets. Neighbouring
   suffixes mostly choose the same place: they stay together as one row, a run.
2. Second digit: the run's whole stretch of text. Runs whose stretch occurs again are repeated as they stand.
3. Runs that share a block but are no copy as a whole (the edges of passages) are cut into sub-runs of ``STEP``
   suffixes; the third digit is the stretch that all windows of a sub-run share, the fourth its whole stretch.
4. Last digit: the whole window, for the suffixes of sub-runs that share a third digit but no fourth.

Digits are compared as 64-bit hashes; a window's digits together are at least 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, as_long, byte_codes, materialise, mix, text_bytes

DEPTH = 400
BLOCK = 80
GRAM = 16
STEP = 20
_PLACE_BITS = np.uint64((1 << 30) - 1)


def _places(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams, the leftmost place of the least one."""
    least = (grams & ~_PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: size - width], least[width - size :])
    return (least & _PLACE_BITS).astype(np.int64)


def _sizes(depth: int) -> tuple[int, int, int]:
    """(block, gram, step) for a depth: production values, or less for a small depth."""
    block = max(1, min(BLOCK, depth // 4))
    return block, min(GRAM, block), max(1, min(STEP, depth // 4))


def _runs(data: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one place: (first suffix, last suffix, place, block hash, stretch hash)."""
    block, gram, _ = _sizes(depth)
    one, two = RollingHash(data, byte_codes(1)), RollingHash(data, byte_codes(2))
    at = np.arange(len(data) - block + 1)
    place = _places(mix(one.of(at, at + gram)), depth - block + 1)
    edge = np.flatnonzero(place[1:] != place[:-1]) + 1
    first = np.concatenate(([0], edge))
    last = np.concatenate((edge, [len(place)])) - 1
    place = place[first]
    digit = mix(one.of(place, place + block))
    stretch = mix(two.of(first, last + depth) ^ mix(digit + ((place - first) << 32 | (last - first)).astype(np.uint64)))
    return first, last, place, as_long(digit), as_long(stretch)


def _batch(columns: dict[str, list[np.ndarray]], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate(columns[n]).astype(k.to_pandas_dtype()), k) for n, k in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, list(kinds))


_ROW = {"id": pa.int64(), "crc": pa.int64()}
_RUN = _ROW | {"first": pa.int32(), "last": pa.int32(), "place": pa.int32(), "digit": pa.int64(), "stretch": pa.int64()}
_PART = _ROW | {"first": pa.int32(), "low": pa.int32(), "high": pa.int32(), "digit": pa.int64(), "stretch": pa.int64(), "copies": pa.int64()}


def _schema(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{n} {'long' if k == pa.int64() else 'int'}" for n, k in kinds.items())


def _emit_runs(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {n: [] for n in _RUN}
        for i, crc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            data = np.frombuffer(text_bytes(text), np.uint8)
            if len(data) >= depth:
                runs = _runs(data, depth)
                for n, c in zip(_RUN, (np.full(len(runs[0]), i), np.full(len(runs[0]), crc), *runs), strict=True):
                    out[n].append(c)
        if out["id"]:
            yield _batch(out, _RUN)


def _cut(batches: Iterator[pa.RecordBatch], depth: int, single: bool) -> Iterator[pa.RecordBatch]:
    """The third digits of runs, or with ``single`` the last digits of the suffixes in their ranges ``parts``.

    Sub-run k of a run holds the suffixes that start k * step to k * step + step - 1 bytes before the place; all their
    windows share the stretch from the first of these starts on, and it lies in the run's text even where the run ends
    within the sub-run.
    """
    codes, step = byte_codes(3), _sizes(depth)[2]
    for batch in batches:
        out = {n: [] for n in _PART}
        rows = batch.to_pylist()
        for r in rows:
            h = RollingHash(np.frombuffer(r["piece"], np.uint8), codes)
            first, last, place = r["first"], r["last"], r["place"]
            if single:
                low = high = np.concatenate([np.arange(x["low"], x["high"] + 1) for x in r["parts"]])
                copies = np.concatenate([np.full(x["high"] + 1 - x["low"], x["copies"]) for x in r["parts"]])
                offset, begin, end = place - low, low, low + depth
            else:
                offset = np.arange((place - last) // step, (place - first) // step + 1)
                low, high = np.maximum(place - offset * step - step + 1, first), np.minimum(place - offset * step, last)
                begin, end = place - offset * step, place - offset * step - step + 1 + depth
                copies = np.full(len(low), r["copies"])
            digit = mix(h.of(begin - first, end - first) ^ mix(offset.astype(np.uint64) ^ np.uint64(r["digit"] & 0xFFFFFFFFFFFFFFFF)))
            stretch = digit if single else mix(h.of(low - first, high + depth - first) ^ mix(digit + ((place - low) << 32 | (high - low)).astype(np.uint64)))
            n = len(low)
            for name, c in zip(_PART, (np.full(n, r["id"]), np.full(n, r["crc"]), np.full(n, first), low, high, as_long(digit), as_long(stretch), copies), strict=True):
                out[name].append(c)
        if rows:
            yield _batch(out, _PART)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the bytes in ``spans``."""
    for batch in batches:
        ids, size, removed, count, sha = [], [], [], [], []
        for doc_id, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            data = text_bytes(text)
            kept, at, gone, n = hashlib.sha256(), 0, 0, 0
            end = -1
            for span in sorted((s["start"], s["end"]) for s in spans or ()):
                if span[0] > end:
                    kept.update(data[max(at, 0) : span[0]])
                    n += 1
                    gone += span[1] - span[0]
                    end = at = span[1]
                elif span[1] > end:
                    gone += span[1] - end
                    end = at = span[1]
            kept.update(data[at:])
            ids.append(doc_id)
            size.append(len(data))
            removed.append(gone)
            count.append(n)
            sha.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _again(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows whose ``keys`` occur in other rows too. The counts are written first, so that Spark can split the join where one key has very many rows."""
    weight = F.sum("copies") if "copies" in rows.columns else F.count("*")
    return rows.join(materialise(rows.groupBy(*keys).agg(weight.alias("n")).where("n > 1").drop("n"), name), keys)


def _compare(rows: DataFrame, place: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(repeated, open): the rows whose whole stretch occurs again, and one row of each stretch that shares its digit with
    other stretches, if some of them occur once: what the next digit has to tell apart. ``copies`` counts up to 2."""
    classes = materialise(rows.groupBy("digit", "stretch").agg(F.least(F.sum("copies"), F.lit(2)).alias("copies"), F.min(F.struct("id", "crc", *place)).alias("one")), name)
    repeated = rows.join(classes.where("copies > 1").select("digit", "stretch"), ["digit", "stretch"])
    mixed = classes.groupBy("digit").agg(F.min("copies").alias("least"), F.count("*").alias("kinds")).where("least = 1 AND kinds > 1")
    return repeated, classes.join(mixed.select("digit"), "digit").select("digit", "copies", "one.*")


def repeated_spans(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): every row's (doc_id, id, crc, text), and for each row (id, crc) the stretches [start, end) of bytes
    that windows occurring elsewhere cover. A row without an id goes by a hash of its text."""
    text = F.col(text_col).cast("string")
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("id"),
        F.coalesce(F.crc32(text), F.lit(-1)).alias("crc"),
        text.alias("text"),
    )
    long_enough = texts.where(F.octet_length("text") >= depth).select("id", "crc", "text")
    runs = materialise(long_enough.mapInArrow(lambda b: _emit_runs(b, depth), _schema(_RUN)), "runs")
    shared = materialise(_again(runs, ["digit"], "first-digits"), "runs-sharing-a-block")

    span = lambda df, low, high: df.select("id", "crc", F.col(low).alias("start"), (F.col(high) + depth).alias("end"))
    whole, ask = _compare(shared.withColumn("copies", F.lit(1).cast("long")), ["first", "last", "place"], "second-digits")
    pieces = materialise(
        # the texts are dealt out anew at every size: nothing bounds either side
        ask.join(long_enough.hint("merge"), ["id", "crc"]).select("id", "crc", "first", "last", "place", "digit", "copies", F.substring(F.col("text").cast("binary"), F.col("first") + 1, F.col("last") - F.col("first") + depth).alias("piece")),
        "pieces",
    )
    thirds = materialise(pieces.mapInArrow(lambda b: _cut(b, depth, False), _schema(_PART)), "third-digits")
    part, ask = _compare(thirds, ["first", "low", "high"], "fourth-digits")
    # copies of a sub-run that stand for a run found whole are covered already
    parts = ask.groupBy("id", "crc", "first").agg(F.collect_list(F.struct("low", "high", "copies")).alias("parts"))
    last = materialise(pieces.drop("copies").join(parts, ["id", "crc", "first"]).mapInArrow(lambda b: _cut(b, depth, True), _schema(_PART)), "last-digits")
    single = _again(last, ["digit"], "last-digits-again")
    singles = span(part.where("copies = 1"), "low", "high").union(span(single.where("copies = 1"), "low", "low"))
    found = span(whole, "first", "last")
    return texts, found.union(singles)


def remove_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte that some window of ``depth`` bytes covers goes, if the window's string starts anywhere else as well, in
    the same text or another; windows are judged on the input and never cross texts. A null text is empty; a text under
    ``depth`` bytes is kept whole. Repeated rows remove each other. A null doc_id stays null. Only ``doc_id`` and
    ``text`` are read. An empty table gives no rows.
    """
    texts, spans = repeated_spans(docs, depth)
    gone = spans.groupBy("id", "crc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # at most one per byte of a text
    return (
        texts.join(gone.hint("merge"), ["id", "crc"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
