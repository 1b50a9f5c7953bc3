"""Near-duplicate documents by an inverted join of MinHash signature coordinates, confirmed on full shingle sets.

1. Texts become sets of word shingles. Documents with equal sets collapse to the one with the smallest id, so copies,
   however many, cost one row each from here on.
2. Each distinct set is posted under every (coordinate, value) pair of its signature. Pairs that occur once cannot
   collide and leave. Two sets that agree in at least ``matches`` of ``coordinates`` places must share one of their
   ``coordinates - matches + 1`` rarest pairs (prefix), so only those are posted again; a set with fewer than
   ``matches`` shared pairs is skipped altogether.
3. In each posting list collisions are counted over whole signatures, and of the pairs above the threshold only a
   spanning forest is kept: what is needed is who reaches whom, and a forest has at most one edge a posting. Long lists
   are cut into blocks and joined block by block.
4. The forests' components hold every true link. First the forests' own edges, stars around a root, are tried on the full
   sets; where these confirmed links already join a whole component, as in a group of near copies however large, nothing
   is left to find. The other components are settled in one task each on the full sets, large ones block by block, again
   keeping forests of confirmed links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, connected_components, map_groups, materialise, mix, packed, shingle_set, word_hashes

COORDINATES = 64
#: Chance, at most, that a pair just at the similarity asked for agrees in too few coordinates to be a candidate.
MISS = 1e-6
#: Postings compared, and documents confirmed, in one task at most; beyond it, block by block.
LIST_BLOCK = 2048
GROUP_BLOCK = 1024
#: Shingles of the documents of one such block, about: a task holds those of two, at some 50 bytes each.
GROUP_SHINGLES = 1 << 21
#: Large stars' roots that are broadcast at most, 12 bytes each.
BROADCAST_ROOTS = 1 << 20
#: Rows for which signatures are hashed at once.
CHUNK = 4096

_K = np.arange(1, COORDINATES + 1, dtype=np.uint64)
_MULTIPLIER = mix(_K * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_OFFSET = mix(_K * np.uint64(0xC2B2AE3D27D4EB4F))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the set at each coordinate, as 64-bit tokens that also tell the coordinate."""
    low = np.full(COORDINATES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), CHUNK):
        part = shingles[i : i + CHUNK]
        for k in range(COORDINATES):
            low[k] = min(low[k], (part * _MULTIPLIER[k] + _OFFSET[k]).min())
    return mix(low ^ _OFFSET)


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n, one, two, sign = [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingle_set(word_hashes(text), words)
            ids.append(doc_id)
            n.append(len(s))
            one.append(int(as_long(np.array([mix(s).sum()], np.uint64))[0]) if len(s) else 0)
            two.append(int(as_long(np.array([mix(s ^ np.uint64(0xA5A5A5A5)).sum()], np.uint64))[0]) if len(s) else 0)
            sign.append(as_long(signature(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sign, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_one", "set_two", "sign"],
        )


def forest(n: int, similar) -> list[tuple[int, int]]:
    """Edges (root, member) that span the components of the graph on 0..n-1; ``similar(i, among)``: which of ``among`` i links to."""
    left, edges = np.arange(n), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            hit = similar(frontier.pop(), left)
            found, left = left[hit], left[~hit]
            edges += [(int(root), int(x)) for x in found]
            frontier += list(found)
    return edges


def matches_for(similarity: float, miss: float = MISS) -> int:
    """The most coordinates that may be asked to agree while a pair of that similarity is missed with chance ``miss`` at most."""
    below, m = 0.0, 0
    while m < COORDINATES and (below := below + comb(COORDINATES, m) * similarity**m * (1 - similarity) ** (COORDINATES - m)) <= miss:
        m += 1
    return max(m, 1)


def _edges(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _collide(table: pa.Table, starts: np.ndarray, matches: int) -> pa.RecordBatch:
    """Forests of the pairs of each posting list (or pair of its blocks) that agree in enough coordinates."""
    ids = table.column("rep").to_numpy()
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(ids), COORDINATES)
    sizes = np.diff(starts)
    two = starts[:-1][sizes == 2]
    two = two[(codes[two] == codes[two + 1]).sum(axis=1) >= matches]
    a, b = [ids[two]], [ids[two + 1]]
    for at, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
        own = codes[at : at + n]
        if edges := forest(n, lambda i, among, own=own: (own[among] == own[i]).sum(axis=1) >= matches):
            x, y = np.array(edges).T + at
            a.append(ids[x])
            b.append(ids[y])
    return _edges(np.concatenate(a), np.concatenate(b))


def _confirm(texts: list[str], ids: np.ndarray, words: int, part: int, whole: int) -> list[tuple[int, int]]:
    """A forest of the links among the documents: part of whole of the union of two sets is shared, or more."""
    sets = [shingle_set(word_hashes(t), words) for t in texts]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(flat.max() + 1, bool)

    def similar(i: int, among: np.ndarray) -> np.ndarray:
        near = (whole * np.minimum(sizes[i], sizes[among]) >= part * np.maximum(sizes[i], sizes[among])).nonzero()[0]
        out = np.zeros(len(among), bool)
        if len(near):
            own = flat[starts[i] : starts[i] + sizes[i]]
            marked[own] = True
            picked = among[near]
            at = np.repeat(starts[picked] - np.concatenate(([0], np.cumsum(sizes[picked])[:-1])), sizes[picked]) + np.arange(sizes[picked].sum())
            common = np.add.reduceat(marked[flat[at]].astype(np.int64), np.concatenate(([0], np.cumsum(sizes[picked])[:-1])))
            marked[own] = False
            out[near] = whole * common >= part * (sizes[i] + sizes[picked] - common)
        return out

    return [(int(ids[x]), int(ids[y])) for x, y in forest(len(ids), similar)]


def _settle(table: pa.Table, starts: np.ndarray, words: int, part: int, whole: int) -> pa.RecordBatch:
    ids, texts = table.column("rep").to_numpy(), table.column("text")
    edges = [e for x, y in zip(starts[:-1], starts[1:], strict=True) for e in _confirm(texts.slice(x, y - x).to_pylist(), ids[x:y], words, part, whole)]
    return _edges([x for x, _ in edges], [y for _, y in edges])


def _try_stars(table: pa.Table, starts: np.ndarray, words: int, part: int, whole: int) -> pa.RecordBatch:
    """The links between each star's root, whose rows (one a text of its id) come first, and its members."""
    ids, place, texts, a, b = table.column("rep").to_numpy(), table.column("place").to_numpy(), table.column("text"), [], []
    for x, y in zip(starts[:-1], starts[1:], strict=True):
        m = x + int((place[x:y] == 0).sum())
        own = [shingle_set(word_hashes(texts[k].as_py()), words) for k in range(x, m)]
        for k in range(m, y):
            other = shingle_set(word_hashes(texts[k].as_py()), words)
            common = [len(np.intersect1d(s, other, assume_unique=True)) for s in own]
            if any(whole * c >= part * (len(s) + len(other) - c) for c, s in zip(common, own, strict=True)):
                a.append(ids[x])
                b.append(ids[k])
    return _edges(a, b)


def confirmed_stars(candidates: DataFrame, texts: DataFrame, words: int, part: int, whole: int) -> DataFrame:
    """The candidate edges (a, b) that hold on the full sets. A star is dealt out in blocks of up to GROUP_BLOCK members, each
    with the root's text: a text is shipped once an edge at most. Roots of more than one block are few, and broadcast up to
    BROADCAST_ROOTS, so that no task takes all edges of one."""
    stars = candidates.groupBy("a").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("many")).where("many > 1")
    big = materialise(packed(stars, candidates.count()), "large-stars")
    sized = candidates.join(F.broadcast(big) if big.count() <= BROADCAST_ROOTS else big.hint("merge"), "a", "left").withColumn("blocks", F.coalesce("many", F.lit(1)))
    members = sized.select(F.col("a").alias("root"), F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"), F.col("b").alias("rep"), F.lit(1).alias("place"))
    roots = members.select("root", "block").distinct().select("root", "block", F.col("root").alias("rep"), F.lit(0).alias("place"))
    rows = texts.join(members.union(roots).withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id").select("root", "block", "place", F.col("doc_id").alias("rep"), "text")
    return map_groups(rows, ["root", "block"], lambda t, s: _try_stars(t, s, words, part, whole), "a long, b long", order=["place"])


def in_blocks(rows: DataFrame, group: list[str], size: str, block: int, of: str) -> DataFrame:
    """Give each row ``pair``: null in a group of up to ``block`` rows, else one row for each pair of blocks it is in."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(of), n).cast("int")
    pairs = F.when(n <= 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(j, own) * n + F.greatest(j, own))
    )
    return rows.withColumn("pair", F.explode(pairs)).drop(size)


def with_room(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``groups`` (node, candidates, ..) with ``members``: the rows of the group, or more where its sets (node, n_shingles) are so
    large that blocks of GROUP_BLOCK rows would hold more than GROUP_SHINGLES shingles."""
    held = groups.select("node", "candidates").join(sets.hint("merge"), "node").groupBy("candidates")
    room = F.ceil(F.sum("n_shingles") * GROUP_BLOCK / GROUP_SHINGLES)
    return groups.join(held.agg(F.greatest(F.count("*"), room).alias("members")), "candidates")


def near_duplicates(docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100, matches: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, copy_of (the smallest id with an equal set).

    Documents link when ``whole`` * shared shingles >= ``part`` * shingles of both. Words are runs of characters other
    than space and 09-0D, A-Z lower-cased; a text of fewer words than a shingle is one shingle. A text that is null,
    empty or has no words has no shingles, links with nothing and stays. Rows of one doc_id are one document each time
    (of several texts under one id, all count as that id). A row without doc_id is never linked: its component_id is
    null and it stays. Only ``doc_id`` and ``text`` are read. An empty table gives no rows.
    """
    matches = matches_for(part / whole) if matches is None else matches
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(texts.mapInArrow(lambda b: _sign(b, words), "doc_id long, n_shingles long, set_one long, set_two long, sign array<long>"), "signatures")
    same = ["n_shingles", "set_one", "set_two"]
    classes = signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    reps = materialise(
        signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*same).agg(F.min_by(F.struct("doc_id", "sign"), "doc_id").alias("s")).select(*same, F.col("s.doc_id").alias("rep"), F.col("s.sign").alias("sign")),
        "distinct-sets",
    )
    tokens = reps.select("rep", F.explode("sign").alias("token"))
    shared = materialise(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared-tokens")
    prefix = COORDINATES - matches + 1
    rare = (
        tokens.join(shared, "token")
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))  # at most one per coordinate
        .where(F.size("t") >= matches)
        .select("rep", F.explode(F.expr(f"slice(t, 1, {prefix} - ({COORDINATES} - size(t)))")).alias("t"))
        .select("rep", "t.*")
    )
    code = reps.select("rep", F.expr("unhex(array_join(transform(sign, x -> lpad(hex(x & 255), 2, '0')), ''))").alias("code"))
    lists = in_blocks(rare.join(code, "rep"), ["token"], "df", LIST_BLOCK, "rep")
    candidates = materialise(map_groups(lists, ["token", "pair"], lambda t, s: _collide(t, s, matches), "a long, b long").distinct(), "candidates")
    tried = candidates.count()
    sure = materialise(packed(confirmed_stars(candidates, texts, words, part, whole).distinct(), tried), "star-links")
    near = connected_components(candidates).withColumnRenamed("component", "candidates")
    own = near.join(connected_components(sure, "star-groups"), "node", "left").select("node", "candidates", F.coalesce("component", "node").alias("own"))
    joined = materialise(packed(own, 2 * tried), "candidate-groups")

    # of two, the only edge has been tried
    open_groups = joined.groupBy("candidates").agg(F.count("*").alias("members"), F.min("own").alias("least"), F.max("own").alias("most")).where("least < most AND members > 2")
    sized = with_room(joined.join(open_groups.select("candidates"), "candidates"), reps.select(F.col("rep").alias("node"), "n_shingles"))
    # neither side has a bounded size: the plan is the same for a small table as for a large one
    members = texts.join(sized.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id").select(F.col("candidates").alias("component"), "members", F.col("doc_id").alias("rep"), "text")
    blocks = in_blocks(members, ["component"], "members", GROUP_BLOCK, "rep")
    links = materialise(packed(map_groups(blocks, ["component", "pair"], lambda t, s: _settle(t, s, words, part, whole), "a long, b long").distinct(), tried), "links")
    side = lambda n: joined.select(F.col("node").alias(n), F.col("own").alias(f"own_{n}"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.col("own_a").alias("a"), F.col("own_b").alias("b"))
    merged = connected_components(between, "links")
    groups = joined.join(merged.withColumnRenamed("node", "own"), "own", "left").select("node", F.coalesce("component", "own").alias("component"))

    placed = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(*same, "rep", F.coalesce("component", "rep").alias("component_id"))
    return signed.join(placed, same, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("copy_of"),
    )
