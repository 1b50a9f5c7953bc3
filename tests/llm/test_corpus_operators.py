"""The dealt operators against brute force on small tables with nulls, empty texts, repeats and extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from selfspan.llm import backoff_lm, decontam, epsilon_grid, minhash_join, mixing, slot_sharding, suffix_dedup, toxicity, url_cascade
from selfspan.llm.common import LEAST_FILES, connected_components, shared_folder

random.seed(5)
WORDS = [a + b for a in "bcdfgh" for b in ("an", "or", "el", "it")]
BASE = " ".join(random.choice(WORDS) for _ in range(120))


def edited(text, at, word="zzz"):
    w = text.split()
    w[at] = word
    return " ".join(w)


TEXTS = [BASE, BASE, edited(BASE, 5), edited(edited(BASE, 60), 90), "Xy " * 3 + BASE, None, "", "one two", "ONE two", " \t\n", "a" * 900, "é" * 300 + BASE, *(" ".join(random.choice(WORDS) for _ in range(n)) for n in (1, 3, 30, 200)), BASE[:300], "tail " + BASE[-420:]]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens long, key string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, f"s{i % 3}" if i % 5 else None, 1, 7, "x", 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [(None, BASE, "en", "s1", 1, 7, "x", 2), rows[2]], SCHEMA).repartition(3)


def words_of(text):
    return [w for w in re.split(r"[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]


def shared_files(spark):
    return Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet")


def unions(n_ids, links):
    root = {i: i for i in n_ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n_ids}


@pytest.mark.parametrize("depth", [9, 400])
def test_repeats_are_removed_byte_by_byte(docs, depth):
    rows = docs.select("doc_id", "text").collect()
    texts = [(r[1] or "").encode() for r in rows]
    seen = {}
    for t in texts:
        for p in range(len(t) - depth + 1):
            seen[t[p : p + depth]] = seen.get(t[p : p + depth], 0) + 1
    want = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - depth + 1):
            if seen[t[p : p + depth]] > 1:
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want.append((doc_id, len(t), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.remove_repeats(docs, depth).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_repeats_on_both_sides_of_the_depth(spark):
    """Thousands of texts with passages of over 50 words that repeat across them: those of 400 bytes or more go, byte by
    byte, and those below stay, whatever their number of words."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(n))
    passages = [prose(200)[:n] for n in (330, 380, 399, 400, 401, 402, 420, 480, 700)]
    rows = [(i, prose(rng.randint(1, 150)) + (" " + rng.choice(passages) + " " if i % 2 else "") + prose(rng.randint(0, 60))) for i in range(2500)]
    rows += [(9000 + i, rows[1][1] if i % 2 else passages[-1] * 3) for i in range(40)] + [(9100, "ab" * 40_000)]
    seen, gone = {}, {}
    for _, t in rows:
        for p in range(len(t) - 399):
            h = hash(t[p : p + 400])
            seen[h] = seen.get(h, 0) + 1
    for i, t in rows:
        cover = bytearray(len(t))
        for p in range(len(t) - 399):
            if seen[hash(t[p : p + 400])] > 1:
                cover[p : p + 400] = b"\1" * 400
        gone[i] = (sum(cover), hashlib.sha256(bytes(b for b, g in zip(t.encode(), cover, strict=True) if not g)).hexdigest())
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == gone
    # the spaces around a passage repeat with it
    long_ones = [i for i, t in rows if any(p in t for p in passages if len(p) > 397)]
    assert len(long_ones) > 500 and all(gone[i][0] >= 400 for i in long_ones)
    assert all(gone[i][0] == 0 for i, t in rows if i < 9000 and i not in set(long_ones))


def test_near_duplicates_equal_all_pairs(docs):
    rows = docs.select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        w = words_of(r[1])
        sets[r[0]] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    component = unions(ids, links)
    got = minhash_join.near_duplicates(docs, words=3, part=85).collect()
    assert len(got) == len(rows) and len(links) > 3
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (component[r.doc_id], component[r.doc_id] == r.doc_id))


def test_blocks_of_large_groups_change_nothing(docs, monkeypatch):
    want = sorted(map(tuple, minhash_join.near_duplicates(docs, words=3, part=85).collect()), key=str)
    monkeypatch.setattr(minhash_join, "LIST_BLOCK", 2)
    monkeypatch.setattr(minhash_join, "GROUP_BLOCK", 2)
    assert sorted(map(tuple, minhash_join.near_duplicates(docs, words=3, part=85).collect()), key=str) == want


def test_blocks_of_long_texts_hold_few_shingles(spark, monkeypatch):
    """40 documents of 300 to 495 shingles, in blocks of 2000 shingles: no task gets all of them."""
    monkeypatch.setattr(minhash_join, "GROUP_SHINGLES", 2000)
    sizes = {i: 300 + 5 * i for i in range(40)} | {100: 7, 101: 8, 102: 9}
    groups = spark.createDataFrame([(i, i // 100) for i in sizes], "node long, candidates long")
    sets = spark.createDataFrame(list(sizes.items()), "node long, n_shingles long")
    blocks = minhash_join.in_blocks(minhash_join.with_room(groups, sets), ["candidates"], "members", minhash_join.GROUP_BLOCK, "node").collect()
    held = {}
    for r in blocks:
        held.setdefault((r.candidates, r.pair), []).append(r.node)
    assert sorted(held[1, 0]) == [100, 101, 102]
    assert max(sum(sizes[i] for i in ids) for ids in held.values()) < sum(sizes.values()) / 2
    together = {pair for ids in held.values() for pair in itertools.combinations(sorted(ids), 2)}
    assert set(itertools.combinations(range(40), 2)) <= together  # every pair meets


def test_a_small_graph_is_written_in_few_files(spark):
    """Whatever the number of shuffle partitions: a step of the search writes no more files than its edges need."""
    before = set(shared_files(spark))
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = connected_components(spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long"), "few-files").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.component for r in got} == {0} and len(got) == 301
    folders = Counter(f.parent.name for f in set(shared_files(spark)) - before if f.parent.name.startswith("few-files"))
    assert len(folders) > 4 and sorted(folders.values())[-2] <= LEAST_FILES  # but for the first, whose edges are not counted yet


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (300, 200), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100}


def test_language_model(docs):
    rows = docs.select("doc_id", "text").collect()
    data = [(r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2, words_of(r[1]) + ["\0"]) for r in rows]
    train = [w for _, h, w in data if not h]
    c = {}
    for w in itertools.chain(*train):
        c[w] = c.get(w, 0) + 1
    total, kinds = sum(c.values()), len(c)
    history = c | {None: len(train)}
    pair = {}
    for w in train:
        for v, x in zip([None, *w], w):
            pair[v, x] = pair.get((v, x), 0) + 1
    once, twice = (sum(n == k for n in pair.values()) for k in (1, 2))
    discount = (once + 1) / (once + 2 * twice + 2)
    fan = {}
    for v, _ in pair:
        fan[v] = fan.get(v, 0) + 1
    root = lambda x: (c.get(x, 0) + 1) / (total + kinds + 1)
    chance = lambda v, x: (max(pair.get((v, x), 0) - discount, 0) + discount * fan.get(v, 0) * root(x)) / history[v] if v in history and v != "\0" else root(x)
    # a state's chances add up to one over the vocabulary and one unseen word
    assert sum(chance(None, x) for x in [*c, "unseen"]) == pytest.approx(1)
    want = sorted((str(i), h, len(w), sum(x in c for x in w), round(sum(math.log10(root(x)) for x in w), 6), round(sum(math.log10(chance(v, x)) for v, x in zip([None, *w], w)), 6)) for i, h, w in data)
    assert 0 < once and 0 < twice
    for options in ({"block_bytes": 500}, {}, {"block_bytes": 500, "heavy_bytes": 1}, {"block_bytes": 2000, "heavy_bytes": 9}):
        got = backoff_lm.score_texts(docs, **options).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_language_model_reads_many_equal_rows_as_one(spark, monkeypatch):
    monkeypatch.setattr(backoff_lm, "TOGETHER", 7)
    rows = [(None, "a b a c")] * 40 + [(i, f"a b {'c' * (i % 3)} d") for i in range(30)]
    read = lambda heavy: sorted((str(r.doc_id), r.n_known, round(r.score, 9)) for r in backoff_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=100, heavy_bytes=heavy).collect())
    assert len(read(100)) == 70 and read(100) == read(1 << 30)


def test_language_model_has_every_bigram_whatever_words_are_common(docs):
    """Bigrams of words below the common share count too: the share only decides where they are counted."""
    read = lambda **k: sorted((str(r.doc_id), r.n_known, round(r.score, 6)) for r in backoff_lm.score_texts(docs, **k).collect())
    assert read(share=0.04) == read(share=2.0, block_bytes=700) == read()


def test_urls(spark):
    urls = ["http://A.example.org/es/x?q", "https://example.org/en/12#t", "x://notexample.org/en/1", "http://spam.net", "http://ok.net/", None, "no scheme", "http://b.com/fr/://c", "http://b.com/de/", "http://m.Casino-win.com/zz", "http://a.org", "http://org/", "http://spamalot.net", "http://ads.com/de/1", "http://ads.com/de/2", "http://ads.com/fr/1", "HTTP://ADS.com/zz?q", "http://b.com/zz"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://spam.net", "h")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge_urls(pages).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow")
    assert got[3] == ("spam.net", "", None, "allow") and got[4] == ("ok.net", "/", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("b.com", "/fr/://c", "com/fr/", "allow") and got[8][2:] == ("com/de/", "block") and got[9][3] == "allow"
    assert got[10] == ("a.org", "", None, "allow") and got[11][2] == "org/" and got[None][3] == "allow"
    # rules block two pages of ads.com and allow one, but one each of b.com
    assert got[15][3] == "allow" and got[16] == ("ads.com", "/zz", None, "block") and got[17][3] == "allow"
    listed = spark.createDataFrame([("ok.net",), ("ok.net",), ("elsewhere.net",), (None,)], "host string")
    by_list = [{r.page_id: r.verdict for r in url_cascade.judge_urls(pages, listed, max_keys=k).collect()} for k in (1 << 25, 0)]
    assert by_list[0] == by_list[1] and by_list[0][4] == "block" and by_list[0][16] == "allow"
    assert url_cascade.judge_urls(pages.limit(0)).count() == 0
    keys = spark.range(3000).selectExpr("cast(id as string) AS key", "id % 7 = 0 AS listed")
    cascade = url_cascade.Cascade.build(keys)
    assert len(cascade.levels) > 2 and keys.where(cascade.contains("key") != F.col("listed")).count() == 0


def test_shards(docs):
    got = slot_sharding.shard_documents(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
    assert all(r.size == len((TEXTS[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((TEXTS[r.doc_id] or "").encode()) for r in got if r.doc_id is not None)


def test_a_hot_id_is_spread_over_the_shards(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i % 50}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = slot_sharding.shard_documents(docs).toPandas()
    held = got.groupby("shard")["size"].sum()
    assert len(got) == 3000 and len(held) == 8 and held.max() - held.min() < 0.02 * held.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)


def test_grown_map_keeps_most_slots(spark):
    loads = spark.range(4096).selectExpr("cast(id as int) AS vslot", "100 + id % 13 AS bytes", "1L AS rows")
    old = slot_sharding.rebalance(slot_sharding.first_map(loads))
    new = slot_sharding.rebalance(old, 9)
    moved = old.alias("a").join(new.alias("b"), "vslot").where("a.shard <> b.shard").count()
    sizes = [r[0] for r in new.groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert len(sizes) == 9 and max(sizes) - min(sizes) < 300 and moved < 4096 / 8


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [(i, [float(x) for x in base[i % 30] + rng.normal(size=8) * 0.05], i % 2 if i % 11 else None) for i in range(150)]
    rows += [(200, rows[1][1], 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, None, 1), (204, [1.0, None] * 4, 1), (205, [1.0], 1), (206, [2.0], 1), (None, rows[1][1], 1)]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<double>, label int, id string")
    sound = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    cos = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
    links = [(a[0], b[0]) for a, b in itertools.combinations(sound, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and cos(a[1], b[1]) >= 0.98]
    component = unions([r[0] for r in rows if r[0] is not None], links)
    n = {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    got = epsilon_grid.near_duplicate_vectors(table).collect()
    assert len(got) == len(rows) and len(links) > 50
    for r in got:
        assert (r.n_links, r.component_id) == (n.get(r.vec_id, 0), component.get(r.vec_id)) and r.kept == (r.vec_id is None or component[r.vec_id] == r.vec_id)
    assert epsilon_grid.near_duplicate_vectors(table.limit(0)).count() == 0


def test_leaks_with_other_values(spark):
    item = "A train travels 120 km in 3 hours from Paris to Lyon. How far does the train from Paris go in 7 hours?"
    swap = lambda *pairs: _swap(item, pairs)
    benchmark = spark.createDataFrame([(1, item, 0), (2, "short item", 0), (3, "", 0), (4, None, 0)], "item_id long, text string, h int")
    texts = ["Before. " + swap(("120", "90"), ("3", "2"), ("Paris", "Rome"), ("7", "9")) + " and more", "Before. " + swap(("120", "90"), ("from Paris go", "from Oslo go")), "nothing of it", None, "", "x short item y", item, item, "Short  ITEM."]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, plain string")
    got = {(r.doc_id, r.item_id): (r.hits, r.literal_hits, r.windows) for r in decontam.leaks(docs, benchmark).collect()}
    assert set(got) == {(0, 1), (6, 1), (7, 1), (8, 2)}
    assert got[0, 1][1] < got[0, 1][0] and got[6, 1][1] == got[6, 1][2]
    assert decontam.leaks(docs.limit(0), benchmark).count() == 0 and decontam.leaks(docs, benchmark.limit(0)).count() == 0


def test_leaks_of_placeholders_torn_slots_and_other_case(spark):
    names = "We saw Anna meet Bert, Carl, Dora, Emil, Fritz, Gina and Hans near Rome"
    story = "There are 5 boys and 5 girls in the class who read one book every month and write about it, then they swap the books among the tables and read again until all of them know every story. How many books does the class need for this"
    benchmark = spark.createDataFrame([(1, "12 + 7 * 5 - 3"), (2, names), (3, story)], "item_id long, text string")
    texts = ["look: 12 + 7 * 5 - 3 = 44", "look: 13 + 8 * 6 - 4 = 44", names.lower().replace(" ", "\n"), story.replace("5 boys and 5 girls", "6 boys and 4 girls"), story.replace("5 girls", "4 girls")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.hits, r.literal_hits, r.windows) for r in decontam.leaks(docs, benchmark).collect()}
    assert set(got) == {(0, 1), (2, 2), (3, 3), (4, 3)}
    assert got[0, 1] == (1, 1, 1) and len(set(got[2, 2])) == 1


def _swap(text, pairs):
    for a, b in pairs:
        text = text.replace(a, b)
    return text


def exponent_of(tokens, entropy, repeats):
    """The exponent by plain bisection over numpy weights."""
    p = np.array(sorted(tokens)) / sum(tokens)

    def high_enough(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum() / np.log(len(w)) >= entropy or ((p / p.max()) ** (a - 1)).max() > repeats

    low, high = 0.0, 1.0
    for _ in range(60):
        low, high = ((low + high) / 2, high) if high_enough((low + high) / 2) else (low, (low + high) / 2)
    return low


@pytest.mark.parametrize("entropy, repeats", [(0.97, 50.0), (0.9999, 3.0)])
def test_mixture_meets_its_weights_block_by_block(spark, monkeypatch, entropy, repeats):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(mixing, "PIECE", 100)
    rows = [(i, "w " * (1 + i % 9), "big" if i % 10 < 7 else f"s{i % 10}" if i % 10 < 9 else None) for i in range(4000)] + [(5000, None, "void"), (None, "w w", "s7"), (None, "w w", "s7")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, epoch int, tokens string")
    used = mixing.mix_sources(docs, entropy, repeats).toPandas()
    used["source"] = used.source.fillna("-")
    assert set(used.doc_id.dropna()) == {*range(4000), 5000} and used.doc_id.isna().sum() >= 2
    size, longest = {}, {}
    for _, text, source in rows:
        n = len((text or "").split())
        size[source or "-"], longest[source or "-"] = size.get(source or "-", 0) + n, max(longest.get(source or "-", 0), n)
    counted = {s: n for s, n in size.items() if n}
    a = exponent_of(list(counted.values()), entropy, repeats)
    z = sum(n**a for n in counted.values())
    amount = max(n**(1 - a) for n in counted.values()) * z
    blocks = int(used.block.max()) + 1
    assert blocks > 3
    for s, n in counted.items():
        weight, own = n**a / z, used[used.source == s]
        assert own.weight.iloc[0] == pytest.approx(weight, rel=1e-4)
        assert abs(own.tokens.sum() - weight * amount) <= longest[s] + 1e-3 * amount * weight
        # a document is used in every whole epoch, and once at most in the last
        uses = own[own.doc_id.notna()].groupby("doc_id").epoch.agg(["count", "nunique", "max"])
        assert (uses["count"] == uses["nunique"]).all() and (uses["count"] - weight * amount / n).abs().max() <= 1 + 1e-3
        # every block holds the source in its weight, but for a document on either edge
        per = own.groupby("block").tokens.sum().reindex(range(blocks), fill_value=0)
        assert (per - weight * amount / blocks).abs().max() <= 2 * longest[s] + 1e-3 * amount * weight
    assert used.groupby("block").tokens.sum().std() < 0.15 * used.groupby("block").tokens.sum().mean()
    assert max(own.epoch.max() for _, own in used.groupby("source")) + 1 <= math.ceil(repeats)
    orders = [used[(used.source == "big") & (used.epoch == e)].sort_values(["block", "place"]).doc_id.tolist() for e in (0, 1)]
    assert orders[0] != orders[1]
    again = mixing.resample(docs, entropy, repeats)
    assert again.columns == docs.columns and again.select("doc_id").distinct().count() == 4002
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.resample(docs.limit(0)).count() == 0


def test_mixture_of_one_source_and_of_none(spark):
    one = spark.createDataFrame([(i, "a b", "s") for i in range(20)], "doc_id long, text string, source string")
    assert mixing.mix_sources(one).count() == 20 and mixing.mix_sources(one.withColumn("text", F.lit(None).cast("string"))).count() == 20


def test_toxicity_learns_finds_misspellings_and_spares_quotes(spark):
    rng = random.Random(1)
    calm = lambda: " ".join(rng.choice(WORDS) for _ in range(40))
    rows, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        text = calm() + (" you blithering nincompoop " + calm() if bad else "") + calm()
        rows.append((i, text))
        if i < 1000:
            labels.append((i, int(bad)))
    extra = [(5000, calm() + " you nincompop and nincompoopp " + calm()), (5001, None), (5002, ""), (None, "nincompoop nincompoop"), (5003, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows + extra], "doc_id long, text string, exact int")
    truth = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, truth).collect()}
    assert len(got) == 1205 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].predicted == int(i % 6 == 0) for i in range(1200))
    assert got[5000].fuzzy == 2 and got[5000].predicted == 1 and got[5001].predicted == got[5002].predicted == 0 and not got[None].held_out
    kept = toxicity.drop_toxic(docs, truth)
    assert kept.columns == docs.columns and kept.count() == 1205 - 202
    assert toxicity.score_toxicity(docs.limit(0), truth).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(docs, truth.limit(0)).collect()} == {0}
    m = toxicity.Matcher(["moron"])
    assert m.features('he said "moron" to me')[2] == 1 and m.features("you moron")[2] == 0
    for word in ("moron", "mron", "mxron", "moroon", "oron", "moro"):
        assert m.trie.within_one(word) == ["moron"]
    assert m.trie.within_one("mrn") == [] and m.trie.within_one("morons!") == []
    m = toxicity.Matcher(["scum", "idiot", "moron"])
    assert [m.judge(w) for w in ("scum", "scvm", "scumm", "sucm", "csum", "scmu", "idoit", "moorn", "iidot", "sum", "scam", "sxum")] == [1, 2, 2, 2, 2, 2, 2, 2, 2, 0, 2, 2]
    alphabet, words = "abc", ["".join(w) for n in range(1, 6) for w in itertools.product("abc", repeat=n)]
    near = {w for w in words if _one_edit(w, "abca", alphabet)}
    assert {w for w in words if toxicity.Trie(["abca"]).within_one(w)} == near


def _one_edit(word, term, alphabet):
    cuts = [(term[:i], term[i:]) for i in range(len(term) + 1)]
    near = {term} | {a + c + b for a, b in cuts for c in alphabet} | {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in alphabet}
    return word in near | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}


def test_empty_tables(docs):
    none = docs.limit(0)
    for made in (suffix_dedup.remove_repeats(none), minhash_join.near_duplicates(none), backoff_lm.score_texts(none), slot_sharding.shard_documents(none)):
        assert made.count() == 0
