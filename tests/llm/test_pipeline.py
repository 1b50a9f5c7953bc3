"""The pipeline's stages over small tables with nulls, empty and long texts, repeats, several texts of an id, clashing columns."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from selfspan.llm import mixing

RNG = random.Random(11)
WORDS = [a + b + c for a in "bdfgk" for b in ("an", "or", "el", "it") for c in ("", "en", "us")]
prose = lambda n: " ".join(RNG.choice(WORDS) for _ in range(n))
ITEM = "A train travels 120 km in 3 hours from Paris to Lyon. How far does the train from Paris go in 7 hours?"
BASE = prose(150)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, near_rows long, mix_key string, times int, hot int, i long, first long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(documents by text, folder): what each document is, and where the tables lie."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        rows.append((i, prose(40) + (" you blithering nincompoop " if bad else " ") + prose(40)))
        labels.append((i, int(bad)))
    near = BASE.split()
    near[70] = "changed"
    odd = [(1000, BASE), (1001, BASE), (1002, " ".join(near)), (None, BASE), (None, " ".join(near) + " end"), (1003, prose(60)), (1003, BASE + " " + "more"), (1003, prose(55)), (None, prose(50))]
    odd += [(1010, None), (1011, ""), (1012, ""), (1013, " \n"), (None, None), (1014, "x" * 300_000), (1015, prose(60_000)), (1016, "two words"), (1017, "Two words")]
    odd += [(1020, prose(30) + " " + ITEM), (None, prose(20) + " " + ITEM.replace("120", "90").replace("7", "9")), (1021, prose(30)), (1021, prose(30) + " " + ITEM), odd[0], (1022, "a nincompop blithering nincompoop")]
    rows += odd
    docs = spark.createDataFrame([(*r, "en", f"s{k % 3}" if k % 7 else None, 1, "r", 2, 3, "m", 4, 5, 6, 7) for k, r in enumerate(rows)], COLUMNS)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, folder


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def test_each_stage_decides_as_brute_force_does(spark, tables):
    rows, folder = tables
    read = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    want = sorted(((i, t) for i, t in rows if "nincompoop" not in (t or "")), key=str)
    assert clean.columns == docs.columns and read(clean) == want

    once = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    texts = sorted({(i, t) for i, t in rows}, key=str)
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root = [root[a] if r == root[b] else r for r in root]
    got = read(once)
    assert once.columns == docs.columns and len(got) == len(set(got)) == len(set(root))
    at = {x: root[k] for k, x in enumerate(texts)}
    assert len({at[x] for x in got}) == len(got) and (1000, BASE) in got
    assert {(1003, rows[605][1]), (1003, rows[607][1])} <= set(got)  # different texts of one id

    left = corpus_pipeline.drop_leaks(spark, docs, folder)
    assert left.columns == docs.columns and read(left) == sorted(((i, t) for i, t in rows if "train travels" not in (t or "")), key=str)

    mixed = corpus_pipeline.mix(spark, docs, folder)
    uses = mixed.groupBy("doc_id", "text").count().toPandas()
    assert mixed.columns == docs.columns and set(zip(uses.doc_id.fillna(-1), uses.text.fillna("-"))) == {(-1 if i is None else i, t or ("" if t == "" else "-")) for i, t in rows}
    assert mixed.groupBy("doc_id", "text", "source").count().agg(F.max("count")).first()[0] <= 2 * corpus_pipeline.REPEATS


def test_stages_take_empty_tables(spark, tables):
    _, folder = tables
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, none, folder)
        assert made.count() == 0 and (name == "sharding" or made.columns == none.columns)


def test_run_shards_what_the_stages_keep(spark, tables):
    rows, folder = tables
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert (got.law == "bytes").all() and all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    ids = set(got.doc_id.dropna())
    assert 1000 in ids and not {0, 6, 1001, 1002, 1020, 1022} & ids and 1003 in ids and {1010, 1011, 1014, 1015, 1021} <= ids
