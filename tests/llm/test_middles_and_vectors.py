"""Fill-in-the-middle, nearest neighbours and whitening against plain computations, odd rows included."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from selfspan.llm import collision_search, middle_filling, queries, whitening

random.seed(11)
SPACES = [" ", "\n", "\t\r", "  ", "\x0b\x0c", "\x1c", " "]
LONG = "".join(random.choice(["wo", "r", "é", "\U0001f600", " ", "\n"]) for _ in range(300_000))
TEXTS = [None, "", " ", "a", " a", "a ", "tail  \n", "one <P> mark", "<M>", "<S", "P>", "<", "a<\nb>", LONG] + ["".join(random.choice(["x", "yz", "<", "é", "\U0001f600"]) + random.choice(SPACES) for _ in range(random.randint(1, 40))) for _ in range(200)]


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out = "plain", text
    elif h[3] % 100 < 80:
        form, out = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, out = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    lengths = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (doc_id, n, form, *lengths, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def saved(spark, df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_middles_equal_plain_computation(spark, tmp_path):
    rows = [(i, t, i, "x", 3) for i, t in enumerate(TEXTS)] + [(None, "a b c d e", 1, "x", 3), (-7, "a b c", 1, "x", 3), (5, TEXTS[5], 5, "x", 3)]
    folder = saved(spark, spark.createDataFrame(rows, "doc_id long, text string, n long, form string, first int").repartition(3), tmp_path, "documents")
    got = queries.op11_repeated_capture_fim(spark, folder).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted((brute(r[0], r[1]) for r in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_middles_of_other_sentinels_are_restored(spark):
    marks = ("[pre.]", "[suf|]", "[mid*]")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    out = middle_filling.fill_in_middle(docs, seed=1, kept_share=100, spm_share=50, sentinels=marks)
    back = out.select("doc_id", "form", middle_filling.restore(F.col("output"), F.col("form"), marks).alias("back")).collect()
    assert all(r["back"] == (TEXTS[r["doc_id"]] or "") for r in back)
    assert sum(r["form"] == "plain" for r in back) == 2  # the null and the empty text


def test_middles_of_an_empty_table(spark):
    assert middle_filling.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 20 + 1, width))
    return [[float(np.float32(x)) for x in centres[i % len(centres)] + rng.standard_normal(width) * (0.05 if i % 3 else 1.0)] for i in range(n)]


ODD = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23]


def nearest_by_hand(rows, every=50, nearest=5):
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    width = max(len(v) for _, v in sound)
    filled = [(i, np.array([*v, *[0.0] * (width - len(v))])) for i, v in sound]
    out = {}
    for i, v in filled:
        if i % every == 0:
            scores = sorted((-round(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), 12), j) for j, w in filled if j != i)
            out[i] = [(j, -s) for s, j in scores[:nearest]]
    return out


def test_neighbours_equal_brute_force(spark):
    base = vectors(3000, 24, 3)
    rows = list(enumerate(base)) + [(5000 + i, base[100]) for i in range(900)] + [(7000 + i, v) for i, v in enumerate(ODD)] + [(8000, [2.0, 1.0]), (8001, [2.0]), (None, base[3])] + [(50, base[50])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(5)
    got = collision_search.nearest_vectors(df).collect()
    want = nearest_by_hand(rows)
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert by_query.keys() == want.keys()
    hits = 0
    for i, found in by_query.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(found, found[1:], strict=False))
        hits += len({j for _, j, _ in found} & {j for j, _ in want[i]})
    assert hits >= 0.97 * 5 * len(want)
    assert [j for _, j, _ in by_query[5000]] == [100, 5001, 5002, 5003, 5004]  # ties by id
    exact = {i: dict(w) for i, w in want.items()}
    assert all(abs(s - exact[i][j]) < 1e-9 for i, f in by_query.items() for _, j, s in f if j in exact[i])


def test_neighbours_of_few_and_of_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = collision_search.nearest_vectors(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], schema)).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in few) == [(1, 1, 0.0), (2, 2, -1.0)]
    assert collision_search.nearest_vectors(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert collision_search.nearest_vectors(spark.createDataFrame([], schema)).count() == 0
    assert collision_search.nearest_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema)).count() == 0


def test_widest_and_smallest_numbers(spark):
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, -1e300]), (3, [1e-300, 2e-300])]
    got = collision_search.nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 3, 2]


def whitened_by_hand(rows, components=4):
    sound = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in sound)
    x = [[int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)) for _, v in sound]
    fit = np.array(sorted(set(map(tuple, x))))
    n, s = len(fit), fit.sum(axis=0)
    values, basis = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(width, width))
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    whitened = (np.array(x) - s / n) @ basis / np.sqrt(values)
    deviation = [sum((n * a - int(b)) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    return n, [i for i, _ in sound], deviation, whitened, values / np.trace(np.cov(fit.T.astype(float), bias=True).reshape(width, width))


def test_whitening_equals_eigh(spark):
    base = [[v * (1 + 3 / (j + 1)) for j, v in enumerate(row)] for row in vectors(500, 24, 4)]
    rows = list(enumerate(base)) + [(1000 + i, base[7]) for i in range(200)] + [(2000 + i, v) for i, v in enumerate(ODD)] + [(None, base[9]), (3000, [0.5, -0.25])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, n int").repartition(4)
    got = whitening.whiten(df).toPandas()
    n, ids, deviation, whitened, explained = whitened_by_hand(rows)
    assert set(got.n) == {n} and len(got) == 4 * len(ids) and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    known = got[got.vec_id.notna()].sort_values(["vec_id", "component"])
    order = sorted((i, k) for k, i in enumerate(ids) if i is not None)
    mine = known.whitened.to_numpy().reshape(-1, 4)
    true = whitened[[k for _, k in order]]
    assert np.abs(mine - true * np.sign((mine * true).sum(axis=0))).max() < 1e-9
    assert known.deviation.to_numpy().reshape(-1, 4)[:, 0].tolist() == [deviation[k] for _, k in order]
    assert np.allclose(known.explained.to_numpy().reshape(-1, 4), explained, rtol=1e-10)


def test_whitening_of_flat_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, -float(i)]) for i in range(9)], schema)).collect()
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)
    huge = whitening.whiten(spark.createDataFrame([(0, [1e10, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 5.0])], schema)).collect()
    by_id = {r["vec_id"]: r["deviation"] for r in huge}
    x, s = [[2560000000000, 0], [0, 256], [0, 1280]], [2560000000000, 1536]
    exact = [sum((3 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x]
    assert by_id == {i: (v if v < 2**63 else None) for i, v in enumerate(exact)}


@pytest.mark.parametrize("values", [[5.0, 5.0, 1.0, 1.0], [4.0, 3.0, 2.0, 1.0], [1.0, 0.0, 0.0, 0.0], [3.0, 3.0 - 1e-9, 1.0, 0.5]])
def test_components_of_ties(values):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((4, 4)))[0]
    a = (q * values) @ q.T
    e, v = whitening.leading_components((a + a.T) / 2, 4)
    assert np.allclose(e, values, atol=1e-12) and np.allclose(v.T @ v, np.eye(4), atol=1e-12) and np.allclose(a @ v, v * e, atol=1e-12)


def test_polar_factor_of_nearly_singular_matrices():
    rng = np.random.default_rng(8)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    values = np.concatenate((np.geomspace(1, 1e-13, 15), -np.geomspace(1, 1e-13, 15)))
    a = (q * values) @ q.T
    u = whitening.polar_factor((a + a.T) / 2)
    assert np.allclose(u @ u, np.eye(30), atol=1e-10)
