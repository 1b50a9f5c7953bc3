"""Cases that whole tables rarely hold: missing p values, separated groups, query sets, offsets, files that change."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from selfspan.functions import geometry
from selfspan.operators import anova, decomposition, internal
from selfspan.plans import stages
from selfspan.plans.ledger import Ledger, content_digest, environment


def test_a_missing_p_value_is_no_test(spark):
    p = spark.createDataFrame([(None,), (float("nan"),), *((k / 100,) for k in range(1, 6))], "p_value double")
    got = anova.adjust(p).collect()
    known = [r for r in got if r.p_value is not None and r.p_value == r.p_value]
    assert {round(r.adjusted_p, 12) for r in known} == {0.05} and all(r.significant for r in known)
    rest = [r for r in got if r not in known]
    assert len(rest) == 2 and all(r.adjusted_p is None and r.significant is False for r in rest)


def test_separated_and_constant_features(spark):
    rows = [(i, i % 3, float(i % 3), float(i * 7 % 5), 0.1) for i in range(30)]
    got = {r.feature: r for r in anova.anova(spark.createDataFrame(rows, "id int, c int, sep double, noise double, const double"), "c", ["sep", "noise", "const"]).collect()}
    assert got["sep"].f == math.inf and got["sep"].p_value == 0 and got["sep"].adjusted_p == 0 and got["sep"].significant and got["sep"].eta_squared == pytest.approx(1)
    assert got["const"].f is None and got["const"].p_value is None and got["const"].adjusted_p is None and not got["const"].significant
    assert got["noise"].adjusted_p == pytest.approx(got["noise"].p_value)  # of two tests, the larger


@pytest.mark.parametrize("offset", [0.0, 1e7])
def test_silhouette_of_a_query_set(spark, offset):
    rng = np.random.default_rng(4)
    x, c = rng.normal(0, 1, (60, 3)) + np.repeat([[0], [2], [4]], 20, axis=0) + offset, np.repeat([0, 1, 2], 20)
    order = rng.permutation(60)
    df = spark.createDataFrame([(int(i), int(c[i]), x[i].tolist()) for i in order], "id long, c long, features array<double>").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(0, 60, 5):
        a, b = d[i, c == c[i]].sum() / 19, min(d[i, c == k].mean() for k in range(3) if k != c[i])
        s.append((b - a) / max(a, b))
    got = internal.silhouette(df, "id", "c", query="id % 5 = 0").first()
    assert got.rows == 12 and got.silhouette == pytest.approx(np.mean(s), rel=1e-6 if offset else 1e-12)


def test_components_under_a_common_offset(spark):
    x = np.random.default_rng(3).normal(size=(300, 5)) * [5, 3, 2, 1, 0.5]
    plain, moved = (decomposition.fit_components(spark.createDataFrame([(v.tolist(),) for v in y], "features array<double>").repartition(4), threshold=0.9) for y in (x, x + 1e7))
    assert np.allclose(plain.ratios, moved.ratios, rtol=1e-6) and plain.k == moved.k
    gram = {(r.i, r.j): r.g for r in decomposition.centred_gram(spark.createDataFrame([(v.tolist(),) for v in x + 1e7], "features array<double>")).collect()}
    centred = x - x.mean(axis=0)
    assert all(gram[i, j] == pytest.approx((centred.T @ centred)[i, j], rel=1e-5, abs=1e-4) for i in range(5) for j in range(i, 5))


def faces(seed):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(size=(10, 2)) @ rng.normal(size=(2, 6)) + 0.01 * rng.normal(size=(10, 6)) for _ in range(2)])
    return [(i, *v) for i, v in enumerate(x.tolist())]


def test_another_session_takes_up_what_is_done(spark, tmp_path):
    schema, path = "id long, " + ", ".join(f"f{k} double" for k in range(6)), f"{tmp_path}/features"
    spark.createDataFrame(faces(1), schema).repartition(2).write.parquet(path)
    s, ledger = stages.Settings(id_col="id", components=3, clusters=2, strict=False), Ledger(f"{tmp_path}/ledger")

    def session(settings=s, until=6):
        run = stages.run_stages(stages.start(settings, spark.read.parquet(path)), stages.select_stages(2, until), ledger=ledger)
        return run, [r["status"] for r in run.records]

    first, status = session(until=4)
    assert status == ["done"] * 3
    again, status = session()
    assert status == ["skipped"] * 3 + ["done"] * 2
    assert sorted(again.tables["coefficients"].collect()) == sorted(first.tables["coefficients"].collect())
    assert again.tables["labels"].count() == 20
    # the same rows in other files and another order are the same content
    spark.createDataFrame(faces(1)[::-1], schema).repartition(5).write.mode("overwrite").parquet(path)
    assert session()[1] == ["skipped"] * 5
    # other rows under the same path are not, nor are other settings
    spark.createDataFrame(faces(2), schema).write.mode("overwrite").parquet(path)
    changed, status = session()
    assert status == ["done"] * 5
    assert sorted(changed.tables["scores"].collect()) != sorted(first.tables["scores"].collect())
    assert session(stages.Settings(id_col="id", components=2, clusters=2, strict=False))[1] == ["done"] * 5


def test_a_failed_stage_is_run_again(spark, tmp_path):
    ledger = Ledger(f"{tmp_path}/ledger")
    features = spark.createDataFrame(faces(1), "id long, " + ", ".join(f"f{k} double" for k in range(6)))
    bad = stages.Settings(id_col="id", components=3, clusters=2, sparse=stages.self_expression.Solver(0.02, 0.4, max_iter=2))
    for _ in range(2):
        run = stages.run_stages(stages.start(bad, features), [2, 3, 4], keep_going=True, ledger=ledger)
    assert [r["status"] for r in run.records] == ["skipped", "skipped", "failed"]


def test_digests_and_run_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0]), (1, "a", [1.0]), (2, None, None)], "x long, y string, z array<double>")
    assert content_digest(df) == content_digest(df.repartition(3)) != content_digest(df.distinct())
    assert content_digest(df) != content_digest(df.withColumn("x", F.col("x") + 1)) and content_digest(df) != content_digest(df.withColumnRenamed("x", "w"))
    run = stages.run_stages(stages.start(stages.Settings(id_col="id", components=3), spark.createDataFrame(faces(1), "id long, " + ", ".join(f"f{k} double" for k in range(6)))), [2, 3])
    folder = stages.save(run, f"{tmp_path}/run")
    assert spark.read.option("header", True).csv(f"{folder}/scores").count() == 20
    assert '"stage": 3' in spark.read.text(f"{folder}/manifest").first()[0] and environment(spark)["spark"] in spark.read.text(f"{folder}/environment").first()[0]


def test_hulls(spark):
    rng = np.random.default_rng(12)
    shapes = [rng.normal(size=(n, 2)).tolist() for n in (3, 4, 9, 60, 106)] + [rng.integers(0, 4, (40, 2)).tolist(), [[0, 0], [2, 0], [2, 2], [0, 2], [1, 0], [1, 1], [2, 0]], [[0, 0], [1, 1], [2, 2]], [[1, 1], [1, 1], [2, 5]], [[3, 4]], []]
    shapes.append((rng.normal(size=(30, 2)) + 1e9).tolist())

    def by_wrapping(p):
        p = np.unique(np.array(p, float).reshape(-1, 2), axis=0)
        if len(p) < 3:
            return None
        at, hull = p[0], []
        while not hull or not np.array_equal(at, hull[0]):
            hull.append(at)
            best = next(q for q in p if not np.array_equal(q, at))
            for q in p:
                turn = (best[0] - at[0]) * (q[1] - at[1]) - (best[1] - at[1]) * (q[0] - at[0])
                if turn < 0 or (turn == 0 and ((q - at) ** 2).sum() > ((best - at) ** 2).sum()):
                    best = q
            at = best
        h = np.array(hull) - hull[0]
        return 0.5 * abs((h[:, 0] * np.roll(h[:, 1], -1) - np.roll(h[:, 0], -1) * h[:, 1]).sum()) or None

    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(shapes)] + [(99, None)], "id int, pts array<struct<x: double, y: double>>")
    got = {r.id: r.area for r in df.select("id", geometry.hull_area(F.col("pts")).alias("area")).collect()}
    assert got.pop(99) is None
    for i, p in enumerate(shapes):
        want = by_wrapping(p)
        assert (got[i] is None and want is None) or got[i] == pytest.approx(want, rel=1e-9)
