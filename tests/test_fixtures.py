"""Fixed small inputs with values computed by other means than the engine's."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from selfspan.functions import geometry
from selfspan.operators import affinity, anova, external, grid, internal, preparation, self_expression, spectral, validation


def hull_area(p):
    """Area of the convex hull: the greatest support in a fan of directions, by gift wrapping."""
    start = min(range(len(p)), key=lambda i: (p[i][0], p[i][1]))
    at, path = start, []
    while True:
        path.append(p[at])
        best = (at + 1) % len(p)
        for k in range(len(p)):
            cross = (p[best][0] - p[at][0]) * (p[k][1] - p[at][1]) - (p[best][1] - p[at][1]) * (p[k][0] - p[at][0])
            if cross < 0:
                best = k
        at = best
        if at == start:
            break
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(path, path[1:] + path[:1]))) / 2


def expected_features(pts):
    eps = 1e-8
    dist = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
    around = lambda p: sum(dist(a, b) for a, b in zip(p, p[1:] + p[:1]))
    area = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2
    left, right, top, bottom = (lambda p: min(p, key=lambda q: q[0])), (lambda p: max(p, key=lambda q: q[0])), (lambda p: min(p, key=lambda q: q[1])), (lambda p: max(p, key=lambda q: q[1]))
    bend = lambda p: np.polyfit(np.array(p)[:, 0] - np.mean(np.array(p)[:, 0]), np.array(p)[:, 1], 2)[0]
    mean = lambda p: tuple(np.mean(np.array(p), axis=0))
    regions = {name: [pts[i] for i in places] for name, places in geometry.REGIONS.items()}
    out = {}
    for side in ("Left", "Right"):
        p = regions[f"{side.lower()}_eye"]
        w, h, a, s = dist(left(p), right(p)), dist(top(p), bottom(p)), area(p), around(p)
        out |= {f"{side} Eye Width": w, f"{side} Eye Height": h, f"{side} EAR": h / (w + eps), f"{side} Eye Area": a, f"{side} Eye Perimeter": s, f"{side} Eye Circularity": 4 * math.pi * a / (s * s + eps), f"{side} Eye Solidity": a / (hull_area(p) + eps)}
        b = regions[f"{side.lower()}_brow"]
        inner, outer = left(b), right(b)
        w, h = dist(inner, outer), bottom(b)[1] - top(b)[1]
        out |= {f"{side} Brow Width": w, f"{side} Brow Height": h, f"{side} Brow Ratio": h / (w + eps), f"{side} Brow Slope": math.degrees(math.atan2(outer[1] - inner[1], outer[0] - inner[0])), f"{side} Brow Curvature": bend(b)}
    m = regions["mouth"]
    w, h, a, s = dist(left(m), right(m)), dist(top(m), bottom(m)), area(m), around(m)
    out |= {"Mouth Width": w, "Mouth Opening": h, "MAR": h / (w + eps), "Mouth Area": a, "Mouth Perimeter": s, "Mouth Circularity": 4 * math.pi * a / (s * s + eps), "Mouth Solidity": a / (hull_area(m) + eps), "Upper Lip Curvature": bend(m)}
    out |= {"Eye Symmetry": abs(out["Left EAR"] - out["Right EAR"]), "Inter-Eye Distance": dist(mean(regions["left_eye"]), mean(regions["right_eye"]))}
    out |= {"Inner Brow Distance": dist(left(regions["left_brow"]), left(regions["right_brow"])), "Brow Centre Distance": dist(mean(regions["left_brow"]), mean(regions["right_brow"]))}
    out |= {f"Eyebrow {n} Symmetry": abs(out[f"Left Brow {n}"] - out[f"Right Brow {n}"]) for n in ("Height", "Ratio", "Curvature")}
    return out | {"Eyebrow Slope Symmetry": abs(abs(out["Left Brow Slope"]) - abs(out["Right Brow Slope"]))}


def test_forty_features_of_two_faces(spark):
    rng = np.random.default_rng(12)
    faces = {n: [(float(40 * math.cos(k * 0.7) + x), float(30 * math.sin(k * 0.9) + y)) for k, (x, y) in enumerate(rng.normal(size=(106, 2)) * 4)] for n in ("a.jpg", "b.jpg")}
    table = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in p]) for n, p in faces.items()] + [("none.jpg", [])], "Image string, pts array<struct<x:double,y:double>>")
    made = geometry.face_features(table)
    assert made.columns[0] == "Image" and len(made.columns) == 41
    got = {r["Image"]: r.asDict() for r in made.collect()}
    assert set(got) == set(faces) and [tuple(r) for r in geometry.rejected(table).collect()] == [("none.jpg", "no landmarks")]
    for n, p in faces.items():
        want = expected_features(p)
        assert set(want) == set(made.columns[1:])
        for f, v in want.items():
            assert got[n][f] == pytest.approx(v, rel=1e-6, abs=1e-9), f
    groups = preparation.feature_groups([*made.columns[1:], "Unknown"])
    assert [len(g) for g in groups.values()] == [16, 8, 16] and not any("Unknown" in g for g in groups.values())
    weighed = {r.Feature: r.Weight for r in preparation.weight_table(spark, groups).collect()}
    assert weighed["Left EAR"] == 0.25 and weighed["MAR"] == 8**-0.5
    with pytest.raises(ValueError):
        geometry.face_features(table, enabled=["nose"])


def test_tied_extremes_take_the_first(spark):
    pts = [(1.0, 5.0), (0.0, 2.0), (0.0, 9.0), (3.0, 2.0), (3.0, 7.0)]
    p = F.col("pts")
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in pts],)], "pts array<struct<x:double,y:double>>")
    r = df.select(geometry.extreme(p, "x").alias("l"), geometry.extreme(p, "x", True).alias("r"), geometry.extreme(p, "y").alias("t")).first()
    assert (r.l.y, r.r.y, r.t.x) == (2.0, 2.0, 0.0)


def test_nulls_table(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", 1.0, nan, 5.0, None), ("b", None, 2.0, 5.0, None), ("b", 4.0, inf, 5.0, None), ("d", 7.0, -inf, None, None)], "Image string, x double, y double, same double, gone double")
    found = {r.feature: (r.missing, r.infinite, r.constant) for r in validation.column_checks(df, ["x", "y", "same", "gone"]).collect()}
    assert found == {"x": (1, 0, False), "y": (1, 2, False), "same": (1, 0, True), "gone": (4, 0, True)}
    report = {(r.check, r.subject): r.value for r in validation.validation_report(df, "Image").collect()}
    assert report["duplicate ids", "Image"] == "1" and report["infinite", "y"] == "2" and ("missing", "gone") in report
    part = df.select("Image", "x")
    assert [r.x for r in preparation.impute(part, "mean", "Image").orderBy("x").collect()] == [1, 4, 4, 7] and [r.x for r in preparation.impute(part, "median", "Image").orderBy("x").collect()] == [1, 4, 4, 7]
    assert [r.x for r in preparation.impute(part, "zero", "Image").orderBy("x").collect()] == [0, 1, 4, 7] and preparation.impute(part, "drop", "Image").count() == 3


def test_scale_table(spark):
    df = spark.createDataFrame([(str(x), float(x)) for x in (1, 2, 4, 10)], "Image string, x double")
    values = lambda m: [r.x for r in preparation.scale(df, m, "Image").orderBy("x").collect()]
    assert values("standard") == pytest.approx([(x - 4.25) / (4.0311288741492755 + 1e-8) for x in (1, 2, 4, 10)]) and values("minmax") == pytest.approx([(x - 1) / (9 + 1e-8) for x in (1, 2, 4, 10)])
    assert values("robust") == pytest.approx([(x - 3.0) / (5.5 - 1.75 + 1e-8) for x in (1, 2, 4, 10)])
    r = {x.feature: (x.location, x.spread) for x in preparation.scale_statistics(df, "robust", "Image").collect()}
    assert r == {"x": (3.0, 3.75)}


def test_four_subspaces_converge(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(33, 3)) @ rng.normal(size=(3, 8)) + 0.05 * rng.normal(size=(33, 8)) for _ in range(4)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    for method in self_expression.METHODS.values():
        found = method(rows, "id")
        assert found.converged and found.summary().first()["iterations"] < 60


def test_block_graph_and_isolated_node(spark):
    w = [(i, j, 1.0) for b in range(3) for i in range(4 * b, 4 * b + 4) for j in range(4 * b, 4 * b + 4) if i != j]
    graph = spark.createDataFrame(w, "i long, j long, w double")
    labels = spectral.cluster_nodes(graph, list(range(12)), [3]).join(spark.createDataFrame([(i, i // 4) for i in range(12)], "node long, label int"), "node")
    assert external.scores(external.contingency(labels, "cluster", "label")).first()["ARI"] == 1
    spectrum = affinity.laplacian_spectrum(graph, list(range(12))).orderBy("place").collect()
    assert [round(r.eigenvalue, 12) for r in spectrum[:3]] == [0, 0, 0] and max(spectrum[:-1], key=lambda r: r.gap).place == 3
    lonely = affinity.laplacian_spectrum(graph, list(range(13))).orderBy("place").collect()
    assert len(lonely) == 13 and [round(r.eigenvalue, 12) for r in lonely[:4]] == [0, 0, 0, 0]
    known = spark.createDataFrame([(i, i // 4) for i in range(13)], "node long, cluster int")
    assert affinity.normalised_cut(graph, known).first()["ncut"] == 0 and affinity.affinity_ratio(graph, known).first()["ratio"] == math.inf


def test_labels_renamed_and_degenerate(spark):
    same = spark.createDataFrame([(i % 4, (i % 4 + 1) % 4) for i in range(40)], "a int, b int")
    r = external.scores(external.contingency(same, "a", "b")).first()
    assert (r.ARI, r.Purity) == (1, 1) and r.NMI == pytest.approx(1)
    rows = spark.createDataFrame([(i, [float(i), 1.0], 0, i) for i in range(6)], "id long, features array<double>, one long, each long")
    for c in ("one", "each"):
        assert internal.silhouette(rows, "id", c).first()["silhouette"] is None and internal.davies_bouldin(rows, c).first()["dbi"] is None and internal.calinski_harabasz(rows, c).first()["chi"] is None


def test_anova_of_known_groups(spark):
    rows = [("a", v, 1.0) for v in (1.0, 2.0, 3.0)] + [("b", v, 1.0) for v in (2.0, 4.0, 6.0)] + [("c", 5.0, 1.0), ("d", None, 1.0), (None, 3.0, 1.0)]
    got = {r.feature: r for r in anova.anova(spark.createDataFrame(rows, "g string, x double, flat double"), "g", ["x", "flat"]).collect()}
    # two groups of three remain: means 2 and 4, squares within 2 and 8
    assert (got["x"].groups, got["x"].n) == (2, 6) and got["x"].f == pytest.approx(6 / (10 / 4)) and got["x"].eta_squared == pytest.approx(6 / 16) and got["flat"].eta_squared is None
    assert got["x"].p_value == pytest.approx(0.196, abs=1e-3)


def test_grid_of_ties_failures_and_unconverged_points(spark):
    rows = [(a, b, 0.5, True, None) for a in (1.0, 2.0) for b in (1.0, 2.0)] + [(3.0, 1.0, 0.9, False, None), (3.0, 2.0, None, False, "ValueError: x"), (4.0, 1.0, float("nan"), True, None)]
    results = spark.createDataFrame(rows, "lambda double, gamma double, ARI double, Converged boolean, Error string")
    best = lambda p: tuple(grid.best_rows(results, ["ARI"], p).select("lambda", "gamma").first())
    assert best(True) == (1.0, 1.0) and best(False) == (3.0, 1.0)
    wide = grid.pivot_grid(results, "ARI").collect()
    assert [r["gamma"] for r in wide] == [1.0, 2.0] and wide[1]["3.0"] is None and grid.surface(results, "ARI").where("best").count() == 1
