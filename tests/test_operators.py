import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from selfspan.functions import geometry
from selfspan.operators import affinity, anova, decomposition, external, grid, internal, joins, preparation, self_expression, spectral, stability, validation, views
from selfspan.operators import lasso as lasso_all
from selfspan.plans import stages
from selfspan.sources import files


def test_geometry(spark):
    square, bow = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)]
    parabola = [(x + 10.0, 3.0 * x * x - 2 * x + 1) for x in range(9)]
    df = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in p]) for n, p in (("square", square), ("bow", bow), ("parabola", parabola))], "id string, pts array<struct<x:double,y:double>>")
    p = F.col("pts")
    r = {x.id: x for x in df.select("id", geometry.polygon_area(p).alias("area"), geometry.perimeter(p).alias("around"), geometry.quadratic_curvature(p).alias("curve"), geometry.solidity(p).alias("solid"), geometry.extreme(p, "x")["y"].alias("left")).collect()}
    assert (r["square"].area, r["square"].around, r["square"].left) == (1, 4, 0) and r["square"].solid == pytest.approx(1)
    assert r["bow"].area == 0 and r["parabola"].curve == pytest.approx(3)
    with pytest.raises(ValueError):
        geometry.register_plugin("eyes")(geometry.eyes)


def test_checks_imputation_and_scaling(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, float("nan")), ("b", 4.0, 1.0), (None, 10.0, None), ("c", float("inf"), 1.0)], "Image string, x double, one double")
    found = {r.feature: (r.missing, r.infinite, r.constant) for r in validation.column_checks(df, ["x", "one"]).collect()}
    assert found == {"x": (0, 1, False), "one": (2, 0, True)}
    assert validation.duplicate_ids(df, "Image").first()[0] == 1
    with pytest.raises(ValueError):
        validation.validation_report(df.limit(0), "Image")
    part = df.where("x < 100").select("Image", "x")
    assert [round(r.x, 6) for r in preparation.scale(part, "robust").orderBy("x").collect()] == [round((x - 3) / (5.5 - 1.75 + 1e-8), 6) for x in (1, 2, 4, 10)]
    assert preparation.impute(df, "drop").count() == 3 and preparation.impute(df.select("one"), "mean").agg(F.sum("one")).first()[0] == 5
    with pytest.raises(ValueError):
        preparation.impute(df, "other")
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(501, 2)), 2)
    table = spark.createDataFrame([(float(a), float(b) if b > -1 else None) for a, b in x], "a double, b double")
    got = preparation.quantiles(table, {f"{c}{p}": (c, p) for c in "ab" for p in (0.0, 0.25, 0.5, 0.9, 1.0)}).first().asDict()
    assert all(got[f"{c}{p}"] == pytest.approx(np.quantile(v, p)) for c, v in (("a", x[:, 0]), ("b", x[:, 1][x[:, 1] > -1])) for p in (0.0, 0.25, 0.5, 0.9, 1.0))


def test_groups_and_weights():
    groups = preparation.feature_groups(["Left EAR", "Mouth Area", "Left Brow Width", "Other"])
    assert groups == {"Eyes": ["Left EAR"], "Mouth": ["Mouth Area"], "Eyebrows": ["Left Brow Width"]}
    assert preparation.group_weight(16) == 0.25 and preparation.group_weight(4, "inverse") == 0.25


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    assert joins.strict_join(left, left.select("k"), "k").count() == 2
    for bad in ([(1,), (1,)], [(1,), (3,)], [(1,), (None,)]):
        with pytest.raises(ValueError):
            joins.strict_join(left, spark.createDataFrame(bad, "k int"), "k")


def test_external_scores(spark):
    same = spark.createDataFrame([(i % 3, "xyz"[i % 3]) for i in range(30)], "c int, l string")
    r = external.scores(external.contingency(same, "c", "l")).first()
    assert (r.ARI, r.Purity) == (1, 1) and r.NMI == pytest.approx(1)
    one = external.scores(external.contingency(same.withColumn("c", F.lit(0)).withColumn("l", F.lit("x")), "c", "l")).first()
    assert (one.ARI, one.NMI, one.Purity) == (1, 1, 1)


def test_internal_scores_and_guards(spark):
    rng = np.random.default_rng(0)
    x = np.vstack((rng.normal(0, 1, (20, 3)), rng.normal(4, 1, (30, 3)), [[9.0, 9, 9]]))
    c = np.array([0] * 20 + [1] * 30 + [2])
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(c, x, strict=True))], "id long, c long, features array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = (c == c[i]).sum() - 1
        a, b = (d[i, c == c[i]].sum() / own if own else None), min(d[i, c == k].mean() for k in {0, 1, 2} - {c[i]})
        s.append((b - a) / max(a, b) if own else 0)
    assert internal.silhouette(df, "id", "c").first()[0] == pytest.approx(np.mean(s))
    trivial = df.withColumn("c", F.lit(0).cast("long"))
    assert internal.silhouette(trivial, "id", "c").first()[0] is None and internal.davies_bouldin(trivial, "c").first()[0] is None and internal.calinski_harabasz(trivial, "c").first()[0] is None


def test_anova():
    assert anova.f_tail(4.0, 2, 10) == pytest.approx(0.0529, abs=2e-4)
    assert anova.f_tail(1.0, 1, 1) == pytest.approx(0.5) and anova.f_tail(0, 3, 3) == 1


def test_adjusted_p_values(spark):
    p = spark.createDataFrame([(k / 100,) for k in range(1, 6)], "p_value double")
    assert {round(r.adjusted_p, 12) for r in anova.adjust(p).collect()} == {0.05}


def test_affinity_scores(spark):
    w = spark.createDataFrame([(0, 1, -2.0), (2, 3, 1.0), (1, 1, 5.0)], "i long, j long, value double")
    graph = affinity.symmetric_affinity(w)
    assert {(r.i, r.j): r.w for r in graph.collect()} == {(0, 1): 1, (1, 0): 1, (2, 3): 0.5, (3, 2): 0.5}
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "node long, cluster long")
    assert affinity.affinity_ratio(graph, labels).first()[0] == math.inf and affinity.normalised_cut(graph, labels).first()[0] == 0
    spectrum = [r.eigenvalue for r in affinity.laplacian_spectrum(graph, [0, 1, 2, 3, 4]).orderBy("place").collect()]
    assert spectrum[:3] == [0, 0, 0] and max(spectrum) <= 2 + 1e-12


def subspaces(seed=1, n=12):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(size=(n, 2)) @ rng.normal(size=(2, 8)) + 0.01 * rng.normal(size=(n, 8)) for _ in range(3)]), np.repeat(np.arange(3), n)


def as_rows(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(parts)


def as_matrix(values, n, m=None):
    c = np.zeros((n, m or n))
    for r in values.collect():
        c[r.i, r.j] = r.value
    return c


def test_sparse_fit_does_not_depend_on_tasks(spark):
    x, _ = subspaces()
    got = self_expression.sparse_coefficients(as_rows(spark, x), "id")
    other = self_expression.sparse_coefficients(as_rows(spark, x, 1), "id")
    d = self_expression.unit_rows(x).T
    fit = self_expression.iterate(d, d, np.arange(len(x)), self_expression.SPARSE, False)
    c = as_matrix(got.values, len(x))
    assert np.abs(c - as_matrix(other.values, len(x))).max() < 1e-9 and np.diag(c).max() == 0
    assert fit.converged and got.converged and np.abs(c - fit.c).max() < 1e-4
    # the rows' residuals together are within the tolerance
    assert got.fits.agg(F.sum("residual2")).first()[0] < self_expression.SPARSE.tol**2
    info = {r.Property: r.Value for r in got.info().collect()}
    assert info["Converged"] == "true".title() and float(info["sparsity"]) > 0.1 and float(info["relative_error"]) < 1e-6 and len(info) > 22
    bar = max(1e-6 * np.abs(c).max(), 1e-10)
    assert float(info["active"]) == (np.abs(c) > bar).sum() and float(info["off_diagonal_density"]) == pytest.approx((np.abs(c) > bar).sum() / (len(x) * (len(x) - 1)))


def test_every_row_has_low_rank_coefficients(spark):
    x, truth = subspaces(n=30)
    d = self_expression.unit_rows(x).T
    whole = self_expression.low_rank_coefficients(as_rows(spark, x), "id")
    fit = self_expression.iterate(d, d, np.arange(len(x)), self_expression.LOW_RANK, True)
    assert np.abs(as_matrix(whole.values, len(x)) - fit.c).max() < 1e-5 and self_expression.effective_rank(whole.values, len(x)) == np.linalg.matrix_rank(fit.c, tol=1e-6 * np.linalg.norm(fit.c, 2))
    part = self_expression.low_rank_coefficients(as_rows(spark, x), "id", atoms=60)
    assert part.fits.select("j").distinct().count() == len(x) and part.summary().first()["rank"] <= 60
    # rows beyond the dictionary lie mostly on atoms of their own subspace
    ids, _ = self_expression.dictionary(as_rows(spark, x), "id", atoms=60)
    c = np.abs(as_matrix(part.values, len(x)))
    away = [j for j in range(len(x)) if j not in set(ids.tolist())]
    assert len(away) == 30 and np.mean([c[truth == truth[j], j].sum() / c[:, j].sum() for j in away]) > 0.5


def test_methods_of_a_point_fail_as_rows(spark):
    x, _ = subspaces()
    x[3, 0] = float("inf")
    for method in self_expression.METHODS.values():
        with np.errstate(all="ignore"):
            bad = method(as_rows(spark, x), "id", points=[(0.1, 0.4)])
        assert not bad.converged and bad.failures.count() == 1
    with pytest.raises(ValueError):
        validation.vector_gate(as_rows(spark, x), "id")
    with pytest.raises(ValueError):
        validation.vector_gate(as_rows(spark, x[5:]).union(as_rows(spark, x[5:6])), "id")
    validation.vector_gate(as_rows(spark, x[5:]), "id")


def test_subspaces_are_found(spark):
    x, truth = subspaces()
    d = self_expression.unit_rows(x).T
    for solver, low_rank in ((self_expression.SPARSE, False), (self_expression.LOW_RANK, True)):
        c = self_expression.iterate(d, d, np.arange(len(x)), solver, low_rank).c
        w = np.abs(c) + np.abs(c).T
        for assignment in spectral.ASSIGNMENTS:
            found = spectral.cluster(w, 3, assignment=assignment)
            assert sum(np.bincount(truth[found == k]).max() for k in set(found)) >= 30
    lasso = as_matrix(lasso_all.lasso_coefficients(as_rows(spark, x[:6]), "id"), 6)
    g = d[:, :6].T @ d[:, :6] / len(d)
    slope = np.abs(g - g @ lasso)  # at the least, no atom's slope exceeds alpha
    assert np.diag(lasso).max() == 0 and (slope[~np.eye(6, dtype=bool)] < 0.001 + 1e-9).all()
    with pytest.raises(ValueError):
        self_expression.Solver(-1, 1)
    with pytest.raises(ValueError):
        spectral.cluster(w, 3, assignment="other")


def test_sweep_of_blocks_takes_one_decomposition(spark):
    w = np.kron(np.eye(3), np.ones((4, 4))) + 0.01
    np.fill_diagonal(w, 0)
    graph = spark.createDataFrame([(int(i) * 10, int(j) * 10, float(w[i, j])) for i in range(12) for j in range(12) if i != j], "i long, j long, w double")
    found = spectral.cluster_nodes(graph, [10 * i for i in range(12)], [2, 3]).toPandas()
    three = found[found.k == 3].sort_values("node").cluster.to_numpy()
    assert set(found.groupby("k").cluster.nunique()) == {2, 3} and all(len(set(three[4 * b : 4 * b + 4])) == 1 for b in range(3))
    affinity.affinity_gate(graph, graph.select(F.col("i").alias("node")).distinct())
    for bad in (graph.where("i > j"), graph.union(graph.limit(1)), graph.withColumn("w", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            affinity.affinity_gate(bad, graph.select(F.col("i").alias("node")).distinct())


def two_tables(spark, n=24):
    x, truth = subspaces(n=n)
    rows = spark.createDataFrame([(i, *v.tolist()) for i, v in enumerate(x)], "id long, " + ", ".join(f"f{k} double" for k in range(8)))
    return rows, spark.createDataFrame([(i, int(c)) for i, c in enumerate(truth)], "id long, label long")


def test_stages_label_every_row_by_both_methods_for_every_k(spark):
    features, truth = two_tables(spark)
    s = stages.Settings(id_col="id", scaling="standard", components=6, method="both", clusters=(2, 3, 4), atoms=40)
    with pytest.raises(ValueError):
        stages.start(s, features, truth.limit(5))
    run = stages.run_stages(stages.start(s, features, truth), stages.select_stages(2, 10))
    labels = run.tables["labels"].toPandas()
    assert len(labels) == 72 * 6 and labels.cluster.notna().all() and set(labels.method) == {"sparse", "low_rank"}
    inner = run.tables["internal"].toPandas()
    assert len(inner) == 6 and inner.columns[2:].tolist() == views.INTERNAL and np.isfinite(inner[["silhouette", "dbi", "chi", "affinity_silhouette", "ncut", "eigengap"]].to_numpy()).all()
    outer = run.tables["external"].toPandas()
    assert len(outer) == 6 and outer[outer.k == 3].Purity.min() > 0.5
    assert run.tables["anova"].select("method", "k").distinct().count() == 6 and run.tables["heatmap"].groupBy("method", "k").count().select("count").distinct().collect()[0][0] == 40
    # each labelling scores as it does alone
    one = labels[(labels.method == "sparse") & (labels.k == 3)]
    alone = run.tables["scores"].join(spark.createDataFrame(one[["id", "cluster"]]), "id")
    row = inner[(inner.method == "sparse") & (inner.k == 3)].iloc[0]
    assert internal.silhouette(alone, "id", "cluster").first()[0] == pytest.approx(row.silhouette) and internal.davies_bouldin(alone, "cluster").first()[0] == pytest.approx(row.dbi) and internal.calinski_harabasz(alone, "cluster").first()[0] == pytest.approx(row.chi)


def test_unconverged_fit_is_kept_then_raised(spark):
    features, _ = two_tables(spark, 8)
    s = stages.Settings(id_col="id", method="both", sparse=self_expression.Solver(0.02, 0.4, max_iter=2))
    run = stages.Run(s, {"features": features})
    with pytest.raises(ArithmeticError):
        stages.run_stages(run, [2, 3, 4])
    assert {r.method for r in run.tables["coefficients"].select("method").distinct().collect()} == {"sparse"}
    assert run.tables["fit_info"].where("Property = 'Converged'").first()["Value"] == "False"


def test_labels_must_fit_the_rows(spark):
    ids = spark.range(4)
    good = spark.createDataFrame([(i, i % 2) for i in range(4)], "id long, cluster int")
    joins.label_gate(ids, good, "id", "cluster")
    for bad in (good.limit(3), good.union(good.limit(1)), good.withColumn("id", F.col("id") + 1), good.withColumn("cluster", F.lit(None).cast("int")), good.limit(0)):
        with pytest.raises(ValueError):
            joins.label_gate(ids, bad, "id", "cluster")
    named = good.withColumnRenamed("id", "Image")
    assert joins.aligned_join(named, named.select("Image", F.lit(1).alias("label")), "Image")[1] == "Image"
    assert joins.aligned_join(good.withColumnRenamed("id", "row_id"), named.select(F.col("Image").alias("row_id"), F.lit(1).alias("label")), "Image")[1] == "row_id"
    with pytest.raises(ValueError):
        joins.aligned_join(good, named, "Image")


def test_grid_search_scores_all_rows_and_keeps_failures(spark, tmp_path):
    x, truth = subspaces(n=20)
    rows, labels = as_rows(spark, x), spark.createDataFrame([(i, int(c)) for i, c in enumerate(truth)], "id long, label long")
    points = [(0.02, 0.4), (1e9, 0.4)]
    for method, atoms in (("sparse", 1024), ("sparse", 40), ("low_rank", 40)):
        found = grid.search(rows, labels, "id", "label", points, method, 3, atoms=atoms)
        r = {x["lambda"]: x for x in found.results.collect()}
        assert len(r) == 2 and found.labels.where("lambda < 1").count() == len(x) and r[0.02].Purity > 0.6 and r[0.02].Error is None
        assert found.results.columns[-1] == "Error"
    nothing = grid.search(as_rows(spark, np.zeros((6, 3))), labels, "id", "label", points[:1], k=2).results.first()
    assert "zero" in nothing.Error and nothing.ARI is None and not nothing.Converged
    broken = x.copy()
    broken[0, 0] = float("inf")
    with np.errstate(all="ignore"):
        failed = grid.search(as_rows(spark, broken), labels, "id", "label", points[:1], "low_rank", 3).results.first()
    assert failed.Error and failed.ARI is None and not failed.Converged
    found.dump(str(tmp_path / "dump"))
    assert spark.read.parquet(str(tmp_path / "dump" / "clusters")).count() == found.labels.count()
    made = grid.regenerate(found.results.drop("Error"))
    assert set(made) == {"best", *(f"{t} {m}" for t in ("pivot", "surface") for m in grid.METRICS)} and "sparsity" in made["surface ARI"].columns
    with pytest.raises(ValueError):
        grid.regenerate(found.results.drop("ARI"))
    seen = []

    def part(ps):
        seen.append(ps)
        return spark.createDataFrame([(a, b, 1.0) for a, b in ps], "lambda double, gamma double, ARI double")

    for _ in range(2):
        table = grid.search_in_parts(str(tmp_path / "results"), points, 1, part, spark)
    assert table.count() == 2 and len(seen) == 2
    config, names = grid.run_configuration(spark, "sparse", points, self_expression.SPARSE, ["a", "b"], 3, 42)
    assert config.count() == 16 and names.count() == 2


def test_stability_of_far_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.1, (20, 3)), rng.normal(9, 0.1, (20, 3))])
    assert tuple(stability.stability(as_rows(spark, x), [2], runs=3).first()) == (2, 1.0, 3)
    noise = stability.shaken(as_rows(spark, np.zeros((400, 5))), "id", 0.5, 7).select(F.explode("features").alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(noise[0]) < 0.05 and noise[1] == pytest.approx(0.5, abs=0.03)


def test_components_of_a_line(spark):
    df = spark.createDataFrame([(i, [1.0 * i, 2.0 * i, -1.0 * i + 3]) for i in range(5)], "id int, features array<double>")
    c = decomposition.fit_components(df)
    made = decomposition.artifacts(df, c, "id", ["a", "b", "c"])
    assert [r.retained for r in made["scree"].orderBy("component").collect()] == [True, False, False] and made["scores"].columns == ["id", "PC1"] and {r.Property: r.Value for r in made["summary"].collect()}["components"] == "1"
    assert c.k == 1 and np.allclose(c.loadings.T @ c.loadings, np.eye(1))
    assert abs(decomposition.scores(df, c).agg(F.avg("PC1")).first()[0]) < 1e-9


def test_grid(spark):
    def fit(lam, gam):
        if lam > 0.5:
            raise ValueError("too large")
        return {"ARI": 1 - lam, "Converged": gam > 0.5}

    points = spark.createDataFrame([(a, b) for a in (0.1, 0.9) for b in (0.1, 0.9)], "lambda double, gamma double")
    out = grid.run_grid(points, fit, ["ARI"])
    assert {(r["lambda"], r.Error) for r in out.where("Error IS NOT NULL").collect()} == {(0.9, "ValueError: too large")}
    best = grid.best_rows(out, ["ARI"]).first()
    assert (best["lambda"], best["gamma"]) == (0.1, 0.9)
    with pytest.raises(ValueError):
        grid.pivot_grid(out.union(out), "ARI")


def test_sweeps_refuse_wrong_labellings(spark):
    df = spark.createDataFrame([(3, i % 2, "x") for i in range(6)], "k int, cluster int, label string")
    with pytest.raises(ValueError):
        views.external_sweep(df)


def test_stage_selection_and_records(spark):
    assert stages.select_stages(3, 6) == [3, 4, 5, 6] and stages.select_stages(only=["cluster", 2, "6"]) == [2, 6]
    with pytest.raises(ValueError):
        stages.select_stages(only=["nothing"])
    run = stages.Run(stages.Settings(id_col="id"))
    with pytest.raises(LookupError):
        stages.run_stages(run, [3])
    assert stages.run_stages(run, [2, 3], dry_run=True).records[-1]["status"] == "planned"
    with pytest.raises(ValueError):
        stages.Settings(clusters=1)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.JPG").write_bytes(b"1")
    (tmp_path / "in" / "b.txt").write_bytes(b"2")
    assert [r.Image for r in files.image_folder(spark, str(tmp_path / "in")).collect()] == ["a.JPG"]
    (tmp_path / "f.csv").write_bytes("﻿Image,x\na,1.5\nb,oops\n".encode())
    assert [tuple(r) for r in files.read_features(spark, str(tmp_path / "f.csv")).orderBy("Image").collect()] == [("a", 1.5), ("b", None)]
    files.write_features(files.read_features(spark, str(tmp_path / "f.csv")), str(tmp_path / "out"))
    assert [tuple(r) for r in files.read_text_rows(spark, str(tmp_path / "out")).orderBy("Image").collect()] == [("a", "1.5"), ("b", None)]
    legacy, canonical = str(tmp_path / "f.csv"), str(tmp_path / "none.csv")
    assert files.resolve_input(spark, None, canonical, legacy) == legacy and files.resolve_input(spark, canonical, legacy) == canonical
    with pytest.raises(FileNotFoundError):
        files.resolve_input(spark, None, canonical)
    run = stages.Run(stages.Settings())
    files.write_text(spark, stages.manifest(run), str(tmp_path / "manifest"))
    assert "".join(r.value for r in spark.read.text(str(tmp_path / "manifest")).collect()).startswith("{")
    assert len(files.input_manifest(spark, [str(tmp_path / "in")]).first().sha256) == 64
