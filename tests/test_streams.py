"""Fits over all rows at size: no shuffle of all rows with all rows, and rows that are done leave."""

import numpy as np
import pyarrow as pa
import pytest

from selfspan.operators import column_generation, eigenvectors, exact_low_rank, grid, internal, lasso, many_means, spectral, streams
from selfspan.operators.self_expression import SPARSE, unit_rows


def as_rows(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(parts)


def test_paths_of_many_rows_end_as_those_of_one():
    rng = np.random.default_rng(1)
    x, atoms = unit_rows(rng.normal(size=(40, 6))), unit_rows(rng.normal(size=(40 * 11, 6))).reshape(40, 11, 6)
    used = rng.random((40, 11)) < 0.8
    atoms[3, 5] = atoms[3, 2]  # equal atoms
    used[3, [2, 5]], used[4] = True, False
    alpha = np.where(np.arange(40) % 5, 0.002, 10.0)
    got = lasso.path_ends(x, atoms, used, alpha)
    for r in range(40):
        w = lasso.path_end(x[r], atoms[r, used[r]], alpha[r]) if used[r].any() else np.zeros(0)
        assert np.abs(got[r, used[r]] @ atoms[r, used[r]] - w @ atoms[r, used[r]]).max(initial=0) < 1e-10 and not got[r, ~used[r]].any()


def test_blocks_meet_all_rows_without_a_shuffle_and_settle_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE", 100)  # several files, each of which has a lead
    x = np.random.default_rng(2).normal(size=(330, 5))
    stream = {}
    monkeypatch.setattr(streams, "against_all", lambda own, others, f=streams.against_all: stream.setdefault("plan", f(own, others)) and f(own, others))
    fit = column_generation.sparse_coefficients(as_rows(spark, x), "id", points=[(SPARSE.lam, SPARSE.gamma), (0.05, 0.2)])
    assert "Exchange" not in stream["plan"]._jdf.queryExecution().executedPlan().toString()
    rows = fit.fits.select("lambda", "j", "iterations", "converged").collect()
    assert len(rows) == len({(r[0], r.j) for r in rows}) == 660 and all(r.converged for r in rows)
    assert len({r.iterations for r in rows}) > 1  # a row that no atom entered is not kept waiting by its block


@pytest.mark.parametrize("ids", [[-1, 5, 2**40, 7], [0, 1, 2, 3]])
def test_any_id_is_an_atom(spark, ids):
    x = np.array([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [0.01, 1.0]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, features array<double>")
    near = {(r.i, r.j) for r in column_generation.sparse_coefficients(rows, "id").values.collect() if abs(r.value) > 0.5}
    assert near == {(ids[a], ids[b]) for a, b in ((0, 1), (1, 0), (2, 3), (3, 2))}


def test_points_of_one_solution_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(40, 2)) @ rng.normal(size=(2, 4)) for _ in range(3)])
    truth = spark.createDataFrame([(i, i // 40) for i in range(120)], "id long, label int")
    # without errors at any weights that small, then two of one ratio, then none of the coefficients left
    points = [(0.001, 1.0), (0.002, 0.5), (0.3, 0.3), (0.6, 0.6), (5.0, 0.1)]
    fitted = []
    monkeypatch.setattr(grid, "search", lambda *a, f=grid.search, **b: fitted.append(a[4]) or f(*a, **b))
    got = {(r["lambda"], r.gamma): r for r in grid.sparse_results(as_rows(spark, x), truth, "id", "label", points, 3).collect()}
    assert len(fitted[0]) == 3 and set(got) == set(points)
    for r in grid.search(as_rows(spark, x), truth, "id", "label", points, "sparse_all", 3).results.collect():
        one = got[r["lambda"], r.gamma]
        assert (one.ARI, one.Error, one.active, one.Converged) == (r.ARI, r.Error, r.active, r.Converged) and (r.l1 is None or abs(one.l1 - r.l1) < 1e-9)


def test_a_large_graph_is_clustered_by_its_entries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    label = np.arange(120) // 40
    x = np.vstack([rng.normal(size=(40, 2)) @ rng.normal(size=(2, 6)) for _ in range(3)])
    truth = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id long, label int")
    scores = []
    for module, name, value in ((spectral, "DENSE", 1024), (spectral, "DENSE", 50), (grid, "GRAPH", 50)):
        monkeypatch.setattr(module, name, value)
        scores.append(grid.search(as_rows(spark, x), truth, "id", "label", [(0.02, 0.4)], "sparse_all", 3).results.first().ARI)
    assert min(scores) > 0.9


def test_rows_that_are_no_ones_atom_are_nodes(spark):
    # rows 0 to 3 in two pairs; row 4 is expressed by the others and expresses none
    x = np.array([[1.0, 0.0, 0.0], [1.0, 0.02, 0.0], [0.0, 1.0, 0.0], [0.02, 1.0, 0.0], [0.7, 0.05, 0.7]])
    truth = spark.createDataFrame([(i, i // 2) for i in range(5)], "id long, label int")
    for method in ("sparse", "sparse_all"):
        found = grid.search(as_rows(spark, x), truth, "id", "label", [(0.01, 0.4)], method, 2)
        assert {r.id for r in found.labels.collect()} == set(range(5)) and found.results.first().Error is None


def test_eigenvectors_of_few_nodes_are_those_of_many(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a = rng.random((90, 90)) * (rng.random((90, 90)) < 0.2)
    a[80:, :], a[:, 80:] = 0, 0  # ten nodes without entries
    a = (a + a.T) / 20
    i, j = np.nonzero(a)
    entries = spark.createDataFrame([(int(7 * r), int(7 * c), float(a[r, c])) for r, c in zip(i, j, strict=True)], "i long, j long, m double")
    nodes = spark.range(90).selectExpr("id * 7 AS node")
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:3]
    parts = {}
    for within in (0, 1 << 16):  # the first has more entries than one task takes
        monkeypatch.setattr(eigenvectors, "ENTRIES", within)
        values, residuals, table = eigenvectors.leading(entries, nodes, 3, 1e-9)
        rows = {r.node: np.array(r.vector) for r in table.collect()}
        assert np.abs(values - want).max() < 1e-9 and residuals.max() <= 1e-9 and set(rows) == {7 * k for k in range(90)} and np.abs([rows[7 * k] for k in range(80, 90)]).max() < 1e-6
        x = np.array([rows[7 * k] for k in range(90)])
        parts[within] = x @ x.T
    assert np.abs(parts[0] - parts[1 << 16]).max() < 1e-6


def test_silhouettes_leave_tasks_as_a_number_a_block(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("STRIP", 24)):
        monkeypatch.setattr(internal, name, value)
    monkeypatch.setattr(streams, "FILE", 70)
    rng = np.random.default_rng(7)
    x, label = rng.normal(size=(200, 4)) + 1e6, rng.integers(0, 4, 200) * 2**40
    label[17] = -5  # a cluster of one
    rows = spark.createDataFrame([(i, k, int(label[i] if k == 2 else i % 3), v.tolist()) for i, v in enumerate(x) for k in (2, 3)], "id long, k int, c long, features array<double>")
    stream = {}
    monkeypatch.setattr(streams, "against_all", lambda own, others, f=streams.against_all: stream.setdefault("pairs", f(own, others)))
    got = {r.k: r for r in internal.silhouette(rows, "id", "c", query="id % 3 <> 1", keys=["k"]).collect()}
    assert "Exchange" not in stream["pairs"]._jdf.queryExecution().executedPlan().toString()
    assert stream["pairs"].mapInArrow(internal._scored, "labelling int, s double, rows long").count() <= 2 * (-(-134 // 64) + 8)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for k, own in ((2, label), (3, np.arange(200) % 3)):
        mean = np.array([[d[i][own == c].sum() / max((own == c).sum() - (own[i] == c), 1) for c in np.unique(own)] for i in range(200)])
        at = np.searchsorted(np.unique(own), own)
        a, b = mean[np.arange(200), at], np.where(np.arange(mean.shape[1]) == at[:, None], np.inf, mean).min(axis=1)
        s = np.where(own == -5, 0, (b - a) / np.maximum(a, b))[np.arange(200) % 3 != 1]
        assert got[k].rows == len(s) and got[k].silhouette == pytest.approx(s.mean(), abs=1e-8)


def test_runs_that_see_the_same_vectors_share_them(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3))
    runs = [many_means.Run(k, 42 + t, noise, shake) for k in (2, 4) for noise, shake in ((0.0, 0), (0.1, 7), (0.1, 8)) for t in range(3)]
    seen = []
    monkeypatch.setattr(many_means, "shaken", lambda x, ids, run, f=many_means.shaken: seen.append(run) or f(x, ids, run))
    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array(np.arange(600)), pa.array(list(x), pa.list_(pa.float64()))], ["id", "v"])])
    centres = {r: x[: run.k] for r, run in enumerate(runs)}
    moved = pa.Table.from_batches(list(many_means._move(batch(), runs, centres))).to_pandas()
    assert len(seen) == 3  # one copy a shake, whatever the number of runs
    for r, run in enumerate(runs):
        y = many_means.shaken(x, np.arange(600), run)
        d = ((y[:, None] - centres[r][None]) ** 2).sum(axis=2)
        own = moved[moved.run == r].sort_values("at").v.to_numpy()
        assert own[0] == pytest.approx(d.min(axis=1).sum()) and np.allclose(own[1:].reshape(run.k, -1)[:, 0], np.bincount(d.argmin(axis=1), minlength=run.k))


def test_low_rank_coefficients_are_neither_written_nor_tabled_for_their_sums(spark, monkeypatch):
    monkeypatch.setattr(exact_low_rank, "HELD", 300 * 40)  # blocks of 40 rows
    x = np.random.default_rng(0).normal(size=(300, 6)) * np.linspace(2, 1, 6)
    written = []
    monkeypatch.setattr(exact_low_rank, "truncate", lambda df, f=exact_low_rank.truncate: written.append(df.columns) or f(df))
    fit = exact_low_rank.low_rank_coefficients(as_rows(spark, x), "id", points=[(1.0, 1.0), (1.2, 2.0)])
    assert written == [["id", "v"]] and fit.brief is not None
    short = {r["lambda"]: r.asDict() for r in fit.summary().collect()}
    fit.brief = None
    long = {r["lambda"]: r.asDict() for r in fit.summary().collect()}
    assert set(short) == set(long) == {1.0, 1.2}
    for point, row in long.items():
        assert {k: v if isinstance(v, (int, bool)) or v is None else pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in row.items()} == short[point]
