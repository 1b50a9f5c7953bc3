"""Components of rows of many features against numpy."""

import numpy as np
import pyarrow as pa
import pytest

from selfspan.operators import decomposition, wide_components


def table(spark, x):
    return spark.createDataFrame(pa.table({"id": np.arange(len(x)), "features": pa.array(list(x), pa.list_(pa.float64()))})).repartition(3)


def rows(n, d, offset=0.0, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 30)) * 0.8 ** np.arange(30) @ rng.normal(size=(30, d)) + 0.05 * rng.normal(size=(n, d)) + offset


@pytest.mark.parametrize("offset", [0.0, 1e7])
def test_twenty_thousand_features_equal_numpy(spark, offset):
    x = rows(150, 20000, offset)
    df = table(spark, x)
    c = decomposition.fit_components(df, k=6)
    centred = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(c.ratios, (s**2 / (s**2).sum())[:6], rtol=1e-7) and c.k == 6
    assert np.allclose(np.abs((c.loadings * v[:6].T).sum(axis=0)), 1, atol=1e-8)
    assert (c.loadings[np.abs(c.loadings).argmax(axis=0), np.arange(6)] > 0).all()
    made = decomposition.scores(df, c).orderBy("id").toPandas()
    assert list(made.columns) == ["id", *[f"PC{i}" for i in range(1, 7)]]
    assert np.allclose(made.iloc[:, 1:].to_numpy(), centred @ c.loadings, atol=1e-5 if offset else 1e-9)


def test_threshold_and_sweep_agree_with_the_whole_matrix(spark, monkeypatch):
    df = table(spark, rows(200, 60))
    whole, sweep = decomposition.fit_components(df, threshold=0.97), decomposition.variance_sweep(df).collect()
    monkeypatch.setattr(decomposition, "WIDE", 40)
    monkeypatch.setattr(wide_components, "BLOCKS", 2)  # begins anew often
    wide = decomposition.fit_components(df, threshold=0.97)
    assert wide.k == whole.k and np.allclose(wide.loadings, whole.loadings, atol=1e-6) and np.allclose(wide.ratios[: whole.k], whole.ratios[: whole.k], rtol=1e-8)
    assert decomposition.variance_sweep(df).collect() == sweep


def test_few_rows_equal_rows_and_limits(spark, monkeypatch):
    monkeypatch.setattr(decomposition, "WIDE", 40)
    x = rows(4, 50)
    c = decomposition.fit_components(table(spark, x), k=20)
    assert c.k == 3 and c.ratios.sum() == pytest.approx(1)  # four rows span three directions
    same = decomposition.fit_components(table(spark, np.repeat(x[:1], 5, axis=0)), k=2)
    assert same.k == 0 and not len(same.ratios)  # equal rows have no components
    monkeypatch.setattr(decomposition, "MOST", 4)
    with pytest.raises(ValueError, match="at most"):
        decomposition.fit_components(table(spark, rows(60, 50)), k=9)
    with pytest.raises(ValueError, match="no rows"):
        decomposition.fit_components(table(spark, x).limit(0), k=2)


def test_entries_are_spread_over_places(spark):
    entries = spark.createDataFrame([(1, 0, 2), (1, 3, 5), (2, 1, 7)], "id long, at long, value long")
    assert {r.id: r.features for r in wide_components.spread(entries, "id", 4).collect()} == {1: [2, 0, 0, 5], 2: [0, 7, 0, 0]}
