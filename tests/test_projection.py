"""Principal components by block iteration against an eigen-decomposition."""

import numpy as np
import pytest

from windowlark.operators import features, projection


def table(spark, x):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, (-1, None)], "id int, v array<double>").repartition(5)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    x = rng.normal(size=(500, 60)) * (10 * 0.8 ** np.arange(60)) @ turn + rng.normal(size=60)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    return x, values[::-1], vectors[:, ::-1].T, table(spark, x).cache()


@pytest.mark.parametrize("direct", [0, 512])
def test_components(data, monkeypatch, direct):
    monkeypatch.setattr(projection, "DIRECT", direct)
    x, values, vectors, df = data
    found = projection.fit_components(df, "v", k=4)
    assert np.allclose(found.variances, values[:4], rtol=1e-5) and np.isclose(found.total, values.sum())
    assert np.allclose(np.abs(np.sum(found.directions * vectors[:4], axis=1)), 1, atol=1e-4)
    assert np.allclose(found.directions @ found.directions.T, np.eye(4), atol=1e-9)
    got = {r["id"]: r["p"] for r in features.pca(df, "v", "p", k=4).collect()}
    assert got[-1] is None and np.allclose(got[7], (x[7] - x.mean(axis=0)) @ found.directions.T)


@pytest.mark.parametrize(("share", "block"), [(0.6, 32), (0.9, 32), (0.9, 2), (0.99999, 4), (1.0, 4)])
def test_share_of_variance(data, monkeypatch, share, block):
    """Also when the block has to grow, up to the whole width."""
    monkeypatch.setattr(projection, "DIRECT", 0)
    monkeypatch.setattr(projection, "BLOCK", block)
    monkeypatch.setattr(projection, "EXTRA", 2)
    _, values, _, df = data
    found = projection.fit_components(df, "v", variance=share)
    want = int(np.searchsorted(np.cumsum(values) / values.sum(), share * (1 - 1e-12))) + 1
    assert abs(len(found.variances) - want) <= (0 if share < 1 else 1)
    assert found.shares.sum() >= share - 1e-6 and found.shares[:-1].sum() < share


def test_refusals_and_constants(spark, data):
    df = data[3]
    with pytest.raises(ValueError, match="either"):
        projection.fit_components(df, "v")
    with pytest.raises(ValueError, match="more"):
        projection.fit_components(df, "v", k=61)
    with pytest.raises(ValueError, match="nothing"):
        projection.fit_components(df.limit(0), "v", k=1)
    same = projection.fit_components(table(spark, np.ones((5, 3))), "v", variance=0.9)
    assert same.total == 0 and same.shares.tolist() == [0.0]
