"""Boosted trees of many labels against a plain NumPy booster over the same bins."""

import numpy as np
import pytest

from windowlark.learn import boosting

CLASSES = ["a", "b", "c"]


def plain_booster(bins, y, w, rounds, depth, n_bins, eta, lam, gamma, least):
    """Margins of one label, a tree at a time and a node at a time, rows in lists."""
    margin = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def grow(rows, level, g=g, h=h):
            total_g, total_h = g[rows].sum(), h[rows].sum()
            best = (1e-12, None)
            for j in range(bins.shape[1]):
                for b in range(n_bins - 1):
                    low = rows[bins[rows, j] <= b]
                    lg, lh = g[low].sum(), h[low].sum()
                    rg, rh = total_g - lg, total_h - lh
                    if level < depth and lh >= least and rh >= least:
                        gain = (lg**2 / (lh + lam) + rg**2 / (rh + lam) - total_g**2 / (total_h + lam)) / 2 - gamma
                        if gain > best[0] + 1e-9 * max(1.0, abs(best[0])):
                            best = (gain, (j, b))
            if best[1] is None:
                step[rows] = -total_g / (total_h + lam) * eta
                return
            j, b = best[1]
            grow(rows[bins[rows, j] <= b], level + 1)
            grow(rows[bins[rows, j] > b], level + 1)

        step = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        margin += step
    return margin


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(260, 4)), 1)
    y = np.stack([x[:, 0] * x[:, 1] > 0, x[:, 2] > 1, rng.random(260) < 0.3], axis=1)
    w = rng.integers(1, 4, 260).astype(float)
    rows = [([float(v) for v in a], [c for c, k in zip(CLASSES, b, strict=True) if k] + ["other"], float(v), i) for i, (a, b, v) in enumerate(zip(x, y, w, strict=True))]
    df = spark.createDataFrame([*rows, (None, ["a"], 1.0, -1)], "v array<double>, tags array<string>, w double, margin int").repartition(4).cache()
    return x, y.astype(float), w, df


@pytest.mark.parametrize(("held", "gamma", "least"), [(1 << 27, 0.0, 1.0), (1, 0.3, 6.0)])
def test_equal_to_a_plain_booster(data, monkeypatch, held, gamma, least):
    """Also when every label takes a pass of its own."""
    monkeypatch.setattr(boosting, "HISTOGRAM_BYTES", held)
    x, y, w, df = data
    edges = np.quantile(x, np.arange(1, 8) / 8, axis=0).T
    model = boosting.fit_boosted(df, "v", "tags", CLASSES, rounds=2, depth=3, bins=8, gamma=gamma, min_child_weight=least, weight="w", edges=edges)
    bins = boosting.to_bins(x, edges)
    want = np.stack([plain_booster(bins, y[:, c], w, 2, 3, 8, 0.3, 1.0, gamma, least) for c in range(3)], axis=1)
    assert np.abs(model.margins(x) - want).max() < 1e-8
    scored = df.select("margin", model.scores("v").alias("s")).collect()
    assert all((r["s"] is None) if r["margin"] < 0 else np.allclose(r["s"], 1 / (1 + np.exp(-want[r["margin"]]))) for r in scored)


def test_learns_what_a_line_cannot(data):
    x, y, _, df = data
    model = boosting.fit_boosted(df, "v", "tags", ["a"], rounds=8, depth=3, bins=16)
    assert ((model.margins(x)[:, 0] > 0) == y[:, 0]).mean() > 0.9
    assert model.edges.shape == (4, 15) and (np.diff(model.edges) >= 0).all()


def test_edges_and_refusals(data):
    edges = np.array([[0.0, 1.0]])
    assert boosting.to_bins(np.array([[-5.0], [0.0], [0.5], [1.0], [2.0], [np.nan]]), edges).ravel().tolist() == [0, 0, 1, 1, 2, 0]
    with pytest.raises(ValueError, match="byte"):
        boosting.fit_boosted(data[3], "v", "tags", CLASSES, bins=300)
    with pytest.raises(ValueError, match="nothing"):
        boosting.fit_boosted(data[3].limit(0), "v", "tags", CLASSES)
