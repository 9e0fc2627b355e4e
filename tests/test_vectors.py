"""Vector functions and features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windowlark.functions import text as tx
from windowlark.functions import vector as V
from windowlark.operators import features
from windowlark.operators.aggregates import frequent_itemsets, mean_vector


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.1, 0] + [1, 2, 3, 4, 5]
    rows = [(i, int(i % 3), [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, label int, e array<double>"), x


def test_mean_vector_distinct(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("a", [4.0, 3.0])], "k string, e array<double>")
    assert mean_vector(df, ["k"], "e").first().e == [2.0, 1.0]
    assert mean_vector(df, ["k"], "e", distinct=True).first().e == [2.5, 1.5]


def test_blend(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 6.0])], "a array<double>, b array<double>")
    half = df.select(V.blend_vectors("a", "b", 0.75, scale=0.5), V.blend_vectors("a", "b", 0.75), V.mean_of_vectors("a", "b", "b")).first()
    assert half[0] == [0.75, 1.5] and half[1] == [1.5, 3.0] and half[2] == pytest.approx([7 / 3, 14 / 3])


def test_masks(points):
    df, x = points
    masked, mask = V.mask_vectors("e", "id", 0.15, seed=1)
    rows = df.select("id", "e", masked.alias("masked"), mask.alias("mask")).collect()
    flags = np.array([r["mask"] for r in rows])
    assert flags.shape == x.shape and 0.05 < flags.mean() < 0.25
    for r in rows:
        assert r["masked"] == [0.0 if m else v for v, m in zip(r["e"], r["mask"], strict=True)]


def test_masked_mse(spark):
    df = spark.createDataFrame([([1.0, 5.0, 2.0], [2.0, 9.0, 2.0])], "a array<double>, b array<double>")
    mask = F.array(F.lit(True), F.lit(False), F.lit(True))
    none = F.array(F.lit(False), F.lit(False), F.lit(False))
    r = df.select(V.masked_mse("a", "b", mask), V.masked_mse("a", "b", none), V.argmax_hit("a", "b")).first()
    assert tuple(r) == (0.5, None, 1)


def test_scale(points):
    df, x = points
    got = np.array([r.e for r in features.standard_scale(df, "e").orderBy("id").collect()])
    std = x.std(axis=0)
    std[std < 1e-12] = 1
    assert np.allclose(got, (x - x.mean(axis=0)) / std)


def test_pca(points):
    df, x = points
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    share = np.cumsum(s**2) / (s**2).sum()
    k = int(np.searchsorted(share, 0.9) + 1)
    got = np.array([r.p for r in features.pca(df, "e", "p", variance=0.9).orderBy("id").collect()])
    assert got.shape == (60, k)
    assert np.allclose(np.abs(got), np.abs(centred @ vt[:k].T))
    assert len(features.pca(df, "e", "p", k=1).first().p) == 1


def test_select_dims(points):
    df, _ = points
    assert len(features.select_dims(df, "e", "label", 2).first().selected) == 2
    counts = df.withColumn("c", F.transform("e", lambda v: F.abs(F.round(v))))
    assert len(features.select_dims(counts, "c", "label", 3, test="chi2").first().selected) == 3


def test_closeness_of_a_path(spark):
    tree = spark.createDataFrame([("x", "g"), ("orphan", None)], "leaf string, grp string")
    got = {r.node: r.closeness for r in features.closeness(tree, "leaf", "grp").collect()}
    assert got == {"x": 2 / 3, "g": 1.0, "root": 2 / 3}
    assert features.taxonomy_edges(tree, "leaf", "grp").count() == 2


def test_text(spark):
    df = spark.createDataFrame([("XC12_source2.mp3", "1.5,x,2")], "n string, t string")
    stem, channel = tx.split_source("n")
    r = df.select(stem, channel, tx.track_number("n"), tx.parse_vector("t"), tx.source_name(F.lit("XC12"), F.lit(2))).first()
    assert tuple(r) == ("XC12", "source2", "12", [1.5, None, 2.0], "XC12_source2.mp3")
    assert tuple(spark.createDataFrame([("XC5.ogg",)], "n string").select(*tx.split_source("n")).first()) == ("XC5", "original")
    one = df.select(tx.track_id(F.lit(1), F.lit(23)) == tx.track_id(F.lit(12), F.lit(3))).first()[0]
    assert one is False


def test_itemsets(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), (["c"],)], "items array<string>")
    got = {tuple(r["items"]): r["freq"] for r in frequent_itemsets(df, "items", support=0.3).collect()}
    assert got[("a", "b")] == 2 and got[("a", "b", "c")] == 1
