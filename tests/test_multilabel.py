"""Many logistic models at once against single fits."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from windowlark.learn import multilabel

CLASSES = [f"c{i}" for i in range(7)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * [1, 10, 0.1, 3, 1] + [0, 5, 0, -2, 1]
    w = rng.normal(size=(7, 5)) / [1, 10, 0.1, 3, 1]
    hot = 1 / (1 + np.exp(-(x @ w.T + rng.normal(size=7)))) > rng.random((400, 7))
    data = [([float(v) for v in a], [c for c, y in zip(CLASSES, b, strict=True) if y] + ["unseen"], float(1 + i % 3), i % 2) for i, (a, b) in enumerate(zip(x, hot, strict=True))]
    return spark.createDataFrame([*data, (None, ["c0"], 1.0, 0), ([0.5, 1.0, 0.0, 0.0, 0.0], None, 1.0, 1)], "v array<double>, tags array<string>, weight double, part int").repartition(5).cache()


@pytest.mark.parametrize(("reg", "weight"), [(0.05, None), (0.01, "weight")])
def test_equal_to_single_fits(rows, reg, weight):
    model = multilabel.fit_labels(rows, "v", "tags", CLASSES, reg=reg, weight=weight)
    assert model.slopes.max() <= 1e-7
    ready = rows.where("v is not null").withColumn("x", array_to_vector("v"))
    for c in (0, 4):
        target = ready.withColumn("y", F.coalesce(F.array_contains("tags", CLASSES[c]), F.lit(False)).cast("double"))
        single = LogisticRegression(featuresCol="x", labelCol="y", regParam=reg, standardization=False, tol=1e-12, maxIter=500, **({"weightCol": weight} if weight else {})).fit(target)
        assert np.abs(model.weights[c] - single.coefficients.toArray()).max() < 1e-4
        assert abs(model.bias[c] - single.intercept) < 1e-4


def test_passes_do_not_grow_with_labels(rows, monkeypatch):
    one = multilabel.fit_labels(rows, "v", "tags", CLASSES, reg=0.02)
    monkeypatch.setattr(multilabel, "BLOCK", 3)
    copies = F.flatten(F.transform("tags", lambda t: F.array(*[F.concat(t, F.lit(f"_{k}")) for k in range(4)])))
    names = [f"{c}_{k}" for k in range(4) for c in CLASSES] + ["never"]
    many = multilabel.fit_labels(rows.withColumn("tags", copies), "v", "tags", names, reg=0.02)
    assert many.passes <= one.passes + 10 < 60
    assert np.abs(many.weights[7:14] - one.weights).max() < 1e-5
    assert many.bias[-1] == -multilabel.CERTAIN and not many.weights[-1].any()
    scored = rows.select("v", many.scores("v").alias("s")).collect()
    assert all((r["s"] is None) == (r["v"] is None) and (r["s"] is None or len(r["s"]) == 29) for r in scored)


def test_search_sees_only_other_folds(rows):
    model, table = multilabel.search_penalty(rows, "v", "tags", CLASSES, [0.01, 100.0], "part")
    found = {(r["reg"], r["fold"]): r["average_precision"] for r in table.collect()}
    assert len(found) == 4 and found[0.01, 0] > found[100.0, 0] * 0.9
    kept = rows.where("part != 1")
    alone = multilabel.fit_labels(kept, "v", "tags", CLASSES, reg=0.01, tol=1e-7)
    prepared = multilabel._prepared(rows, "v", "tags", CLASSES, None, "part")
    columns, _, _ = multilabel._fit_columns(prepared, 7, np.arange(7), np.full(7, 1), np.full(7, 0.01), 1e-7, 100)
    assert np.abs(columns[:, :-1] - alone.weights).max() < 1e-4
    assert model.classes == CLASSES


def test_nothing_to_fit(rows):
    with pytest.raises(ValueError, match="nothing"):
        multilabel.fit_labels(rows.limit(0), "v", "tags", CLASSES)
