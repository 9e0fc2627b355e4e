"""Metrics against small brute force, and one fit of each learner."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from windowlark.learn import metrics, models, prepare


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[4.0, 0, 1], [0, 4.0, 1], [1, 1, 5.0]])
    rows = [(i, "abc"[i % 3], [float(abs(v)) for v in centres[i % 3] + rng.normal(size=3) * 0.4]) for i in range(120)]
    return spark.createDataFrame(rows, "id bigint, label string, e array<double>").repartition(2).cache()


def accuracy(model, df):
    scored = models.predict(model, df, "e", "label")
    return scored.where("prediction_label = label").count() / df.count()


TRAINERS = {
    "logistic": lambda d: models.train_logistic(d, "e", "label", max_iter=20),
    "weighted": lambda d: models.train_logistic(prepare.balanced_weight(d, "label"), "e", "label", weight="weight", max_iter=20),
    "scaled_pca": lambda d: models.train_logistic(d, "e", "label", max_iter=20, scale=True, components=2),
    "svc": lambda d: models.train_linear_svc(d, "e", "label", max_iter=5),
    "gbt": lambda d: models.train_gbt(d, "e", "label", max_iter=3, max_depth=3),
    "tree": lambda d: models.train_tree(d, "e", "label"),
    "mlp": lambda d: models.train_mlp(d, "e", "label", 3, 3, hidden=(8,), max_iter=60),
    "nb": lambda d: models.train_nb(d, "e", "label"),
    "complement_nb": lambda d: models.train_nb(d, "e", "label", "complement"),
}


@pytest.mark.parametrize("name", list(TRAINERS))
def test_trainer(blobs, name):
    assert accuracy(TRAINERS[name](blobs), blobs) > 0.9


def test_score_and_roundtrip(blobs, tmp_path):
    model = models.train_logistic(blobs, "e", "label", max_iter=10)
    models.save_model(model, str(tmp_path / "m"))
    a = models.score_vectors(blobs.drop("label"), model, "e", "label").orderBy("id").collect()
    b = models.score_vectors(blobs.drop("label"), models.load_model(str(tmp_path / "m")), "e", "label").orderBy("id").collect()
    assert a == b and all(1 / 3 <= r.probability <= 1 for r in a)


def test_score_with_outside_model(blobs):
    class Outside:
        """Stands for a model that was not made by Spark."""

        def predict_proba(self, x):
            w = np.exp(x)
            return w / w.sum(axis=1, keepdims=True)

    rows = models.score_with(blobs, Outside, "e", ["a", "b", "c"]).collect()
    assert sum(r.prediction == r.label for r in rows) == len(rows)


def test_expand_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.bin").write_bytes(bytes(range(i + 1)))
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.bin")

    def rows(path, content):
        return pd.DataFrame({"name": [path[-5:]] * len(content), "i": range(len(content))})

    assert models.expand_files(files, rows, "name string, i bigint").groupBy("name").count().orderBy("name").collect()[-1]["count"] == 3


def test_per_label(blobs):
    tagged = blobs.withColumn("tags", F.when(F.col("label") == "c", F.array(F.lit("c"), F.lit("x"))).otherwise(F.array("label")))
    fitted = models.train_per_label(tagged, "e", "tags", ["a", "b", "c", "x"])
    out = models.predict_per_label(fitted, tagged, "e")
    assert metrics.multilabel_metrics(out, "tags", "predicted").first().accuracy > 0.9


def test_search(blobs):
    points = models.grid(regParam=[0.0, 10.0])
    best, table = models.search(blobs, "e", "label", LogisticRegression(maxIter=5), points, folds=2, key="id")
    top = table.first()
    assert "0.0" in top.point and top.score > 0.9 and accuracy(best, blobs) > 0.9
    held = blobs.withColumn("held", F.col("id") % 4 == 0)
    best, table = models.search(held, "e", "label", LogisticRegression(maxIter=5), points, holdout="held")
    assert table.count() == 2 and accuracy(best, blobs) > 0.9
    draws = models.random_grid(4, 1, regParam=(0.001, 1.0))
    assert draws == models.random_grid(4, 1, regParam=(0.001, 1.0)) and all(0.001 <= d["regParam"] <= 1 for d in draws)


def test_metrics_on_missing_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "t string, p string")
    per = {r.label: (r.support, r.precision, r.recall, r.f1) for r in metrics.class_metrics(df, "t", "p").collect()}
    assert per == {"a": (2, 0.5, 0.5, 0.5), "b": (0, 0.0, 0.0, 0.0), "c": (1, 0.0, 0.0, 0.0)}
    r = metrics.classification_metrics(df, "t", "p").first()
    assert (r.accuracy, r.precision) == (pytest.approx(1 / 3), pytest.approx(1 / 6))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.booleans()), min_size=1, max_size=30))
def test_average_precision(spark, items):
    df = spark.createDataFrame([("k", float(s), int(h)) for s, h in items], "k string, s double, h int")
    got = metrics.average_precision(df, "s", "h", ["k"]).first().average_precision
    total, want, last = sum(h for _, h in items), 0.0, 0
    for cut in sorted({s for s, _ in items}, reverse=True):
        tp = sum(h for s, h in items if s >= cut)
        want += (tp - last) / total * tp / sum(s >= cut for s, _ in items) if total else 0
        last = tp
    assert got == pytest.approx(want) and 0 <= got <= 1


def test_binarize_ignores_unknown(spark):
    df = spark.createDataFrame([(["a", "zzz"],)], "t array<string>")
    assert prepare.binarize_labels(df, "t", ["a", "b"]).first().binary == [1, 0]
