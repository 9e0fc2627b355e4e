"""Classifiers over vector columns, as Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
)
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowlark.functions.vector import unit_hash
from windowlark.learn.metrics import macro, macro_average_precision, multilabel_class_metrics
from windowlark.operators.ordered import group_position
from windowlark.session import materialize


def featurize(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))


def build_pipeline(classifier: Estimator, label: str, scale: bool = False, components: int | None = None) -> Pipeline:
    """Label index, optional scaling and projection, classifier."""
    stages: list = [StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip")]
    last = "features"
    if scale:
        stages.append(StandardScaler(inputCol=last, outputCol="scaled", withMean=True))
        last = "scaled"
    if components:
        stages.append(PCA(k=components, inputCol=last, outputCol="projected"))
        last = "projected"
    inner = classifier.getClassifier() if isinstance(classifier, OneVsRest) else classifier
    for part in {id(c): c for c in (classifier, inner)}.values():
        part.setFeaturesCol(last).setLabelCol("label_index")
    return Pipeline(stages=[*stages, classifier])


def fit(df: DataFrame, vec: str, label: str, classifier: Estimator, **kw) -> PipelineModel:
    ready = featurize(df.withColumn(label, F.col(label).cast("string")), vec)
    return build_pipeline(classifier, label, **kw).fit(ready)


def train_logistic(df: DataFrame, vec: str, label: str, weight: str | None = None, max_iter: int = 100, reg: float = 0.0, **kw) -> PipelineModel:
    """Multinomial or binary logistic regression (L4)."""
    lr = LogisticRegression(maxIter=max_iter, regParam=reg)
    return fit(df, vec, label, lr.setWeightCol(weight) if weight else lr, **kw)


def train_linear_svc(df: DataFrame, vec: str, label: str, max_iter: int = 100, parallelism: int = 4, **kw) -> PipelineModel:
    """One linear support-vector machine per class."""
    return fit(df, vec, label, OneVsRest(classifier=LinearSVC(maxIter=max_iter), parallelism=parallelism), **kw)


def train_gbt(df: DataFrame, vec: str, label: str, weight: str | None = None, max_iter: int = 20, max_depth: int = 5, parallelism: int = 4) -> PipelineModel:
    """Boosted trees, one ensemble per class, optionally weighted."""
    ovr = OneVsRest(classifier=GBTClassifier(maxIter=max_iter, maxDepth=max_depth, seed=1), parallelism=parallelism)
    return fit(df, vec, label, ovr.setWeightCol(weight) if weight else ovr)


def train_tree(df: DataFrame, vec: str, label: str, max_depth: int = 5) -> PipelineModel:
    return fit(df, vec, label, DecisionTreeClassifier(maxDepth=max_depth, seed=1))


def train_mlp(df: DataFrame, vec: str, label: str, size: int, classes: int, hidden: Sequence[int] = (64,), max_iter: int = 100) -> PipelineModel:
    """Multi-layer perceptron on scaled inputs."""
    mlp = MultilayerPerceptronClassifier(layers=[size, *hidden, classes], maxIter=max_iter, seed=1)
    return fit(df, vec, label, mlp, scale=True)


def train_nb(df: DataFrame, vec: str, label: str, kind: str = "multinomial") -> PipelineModel:
    """Naive Bayes, ``multinomial`` or ``complement``; needs values that are not negative."""
    return fit(df, vec, label, NaiveBayes(modelType=kind))


def predict(model: PipelineModel, df: DataFrame, vec: str, label: str, name: str = "prediction_label") -> DataFrame:
    """Adds the predicted label as text. Rows need no label column."""
    ready = featurize(df, vec)
    indexer = model.stages[0]
    for stage in model.stages[1:]:
        ready = stage.transform(ready)
    return IndexToString(inputCol="prediction", outputCol=name, labels=indexer.labels).transform(ready)


def score_vectors(df: DataFrame, model: PipelineModel, vec: str, label: str) -> DataFrame:
    """(original columns, prediction, probability): label and its probability in one pass."""
    scored = predict(model, df, vec, label, "_label")
    best = F.array_max(vector_to_array("probability"))
    return scored.select(*df.columns, F.col("_label").alias("prediction"), best.alias("probability"))


def score_with(df: DataFrame, load: Callable[[], object], vec: str, classes: Sequence[str]) -> DataFrame:
    """The same for a model from outside Spark, with ``predict_proba``: loaded once per worker, label and
    probability from one call per Arrow batch."""
    names = np.asarray(classes, dtype=object)

    @F.pandas_udf("label string, probability double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            probs = np.asarray(model.predict_proba(np.stack(batch.to_numpy())))
            top = probs.argmax(axis=1)
            yield pd.DataFrame({"label": names[top], "probability": probs[np.arange(len(top)), top]})

    scored = df.withColumn("_s", score(F.col(vec)))
    return scored.select(*df.columns, F.col("_s.label").alias("prediction"), F.col("_s.probability").alias("probability"))


def expand_files(files: DataFrame, make_rows: Callable[[str, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """Window rows from each (path, content) file by a user's feature function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield make_rows(path, content)

    return files.select("path", "content").mapInPandas(run, schema)


def train_per_label(df: DataFrame, vec: str, labels: str, classes: Sequence[str], make: Callable[[], Estimator] | None = None) -> dict[str, PipelineModel]:
    """One binary model per label of a fitted class list, over a cached feature table."""
    make = make or (lambda: LogisticRegression(maxIter=20))
    ready = featurize(df, vec).select("features", labels).persist()
    try:
        return {
            c: Pipeline(stages=[make().setLabelCol("_y")]).fit(
                ready.select("features", F.array_contains(labels, c).cast("double").alias("_y"))
            )
            for c in classes
        }
    finally:
        ready.unpersist()


def predict_per_label(models: dict[str, PipelineModel], df: DataFrame, vec: str, name: str = "predicted") -> DataFrame:
    """Labels whose own model says yes; the models run one after the other over the same rows."""
    out = featurize(df, vec)
    flags = []
    for i, (c, model) in enumerate(models.items()):
        scored = model.transform(out)
        out = scored.withColumn(f"_y{i}", F.col("prediction") > 0).drop("rawPrediction", "probability", "prediction")
        flags.append(F.when(F.col(f"_y{i}"), F.lit(c)))
    return out.withColumn(name, F.array_compact(F.array(*flags))).select(*df.columns, name)


def score_labels(models: dict[str, PipelineModel], df: DataFrame, vec: str, name: str = "scores") -> DataFrame:
    """Probabilities of all labels as one vector, in the order of ``models``: their coefficients make one matrix,
    so any number of linear models costs one pass and one column (L10)."""
    fitted = [m.stages[-1] for m in models.values()]
    weights = np.array([m.coefficients.toArray() for m in fitted])
    bias = np.array([m.intercept for m in fitted])

    @F.pandas_udf("array<double>")
    def scores(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(1 / (1 + np.exp(-(np.stack(vectors.to_numpy()).astype(float) @ weights.T + bias)))))

    return df.withColumn(name, scores(F.col(vec).cast("array<double>")))


def stratified_folds(df: DataFrame, by: str, key: Sequence[str], folds: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Fold of each row by its position in its class in hash order, so that rare classes are in every fold."""
    placed = group_position(df, [by], [F.xxhash64(*key, F.lit(seed)), *[F.col(k) for k in key]], "_pos")
    return placed.withColumn(name, (F.col("_pos") % folds).cast("int")).drop("_pos")


def search_labels(
    df: DataFrame, vec: str, labels: str, classes: Sequence[str], points: Sequence[dict], fold: str
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Search over linear models per label, scored by macro average precision and macro F1 on held-out folds.

    Returns models refitted on all rows at the best mean precision, and one row per point and fold.
    """
    names, rows = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()], []
    for p in points:
        for f in names:
            fitted = train_per_label(df.where(F.col(fold) != f), vec, labels, classes, lambda p=p: LogisticRegression(**p))
            scored = score_labels(fitted, df.where(F.col(fold) == f), vec, "_scores")
            known = F.array(*[F.lit(c) for c in classes])
            chosen = F.filter(F.arrays_zip(known.alias("label"), F.col("_scores").alias("score")), lambda x: x["score"] > 0.5)["label"]
            held = materialize(scored.select(F.col(labels).alias("truth"), F.col("_scores").alias("scores"), chosen.alias("chosen")))
            precision = macro_average_precision(held, "scores", "truth", classes).first()[0]
            f1 = macro(multilabel_class_metrics(held, "truth", "chosen")).first()["f1"]
            rows.append((str(p), int(f), float(precision or 0.0), float(f1 or 0.0)))
    table = df.sparkSession.createDataFrame(rows, "point string, fold int, average_precision double, f1 double")
    means = {str(p): np.mean([r[2] for r in rows if r[0] == str(p)]) for p in points}
    best = max(points, key=lambda p: means[str(p)])
    return train_per_label(df, vec, labels, classes, lambda: LogisticRegression(**best)), table


def stack_regression(df: DataFrame, stacked: str, target: str, name: str = "score", max_iter: int = 20) -> tuple[PipelineModel, DataFrame]:
    """Second level: boosted-tree regression of a 0/1 target on stacked scores; predictions clipped to [0, 1]."""
    ready = featurize(df, stacked)
    model = Pipeline(stages=[GBTRegressor(labelCol=target, maxIter=max_iter, maxDepth=3, seed=1)]).fit(ready)
    out = model.transform(ready).withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))))
    return model, out.drop("features", "prediction")


def grid(**choices: Sequence) -> list[dict]:
    return [dict(zip(choices, values, strict=True)) for values in product(*choices.values())]


def random_grid(n: int, seed: int, **ranges: tuple[float, float]) -> list[dict]:
    """Seeded log-uniform draws."""
    rng = np.random.default_rng(seed)
    return [{k: float(np.exp(rng.uniform(np.log(lo), np.log(hi)))) for k, (lo, hi) in ranges.items()} for _ in range(n)]


def search(
    df: DataFrame, vec: str, label: str, classifier: Estimator, points: Sequence[dict], metric: str = "f1", folds: int = 3,
    holdout: str | None = None, parallelism: int = 2, seed: int = 1, key: str | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Hyper-parameter search: (best model, table of point and score).

    k folds, or a fixed hold-out: ``holdout`` names a boolean column. Folds follow a hash of ``key`` when
    it is given, so that a re-run scores the same rows.
    """
    ready = featurize(df.withColumn(label, F.col(label).cast("string")), vec)
    pipe = build_pipeline(classifier, label)
    maps = [{classifier.getParam(k): v for k, v in p.items()} for p in points]
    evaluator: Evaluator = MulticlassClassificationEvaluator(labelCol="label_index", metricName=metric)
    if holdout:
        train, test = ready.where(~F.col(holdout)).persist(), ready.where(F.col(holdout)).persist()
        fitted = [pipe.fit(train, m) for m in maps]
        scores = [evaluator.evaluate(m.transform(test)) for m in fitted]
        best = fitted[int(np.argmax(scores))]
        train.unpersist()
        test.unpersist()
    elif folds > 1:
        cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, parallelism=parallelism, seed=seed)
        if key:
            ready = ready.withColumn("_fold", F.floor(unit_hash(key, seed=seed) * folds).cast("int"))
            cv = cv.setFoldCol("_fold")
        model = cv.fit(ready)
        best, scores = model.bestModel, model.avgMetrics
    else:
        model = TrainValidationSplit(estimator=pipe, estimatorParamMaps=maps, evaluator=evaluator, trainRatio=0.7, parallelism=parallelism, seed=seed).fit(ready)
        best, scores = model.bestModel, model.validationMetrics
    rows = [(str(p), float(s)) for p, s in zip(points, scores, strict=True)]
    return best, df.sparkSession.createDataFrame(rows, "point string, score double").orderBy(F.desc("score"), "point")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
