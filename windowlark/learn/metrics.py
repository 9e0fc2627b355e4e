"""Evaluation on tables: confusion counts, label sets, average precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.operators.ordered import running_totals
from windowlark.session import materialize


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where undefined."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def _scores(counts: DataFrame, key: str) -> DataFrame:
    """Precision, recall and F1 from ``tp``, ``support`` and ``predicted``."""
    return counts.select(
        key,
        "support",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def class_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, support, precision, recall, f1) over the labels of either side."""
    return _class_metrics(df.groupBy(truth, pred).agg(F.count("*").alias("n")), truth, pred)


def _class_metrics(counts: DataFrame, truth: str, pred: str) -> DataFrame:
    hit = F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(truth).alias("label"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col(pred).alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    rows = counts.select(F.inline(sides)).where(F.col("label").isNotNull())
    return _scores(rows.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")]), "label")


def macro(per_class: DataFrame) -> DataFrame:
    return per_class.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def classification_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: accuracy and macro precision, recall, F1."""
    # one scan: the confusion counts, written, hold the accuracy too
    counts = materialize(df.groupBy(truth, pred).agg(F.count("*").alias("n")))
    same = F.col(truth) == F.col(pred)
    accuracy = counts.agg(F.sum(F.when(same, F.col("n")).when(~same, 0)) / F.sum(F.when(same.isNotNull(), F.col("n")))).scalar()
    return macro(_class_metrics(counts, truth, pred)).select(accuracy.alias("accuracy"), "precision", "recall", "f1")


def multilabel_class_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    # membership is settled in the row, so that exploded rows carry two flags and not the arrays
    item = F.transform(
        F.array_union(truth, pred),
        lambda x: F.struct(x.alias("label"), F.array_contains(truth, x).alias("in_truth"), F.array_contains(pred, x).alias("in_pred")),
    )
    rows = df.select(F.inline(item))
    return _scores(
        rows.groupBy("label").agg(
            F.count_if(F.col("in_truth") & F.col("in_pred")).alias("tp"),
            F.count_if("in_truth").alias("support"),
            F.count_if("in_pred").alias("predicted"),
        ),
        "label",
    )


def multilabel_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: subset accuracy (equal label sets) and macro precision, recall, F1."""
    same = F.array_sort(F.array_distinct(truth)) == F.array_sort(F.array_distinct(pred))
    accuracy = df.agg(F.avg(same.cast("int"))).scalar()
    return macro(multilabel_class_metrics(df, truth, pred)).select(accuracy.alias("accuracy"), "precision", "recall", "f1")


def average_precision(df: DataFrame, score: str, truth: str, by: Sequence[str]) -> DataFrame:
    """Average precision per class; rows of equal score enter together.

    Rows are first counted per distinct score; the cumulative counts then run over range-partitioned
    scores, so a class with a third of all rows is not sorted in one task.
    """
    counted = df.groupBy(*by, score).agg(F.count("*").alias("_n"), F.sum(F.col(truth).cast("bigint")).alias("_pos"))
    steps = running_totals(counted, by, [F.desc(score)], {"_tp": F.col("_pos"), "_seen": F.col("_n")})
    gained = F.sum(F.col("_pos") * F.col("_tp") / F.col("_seen"))
    return steps.groupBy(*by).agg(_ratio(gained, F.sum("_pos")).alias("average_precision"))


def macro_average_precision(df: DataFrame, scores: str, truth: str, classes: Sequence) -> DataFrame:
    """One row: mean over the classes that occur of their average precision.

    ``scores`` is a vector in the order of ``classes``; ``truth`` an array of labels, of one for single labels.
    """
    names = F.array(*[F.lit(c) for c in classes])
    item = F.transform(
        F.arrays_zip(names.alias("label"), F.col(scores).alias("score")),
        lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"), F.array_contains(truth, x["label"]).cast("int").alias("hit")),
    )
    rows = df.select(F.inline(item)).where("hit IS NOT NULL")
    per_class = average_precision(rows, "score", "hit", ["label"])
    occurring = rows.groupBy("label").agg(F.max("hit").alias("_any")).where("_any = 1").select("label")
    return per_class.join(occurring, "label").agg(F.avg("average_precision").alias("macro_average_precision"), F.count("*").alias("classes"))
