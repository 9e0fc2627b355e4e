"""Label encoding, class weights and score scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowlark.functions.vector import binarize
from windowlark.operators.aggregates import count_by
from windowlark.operators.ordered import assign_row_id, join_classes


def encode_labels(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """Alphabetical 0-based code per label (L1)."""
    codes = assign_row_id(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], name, start=0)
    return join_classes(df, codes, [col])


def binarize_labels(df: DataFrame, labels: str, classes: Sequence, name: str = "binary") -> DataFrame:
    """0/1 vector per row over a fitted class list; unseen labels are ignored (L2)."""
    return df.withColumn(name, binarize(labels, classes))


def balanced_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """``n / (classes * n_class)`` per row (L3)."""
    counts = count_by(df, [label], "_n")
    total, classes = counts.agg(F.sum("_n")).scalar(), counts.agg(F.count("*")).scalar()
    weights = counts.select(label, (total / (classes * F.col("_n"))).alias(name))
    return join_classes(df, weights, [label])


def prior_scaled(df: DataFrame, score: str, prior: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Score of a row times the prior share of every class: (keep, label, scaled).

    The prior has one row per class; it becomes one constant array, so no product of tables is planned and
    no job runs until the result is read.
    """
    packed = prior.agg(F.array_sort(F.collect_list(F.struct("label", "share")))).scalar()
    rows = df.select(*keep, score, F.inline(packed))
    return rows.select(*keep, "label", (F.col(score) * F.col("share")).alias("scaled"))
