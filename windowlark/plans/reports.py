"""Composite reports over tracks and label sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.functions.text import track_number
from windowlark.operators.aggregates import count_by
from windowlark.operators.knn import knn_exact
from windowlark.operators.ordered import assign_row_id
from windowlark.operators.windows import top_per_group
from windowlark.session import materialize


def annotate_tracks(windows: DataFrame, labels: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Every window of either side with its label, or ``none``."""
    return windows.join(labels, list(keys), "full").fillna("none", subset=[label])


def duration_profile(durations: DataFrame, by: str) -> DataFrame:
    """Per group: tracks, hours, mean, shortest, longest, tracks of 29 to 31 s, tracks under 5 s (M6)."""
    d = F.col("duration")
    return durations.groupBy(by).agg(
        F.count("*").alias("n"),
        (F.sum(d) / 3600).alias("hours"),
        F.avg(d).alias("mean_sec"),
        F.min(d).alias("min_sec"),
        F.max(d).alias("max_sec"),
        F.count_if(d.between(29, 31)).alias("n_half_minute"),
        F.count_if(d < 5).alias("n_short"),
    )


def label_sets(metadata: DataFrame, secondary: str = "secondary", file: str = "filename") -> DataFrame:
    """(file, label) rows of primary and secondary labels, each once."""
    first = metadata.select(file, F.col("primary_label").alias("label"))
    more = metadata.select(file, F.explode(secondary).alias("label"))
    return first.union(more).distinct()


def label_profile(metadata: DataFrame, secondary: str = "secondary", file: str = "filename") -> tuple[DataFrame, DataFrame]:
    """(label frequencies, label sets of files that have several)."""
    pairs = label_sets(metadata, secondary, file)
    freq = pairs.groupBy("label").agg(F.count("*").alias("n"))
    multi = (
        pairs.groupBy(file)
        .agg(F.array_sort(F.collect_set("label")).alias("labels"))
        .where(F.size("labels") > 1)
        .withColumn("xc_id", track_number(file))
    )
    return freq, multi


def build_neighbor_table(
    intervals: DataFrame, embeddings: DataFrame, metadata: DataFrame, on: Sequence[str], track: str, order: Sequence[str], vec: str, k: int = 50
) -> DataFrame:
    """Intervals, vectors and metadata joined, numbered, with their neighbour lists (M3).

    The numbered table is written once before the graph is built: the graph and the result both read it.
    """
    joined = intervals.join(embeddings, list(on)).join(metadata, track)
    numbered = materialize(assign_row_id(joined, order))
    return numbered.join(knn_exact(numbered, "id", vec, k), "id")


def best_window_subset(
    df: DataFrame, by: Sequence[str], best: Sequence[Column], order: Sequence[str], vec: str, k: int = 20
) -> DataFrame:
    """Best window per group, renumbered, with neighbours among themselves (M4)."""
    numbered = materialize(assign_row_id(top_per_group(df, by, best), order))
    return numbered.join(knn_exact(numbered, "id", vec, k), "id")


def fixture_subset(df: DataFrame, label: str, order: Sequence[str], classes: int = 3, rows: int = 9) -> DataFrame:
    """First rows of the least frequent classes (M27); the broadcast holds ``classes`` rows."""
    rare = count_by(df, [label], "_n").orderBy("_n", label).limit(classes).select(label)
    return top_per_group(df.join(F.broadcast(rare), label, "left_semi"), [label], [F.asc(c) for c in order], rows)
