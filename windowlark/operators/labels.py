"""Cleaner labels from neighbours, thresholds and channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowlark.functions.vector import sigmoid
from windowlark.operators.aggregates import count_by, percentiles
from windowlark.operators.joins import attach_neighbor
from windowlark.operators.rows import explode_classes
from windowlark.operators.ordered import join_classes
from windowlark.operators.windows import top_per_group


def knn_labels(
    nodes: DataFrame, edges: DataFrame, label: str = "guess", truth: str = "truth", node_id: str = "id"
) -> DataFrame:
    """Majority label of each node's neighbours (K3).

    Per node: winning label (ties to the smaller one), its votes, all votes, their ratio, distance
    percentiles, and the node's own labels. ``edges`` has (id, neighbor_id, distance).

    Votes are partitioned by node once; the counts, the total, the winner, the percentiles and the joins
    all keep that partitioning. A node has only as many votes as neighbours, so no partition runs hot.
    """
    votes = attach_neighbor(edges, nodes.select(node_id, F.col(label).alias("knn_label")), node_id=node_id)
    votes = votes.repartition(node_id)
    node = Window.partitionBy(node_id)
    place = F.row_number().over(node.orderBy(F.desc("n"), F.asc("knn_label")))
    counts = count_by(votes, [node_id, "knn_label"]).withColumns({"total": F.sum("n").over(node), "_place": place})
    winner = counts.where("_place = 1").drop("_place").withColumn("score", F.col("n") / F.col("total"))
    spread = percentiles(votes, "distance", [0.05, 0.5, 0.95], [node_id])
    ego = nodes.select(node_id, F.col(truth).alias("ego_truth"), F.col(label).alias("ego_label"))
    return winner.join(spread, node_id).join(ego, node_id)


def label_agreement(labeled: DataFrame) -> DataFrame:
    """How often a node's own label and its neighbours' label match the truth, by true class (K4)."""
    own = F.count_if(F.col("ego_truth") == F.col("ego_label"))
    voted = F.count_if(F.col("ego_truth") == F.col("knn_label"))
    counts = labeled.groupBy("ego_truth").agg(
        F.count("*").alias("n"), own.alias("n_ego_matches"), voted.alias("n_knn_matches")
    )
    return counts.select(
        "*",
        (F.col("n_ego_matches") / F.col("n")).alias("pct_ego_matches"),
        (F.col("n_knn_matches") / F.col("n")).alias("pct_knn_matches"),
    ).orderBy(F.desc("n"), "ego_truth")


def class_subset(nodes: DataFrame, labeled: DataFrame, n: int, truth: str = "truth", vec: str = "emb") -> DataFrame:
    """Voted rows of the n-th most frequent class, with their vectors (K5)."""
    from windowlark.operators.sampling import nth_frequent

    chosen = nth_frequent(nodes.select("id", truth, vec), truth, n)
    return labeled.join(chosen.select("id", vec), "id")


def knn_classify(edges: DataFrame, labels: DataFrame, label: str, node_id: str = "id") -> DataFrame:
    """Majority label over edges from test rows to labelled training rows (K6)."""
    votes = attach_neighbor(edges, labels.select(node_id, F.col(label).alias("vote")), node_id=node_id)
    counts = count_by(votes, [node_id, "vote"])
    return top_per_group(counts, [node_id], [F.desc("n"), F.asc("vote")]).select(
        node_id, F.col("vote").alias("prediction"), F.col("n").alias("votes")
    )


def adaptive_threshold(
    df: DataFrame, by: str, score: str, common: float = 0.4, rare: float = 0.05, min_count: int = 100,
    counted: Column | None = None,
) -> DataFrame:
    """Keep rows above ``common``, or above ``rare`` in classes with fewer than ``min_count`` rows.

    ``counted`` restricts which rows count towards the class size.
    """
    threshold = class_threshold(df, by, common, rare, min_count, counted)
    return threshold.where(F.col(score) > F.col("threshold")).drop("threshold")


def class_threshold(
    df: DataFrame, by: str, common: float, rare: float, min_count: int, counted: Column | None = None
) -> DataFrame:
    """Adds ``threshold``, chosen by the size of the row's class."""
    rows = df if counted is None else df.where(counted)
    frequent = count_by(rows, [by], "_n").where(F.col("_n") >= min_count).select(by, F.lit(common).alias("_t"))
    joined = join_classes(df, frequent, [by], "left")
    return joined.withColumn("threshold", F.coalesce("_t", F.lit(rare))).drop("_t")


def underrepresented(df: DataFrame, by: str, limit: int = 50) -> DataFrame:
    """Rows of classes with fewer than ``limit`` rows."""
    rare = count_by(df, [by], "_n").where(F.col("_n") < limit).select(by)
    return join_classes(df, rare, [by], "left_semi")


def noise_negatives(
    df: DataFrame, vec: str, classes: Sequence[int], keep: Sequence[str], n: int = 250,
    threshold: float | None = None, label: str = "no_call",
) -> DataFrame:
    """Windows that score high on noise classes, relabelled.

    Either the top ``n`` per class, or all above a probability. ``keep`` must identify a window.
    """
    scored = explode_classes(df, vec, classes, keep, "logit").withColumn("probability", sigmoid("logit"))
    if threshold is not None:
        chosen = scored.where(F.col("probability") > threshold)
    else:
        keys = [F.asc(c) for c in keep if dict(df.dtypes)[c] in ("bigint", "int", "string")]
        chosen = top_per_group(scored, ["index"], [F.desc("logit"), *keys], n)
    return chosen.drop("logit").withColumn("species", F.lit(label))


def loudest_channel(df: DataFrame, stem: str, channel: str, energy: str) -> DataFrame:
    """Channel that holds the loudest window of each recording; ties keep all.

    It is the loudest single window that counts, not the channel's total.
    """
    from windowlark.operators.windows import best_with_ties

    peaks = df.groupBy(stem, channel).agg(F.max(energy).alias(energy))
    return best_with_ties(peaks, [stem], energy).select(stem, channel)


def representative_source(df: DataFrame, stem: str, channel: str, species: str, prediction: str) -> DataFrame:
    """Separated channel with most windows predicted as the recording's own class."""
    hits = df.where((F.col(channel) != "original") & (F.col(species) == F.col(prediction)))
    counts = count_by(hits, [stem, channel])
    return top_per_group(counts, [stem], [F.desc("n"), F.asc(channel)])


def best_scored_window(df: DataFrame, by: Sequence[str], vec: str) -> DataFrame:
    """Windows with the highest maximum score in their group, ties kept."""
    from windowlark.operators.windows import best_with_ties

    return best_with_ties(df.withColumn("max_score", F.array_max(vec)), by, "max_score")
