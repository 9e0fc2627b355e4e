"""Order, limits, deterministic sampling and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.functions.vector import unit_hash
from windowlark.operators.aggregates import count_by
from windowlark.operators.ordered import assign_row_id, group_position, join_classes


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Sort and limit in one pass: each task keeps its own best ``k`` (F2)."""
    return df.orderBy(*order).limit(k)


def nth_frequent(df: DataFrame, by: str, n: int) -> DataFrame:
    """Rows of the n-th (0-based) most frequent group; the broadcast is one row."""
    pick = count_by(df, [by], "_n").orderBy(F.desc("_n"), F.asc(by)).offset(n).limit(1)
    return df.join(F.broadcast(pick.select(by)), by, "left_semi")


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = 0) -> DataFrame:
    """A repeatable random order."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key)


def sample_strata(
    df: DataFrame, key: Sequence[str], fraction: Column | float, seed: int = 0, bucket: Column | None = None
) -> DataFrame:
    """Bernoulli sample by hash, or by ``bucket``, a uniform number per row; the fraction may be a column that
    depends on the stratum (F5)."""
    return df.where((unit_hash(*key, seed=seed) if bucket is None else bucket) < fraction)


def split(df: DataFrame, key: Sequence[str], weights: Sequence[float], seed: int = 0, bucket: Column | None = None) -> DataFrame:
    """Adds ``part``: 0, 1, ... in the given proportions, from a uniform number per row."""
    u = unit_hash(*key, seed=seed) if bucket is None else bucket
    total, edge = float(sum(weights)), 0.0
    part = F.lit(len(weights) - 1)
    cuts = []
    for w in weights[:-1]:
        edge += w / total
        cuts.append(edge)
    for i in reversed(range(len(cuts))):
        part = F.when(u < cuts[i], F.lit(i)).otherwise(part)
    return df.withColumn("part", part)


def split_stratified(
    df: DataFrame, by: str, frac: float, key: Sequence[str], seed: int = 0, order: Sequence[Column] | None = None
) -> DataFrame:
    """Adds ``is_train``: the first ``floor(frac * n)`` rows of each class in hash order."""
    order = order or [F.xxhash64(*key, F.lit(seed)), *[F.col(k) for k in key]]
    placed = group_position(df, [by], order, "_pos")
    sized = join_classes(placed, count_by(df, [by], "_n"), [by])
    return sized.withColumn("is_train", F.col("_pos") <= F.floor(F.col("_n") * frac)).drop("_pos", "_n")


def split_positional(df: DataFrame, order: Sequence[Column | str], frac: float) -> DataFrame:
    """Adds ``is_train``: the first ``floor(frac * n)`` rows of the whole order; no row is lost (F8)."""
    placed = assign_row_id(df, order, "_pos", start=1)
    total = placed.agg(F.count("*")).scalar()
    return placed.withColumn("is_train", F.col("_pos") <= F.floor(total * frac)).drop("_pos")


def reindex_edges(edges: DataFrame, coord: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Edge ends replaced by their 0-based rank along a coordinate."""
    ranks = assign_row_id(coord, order, "rank", start=0).select("id", "rank")
    near = ranks.select("id", F.col("rank").alias("mapped_id"))
    far = ranks.select(F.col("id").alias("neighbor_id"), F.col("rank").alias("mapped_neighbor"))
    return edges.join(near, "id").join(far, "neighbor_id")
