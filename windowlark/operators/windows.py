"""Per-group ranking and neighbouring rows, arranged so that one huge group does not land in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowlark.operators.ordered import group_position, join_classes, same_keys, with_halo

# Spark prunes a row_number() <= k filter before the shuffle up to this k
PRUNED_LIMIT = 1000


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per group (E1, E8); the order must be total.

    Up to the limit each map task sends at most ``k`` rows per group; beyond it, positions come from a
    range-partitioned sort.
    """
    if k > PRUNED_LIMIT:
        return group_position(df, by, order, "_pos").where(F.col("_pos") <= k).drop("_pos")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def best_with_ties(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """All rows that share the largest value of their group (E2): a maximum per group, joined back."""
    best = df.groupBy(*by).agg(F.max(value).alias("_best"))
    keys = best.select(*[F.col(c).alias(f"_k_{c}") for c in by], "_best")
    match = same_keys(df, keys, [*[(c, f"_k_{c}") for c in by], (value, "_best")])
    return df.join(keys, match).select(*df.columns)


def with_group_total(df: DataFrame, by: Sequence[str], total: Column, name: str) -> DataFrame:
    """An aggregate of the group beside each row."""
    return join_classes(df, df.groupBy(*by).agg(total.alias(name)), by)


def with_group_size(df: DataFrame, by: Sequence[str], name: str = "group_size") -> DataFrame:
    return with_group_total(df, by, F.count("*"), name)


def share_of_group(df: DataFrame, by: Sequence[str], value: str, name: str = "share") -> DataFrame:
    with_total = with_group_total(df, by, F.sum(value), "total")
    return with_total.withColumn(name, F.col(value) / F.col("total"))


def sample_per_group(df: DataFrame, by: Sequence[str], key: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """``k`` pseudo-random rows per group, the same ones on every run."""
    order = [F.xxhash64(*key, F.lit(seed)), *[F.col(c) for c in key]]
    return top_per_group(df, by, order, k)


def lead_or_self(
    df: DataFrame, by: Sequence[str], order: str, col: str, name: str, width: int = 65536
) -> DataFrame:
    """Value of the next row in the group, or the row's own when it is the last.

    ``order`` is an integer that is unique in its group. Groups are cut into blocks of ``width`` order
    values, and the first row of each block is copied to the end of the block before it, found among
    block heads (one row per block). A long recording is so spread over many tasks in one shuffle.
    """
    block = F.floor(F.col(order) / width).cast("bigint")
    cut = df.withColumn("_block", block)
    heads = cut.groupBy(*by, "_block").agg(
        F.min(order).alias(order), F.min_by(F.struct(F.col(col).alias("v")), order).alias("_head")
    )
    before = F.lag("_block").over(Window.partitionBy(*by).orderBy("_block"))
    copies = heads.withColumn("_before", before).where("_before is not null").select(
        *by, F.col("_before").alias("_block"), order, F.col("_head.v").alias(col), F.lit(True).alias("_copy")
    )
    wide = cut.withColumn("_copy", F.lit(False)).unionByName(copies, allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_block").orderBy(order)
    value = F.coalesce(F.lead(col).over(inside), F.col(col))
    return wide.withColumn(name, value).where(~F.col("_copy")).drop("_block", "_copy")


def moving_avg(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], col: str, n: int, name: str, width: int = 65536
) -> DataFrame:
    """Mean of the row and its ``n - 1`` predecessors; null until there are ``n`` of them."""
    placed = group_position(df, by, order, "_pos")
    frame = Window.partitionBy(*by, "_block").orderBy("_pos").rowsBetween(-(n - 1), 0)
    wide = with_halo(placed, "_pos", before=n - 1, width=width).withColumn(
        name, F.when(F.count(col).over(frame) == n, F.avg(col).over(frame))
    )
    return wide.where(~F.col("_copy")).drop("_pos", "_block", "_copy")


def busiest_group(df: DataFrame, by: Sequence[str], size: Column) -> DataFrame:
    """Rows of the group (or tied groups) with the largest total (E10): groups first, then their rows."""
    totals = df.groupBy(*by).agg(F.sum(size).alias("total"))
    top = totals.where(F.col("total") == totals.agg(F.max("total")).scalar())
    return join_classes(df, top, by)
