"""Join shapes. Sides are broadcast only when a parameter bounds their rows; the rest is left to adaptive execution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.session import materialize
from windowlark.operators.ordered import assign_row_id



def attach_neighbor(edges: DataFrame, nodes: DataFrame, key: str = "neighbor_id", node_id: str = "id") -> DataFrame:
    """Node attributes beside each edge's far end."""
    return edges.join(nodes.withColumnRenamed(node_id, key), key)


def propagate_labels(df: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels on a partial key to every matching row; the fan-out is the number of labels per key."""
    return df.join(labels, list(keys))


def join_on_pattern(
    left: DataFrame, lcol: str, right: DataFrame, rcol: str, pattern: str, key: str = "key"
) -> DataFrame:
    """Equi-join on the first capture group of a pattern; rows without a match drop out."""

    def keyed(df: DataFrame, col: str) -> DataFrame:
        return df.withColumn(key, F.regexp_extract(col, pattern, 1)).where(F.col(key) != "")

    return keyed(left, lcol).join(keyed(right, rcol), key)


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: str = "unknown") -> DataFrame:
    """Dictionary lookup with a default; ``dim`` must be unique on ``key``."""
    found = df.join(dim.select(key, F.col(value).alias("_found")), key, "left")
    return found.withColumn(value, F.coalesce("_found", F.lit(default))).drop("_found")


def attach_class(df: DataFrame, dictionary: DataFrame, index: str = "index") -> DataFrame:
    """Class names beside class indices."""
    return df.join(dictionary, index)


def pair_with_slots(df: DataFrame, small: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """Every row beside each of the first ``n`` rows of ``small``.

    Rows expand to slot numbers and meet the numbered small side in an equi-join, so no nested-loop
    product is planned. The chosen rows are written, so the planner broadcasts them by their true size.
    """
    chosen = assign_row_id(small.orderBy(*order).limit(n), order, "_slot", start=0)
    slots = df.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return slots.join(materialize(chosen), "_slot").drop("_slot")


def random_partner(
    df: DataFrame, other: DataFrame, key: Sequence[str], n: int | None = None, seed: int = 0, index: str = "index",
    bucket: Column | None = None,
) -> DataFrame:
    """Each row draws one of the indices of ``other``, dense from 0, by hash of its key; no row is lost.

    ``n`` draws from [0, n) instead: a draw that ``other`` lacks then drops its row. ``bucket`` is an integer column
    that stands in for the hash.
    """
    size = F.lit(n) if n is not None else other.agg(F.count("*")).scalar()
    draw = F.pmod(F.xxhash64(*key, F.lit(seed)) if bucket is None else bucket.cast("bigint"), size)
    return df.withColumn(index, draw.cast("bigint")).join(other, index).drop(index)
