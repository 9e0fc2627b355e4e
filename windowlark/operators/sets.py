"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """UNION ALL after taking the first side's columns from the second."""
    return a.union(b.select(*a.columns))


def overlap_share(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a``, how many of them ``b`` has, and their share."""
    left = a.select(key).distinct()
    marked = left.join(b.select(key, F.lit(1).alias("_hit")).distinct(), key, "left")
    return marked.agg(
        F.count("*").alias("n"),
        F.count("_hit").alias("shared"),
        (F.count("_hit") / F.count("*")).alias("share"),
    )


def keys_except(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")
