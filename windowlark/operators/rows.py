"""Projection, filter and row-expansion helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.functions import vector as V


def explode_zip(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Explode parallel arrays in lock-step; shorter arrays give nulls."""
    return df.select(*keep, F.inline(F.arrays_zip(*cols)))


def explode_indexed(df: DataFrame, col: str, keep: Sequence[str], index: str = "index", value: str = "value") -> DataFrame:
    """Explode with 0-based position."""
    return df.select(*keep, F.posexplode(col).alias(index, value))


def explode_classes(
    df: DataFrame, vec: str, indices: Sequence[int], keep: Sequence[str], value: str = "logit"
) -> DataFrame:
    """(index, value) rows for a few classes only: the choice is made before the explode."""
    return df.select(*keep, F.inline(V.pick(vec, indices))).withColumnRenamed("value", value).where(F.col(value).isNotNull())


def align_frames(df: DataFrame, col: str, frame: int = 5, offsets: Sequence[int] = (0, 3)) -> DataFrame:
    """Keep windows at fixed offsets of each frame and add the frame number ``seq_id``.

    Offsets (0, 3) of 5 are the later sets' windows; frame 10, offset 0 with ``seq_id`` of 5 is the first one's.
    """
    kept = df.where(F.pmod(F.col(col), F.lit(frame)).isin(list(offsets)))
    return kept.withColumn("seq_id", F.floor(F.col(col) / 5).cast("bigint"))


def vector_to_columns(df: DataFrame, vec: str, n: int, keep: Sequence[str], prefix: str = "embedding") -> DataFrame:
    """One column per vector entry in a single projection."""
    return df.select(*keep, *[F.get(F.col(vec), F.lit(i)).alias(f"{prefix}{i}") for i in range(n)])


def plan_segments(df: DataFrame, stem: Column | str, duration: Column | str, longest: float) -> DataFrame:
    """One row per part of a long track: part number, part name, length."""
    from windowlark.functions.text import part_name

    parts = V.duration_parts(duration, longest)
    d = F.col(duration) if isinstance(duration, str) else duration
    return (
        df.withColumn("parts", parts)
        .withColumn("part_sec", d / F.col("parts"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
        .withColumn("part_name", part_name(stem, "part"))
    )
