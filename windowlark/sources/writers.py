"""Sinks and work-list helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.operators.ordered import assign_row_id


def write_table(
    df: DataFrame,
    path: str,
    partitions: int | None = None,
    compression: str | None = None,
    mode: str = "overwrite",
) -> None:
    """Parquet in ``partitions`` files of about equal size, or in as many as the plan yields."""
    out = df.repartition(partitions) if partitions else df
    writer = out.write.mode(mode)
    (writer.option("compression", compression) if compression else writer).parquet(path)


def write_single(df: DataFrame, path: str) -> None:
    """One Parquet file, streamed by one task after the plan has run in parallel; of any size."""
    df.repartition(1).write.mode("overwrite").parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines in one file, streamed by one task after the plan has run in parallel."""
    df.repartition(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def pending(work: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Work items whose key is not in the output yet."""
    keys = [key] if isinstance(key, str) else list(key)
    return work.join(done.select(*keys), keys, "left_anti")


def assign_batches(df: DataFrame, size: int, order: Sequence[Column | str]) -> DataFrame:
    """Batch number per work item, ``size`` items a batch; a size below 1 gives one batch."""
    if size < 1:
        return df.withColumn("batch", F.lit(0).cast("bigint"))
    placed = assign_row_id(df, order, "_pos", start=0)
    return placed.withColumn("batch", F.floor(F.col("_pos") / size).cast("bigint")).drop("_pos")
