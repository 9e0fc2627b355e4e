"""Positions and running totals over a sort order, without a single-task window.

A window over one huge group (or over no group at all) runs in one task. These operators range-partition
by the full sort key instead, so a group of any size is spread over many segments, and carry the
segment totals forward. The sort key must be total (end it with a unique column) to be deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowlark.session import materialize

_LOW_BITS = (1 << 33) - 1


def same_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality over key pairs, still an equi-join to the planner."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def join_back(df: DataFrame, totals: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-key aggregates to their detail rows; null keys match.

    Used in place of an aggregate over ``Window.partitionBy``: the aggregate combines map-side and the
    join lets adaptive execution broadcast the totals or split a hot key.
    """
    renamed = totals.withColumnsRenamed({c: f"_k_{c}" for c in by})
    joined = df.join(renamed, same_keys(df, renamed, [(c, f"_k_{c}") for c in by]), how)
    return joined.drop(*[f"_k_{c}" for c in by])


def join_classes(df: DataFrame, classes: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-class aggregate to its rows without shuffling the rows when the classes are few.

    The aggregate is written first, so the planner sees its true size: it broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges (with skew handling) above.
    """
    settled = materialize(classes)
    return df.join(settled, list(by), how) if how in ("left_semi", "left_anti") else join_back(df, settled, by, how)


def lay_out(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-partition and sort by ``order``; adds ``_seg`` (partition) and ``_off`` (0-based row in it)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("_place", F.monotonically_increasing_id())
    return materialize(
        placed.withColumn("_seg", F.shiftright("_place", 33))
        .withColumn("_off", F.col("_place").bitwiseAND(F.lit(_LOW_BITS)))
        .drop("_place")
    )


def assign_row_id(
    df: DataFrame, order: Sequence[Column | str], name: str = "id", start: int = 1
) -> DataFrame:
    """Dense global id over a sort order."""
    laid = lay_out(df, order)
    sizes = laid.groupBy("_seg").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    # one row per shuffle partition, so the broadcast is bounded by the partition count
    return (
        laid.join(F.broadcast(carry), "_seg")
        .withColumn(name, (F.col("_carry") + F.col("_off") + start).cast("bigint"))
        .drop("_seg", "_off", "_carry")
    )


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column]
) -> DataFrame:
    """Inclusive running sums within each group; a hot group spans many segments.

    Groups are contiguous in the sort order, so only the first group of a segment can continue from
    earlier ones: at most one carry per segment, which bounds the broadcast by the partition count.
    """
    step = {f"_v{i}": c for i, c in enumerate(sums.values())}
    laid = lay_out(df.withColumns(step), [*by, *order])
    totals = laid.groupBy(*by, "_seg").agg(*[F.sum(v).alias(v) for v in step])
    before = Window.partitionBy(*by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *by, "_seg", F.count("*").over(before).alias("_earlier"), *[F.sum(v).over(before).alias(f"{v}c") for v in step]
    ).where("_earlier > 0")
    joined = join_back(laid, F.broadcast(carry.drop("_earlier")), [*by, "_seg"], "left")
    inside = Window.partitionBy("_seg", *by).orderBy("_off")
    return joined.withColumns(
        {
            name: F.sum(v).over(inside) + F.coalesce(F.col(f"{v}c"), F.lit(0))
            for name, v in zip(sums, step, strict=True)
        }
    ).drop("_seg", "_off", *step, *[f"{v}c" for v in step])


def group_position(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "pos"
) -> DataFrame:
    """1-based position of each row in its group, for groups of any size."""
    return running_totals(df, by, order, {name: F.lit(1).cast("bigint")})


def with_halo(df: DataFrame, pos: str, before: int = 0, width: int = 65536) -> DataFrame:
    """Cut positions into blocks of ``width``; copy the last ``before`` rows of a block into the next one.

    Adds ``_block`` and ``_copy``; windows over (group, ``_block``) then see the rows they reach back to.
    """
    if before >= width:
        raise ValueError("the halo must be smaller than the block width")
    own = F.floor(F.col(pos) / width).cast("bigint")
    late = F.pmod(F.col(pos), F.lit(width)) >= width - before
    places = F.when(
        late,
        F.array(
            F.struct(own.alias("_block"), F.lit(False).alias("_copy")),
            F.struct((own + 1).alias("_block"), F.lit(True).alias("_copy")),
        ),
    ).otherwise(F.array(F.struct(own.alias("_block"), F.lit(False).alias("_copy"))))
    return df.select("*", F.inline(places))
