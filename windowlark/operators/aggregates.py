"""Aggregations. Everything combines map-side; per-row totals come from a join, not from a window over a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowlark.operators.itemsets import frequent_sets
from windowlark.operators.ordered import group_position


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def match_rate(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    hit = (F.col(a) == F.col(b)).cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("rate"))


def pct_match(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Percent of matching labels per true class in one scan; classes without a match stay, at 0."""
    hit = F.when(F.col(truth) == F.col(pred), 1).otherwise(0)
    return df.groupBy(truth).agg((F.sum(hit) * 100 / F.count("*")).alias("pct"))


def percentiles(df: DataFrame, col: str, ps: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Approximate percentiles as ``{col}_p05`` and so on, from one sketch per group."""
    sketch = df.groupBy(*by).agg(F.percentile_approx(col, list(ps)).alias("_q"))
    return sketch.select(*by, *[F.get("_q", F.lit(i)).alias(f"{col}_p{round(p * 100):02d}") for i, p in enumerate(ps)])


def distinct_count(df: DataFrame, col: str, by: Sequence[str], approx: bool = False, name: str = "n") -> DataFrame:
    """Distinct values per group, exact or by sketch."""
    count = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.groupBy(*by).agg(count.alias(name))


def collect_distinct(df: DataFrame, by: Sequence[str], col: str, name: str) -> DataFrame:
    """Sorted set per group. The set is bounded by the label vocabulary, and duplicates go map-side."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(col)).alias(name))


def collect_ordered(
    df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str], desc: bool = False
) -> DataFrame:
    """Arrays in a given order, for groups that are bounded by their meaning (windows of one frame).

    For groups of any size use ``ordered.group_position``, which keeps one row per item.
    """
    item = F.sort_array(F.collect_list(F.struct(*order, *[c for c in cols if c not in order])), asc=not desc)
    packed = df.groupBy(*by).agg(item.alias("_items"))
    return packed.select(*by, *[F.col("_items")[c].alias(c) for c in cols])


def freq_of_freq(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many groups have each size."""
    return count_by(df, keys, "size").groupBy("size").agg(F.count("*").alias("n"))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order (D10); each task sends one row per key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rest = [c for c in df.columns if c not in keys]
    return df.withColumn("_place", place).where(F.col("_place") <= 1).select(*keys, *rest)


def coverage_pct(df: DataFrame, part: Column, name: str = "pct") -> DataFrame:
    """Rows that satisfy a condition, in percent of all rows, in one pass."""
    return df.agg((F.count_if(part) * 100 / F.count("*")).alias(name))


def summarize(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum."""
    return df.agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.stddev(col).alias("stddev"),
        F.min(col).alias("min"),
        F.percentile_approx(col, [0.25, 0.5, 0.75]).alias("_q"),
        F.max(col).alias("max"),
    ).select(
        "n", "mean", "stddev", "min", F.get("_q", F.lit(0)).alias("p25"), F.get("_q", F.lit(1)).alias("p50"),
        F.get("_q", F.lit(2)).alias("p75"), "max",
    )


def mean_of(vec: str) -> Column:
    """Aggregate: element-wise mean of an array column."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))))


def mean_vector(
    df: DataFrame, by: Sequence[str], vec: str, name: str | None = None, distinct: bool = False
) -> DataFrame:
    """Element-wise mean of vectors per group.

    The summarizer keeps one running mean per group and map task, so vectors are neither exploded nor
    collected. ``distinct`` drops repeated vectors of a group first, by two hashes of the vector.
    """
    rows = df.select(*by, vec)
    if distinct:
        rows = rows.groupBy(*by, F.xxhash64(vec).alias("_h"), F.xxhash64(F.lit(1), vec).alias("_g")).agg(F.any_value(vec).alias(vec))
    return rows.groupBy(*by).agg(mean_of(vec).alias(name or vec))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equi-width bins between minimum and maximum, the last one closed; empty bins are left out."""
    values = df.select(value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    ends = values.agg(F.struct(F.min("_v").alias("low"), F.max("_v").alias("high"))).scalar()
    low, spread = ends["low"], F.nullif(ends["high"] - ends["low"], F.lit(0.0))
    place = F.coalesce(F.floor((F.col("_v") - low) / spread * bins), F.lit(0)).cast("bigint")
    return values.groupBy(F.least(place, F.lit(bins - 1).cast("bigint")).alias("bin")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return count_by(df, [col]).orderBy(F.desc("n"), F.asc(col)).limit(n)


def lump_top_n(df: DataFrame, col: str, n: int, other: str = "other", name: str = "lump") -> DataFrame:
    """Frequent values kept, the rest become ``other`` (D16); the broadcast holds ``n`` rows."""
    top = top_values(df, col, n).select(F.col(col), F.col(col).cast("string").alias(name))
    joined = df.join(F.broadcast(top), col, "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(other)))


def cooccurrence(df: DataFrame, by: str, labels: str, name: str = "together") -> DataFrame:
    """All labels seen with a primary label."""
    return collect_distinct(df.select(by, F.explode(labels).alias("_label")), [by], "_label", name)


def frequent_itemsets(
    df: DataFrame, items: str, support: float = 0.001, confidence: float = 0.01, min_size: int = 2, max_size: int | None = None
) -> DataFrame:
    """Item sets of ``min_size`` to ``max_size`` items by frequency.

    Up to four items they are counted over bitmaps, level by level, so a basket with very many items makes no pairs. Sets without such a
    bound come from parallel FP-growth.
    """
    if max_size is not None and max_size <= 4:
        return frequent_sets(df, items, support, min_size, max_size)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    growth = FPGrowth(itemsCol=items, minSupport=support, minConfidence=confidence, numPartitions=parts)
    model = growth.fit(df.select(items))
    sizes = F.size("items") >= min_size if max_size is None else F.size("items").between(min_size, max_size)
    return model.freqItemsets.where(sizes).withColumn("items", F.array_sort("items"))


def label_prior(df: DataFrame, labels: str) -> DataFrame:
    """Share of each label over all occurrences, a label counted once per row."""
    counts = count_by(df.select(F.explode(F.array_distinct(labels)).alias("label")), ["label"])
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("label", "n", (F.col("n") / total).alias("share"))


def reduce_frames(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int, value: Column, name: str = "value"
) -> DataFrame:
    """Aggregate over each run of ``n`` consecutive rows (E12); ``value`` is an aggregate such as ``F.max``."""
    placed = group_position(df, by, order, "_pos")
    frame = F.floor((F.col("_pos") - 1) / n).cast("bigint")
    return placed.groupBy(*by, frame.alias("frame")).agg(value.alias(name))
