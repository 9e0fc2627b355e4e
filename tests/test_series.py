"""Windows over chunk rows against the array form."""

import pytest
from pyspark.sql import functions as F

from windowlark.operators import series
from windowlark.operators.frames import slice_windows

CASES = [
    (16, 1, 5, 0, None), (16, 1, 4, 0, 2), (10, 1, 1.0, 0, None), (23, 2, 3, 0.5, 1), (7, 1, 9, 0, 2), (31, 1, 3, 0, 10),
]


def rows(table):
    return sorted((r["key"] is None, r["key"] or 0, r["index"], r["start"], r["ref_time"], tuple(r["window"])) for r in table.collect())


@pytest.mark.parametrize(("length", "rate", "seconds", "pad", "step"), CASES)
@pytest.mark.parametrize("chunk", [1, 4, 100])
def test_equal_to_the_array_form(spark, length, rate, seconds, pad, step, chunk):
    data = [(k, [float(k or 0) + i for i in range(length + extra)]) for k, extra in ((1, 0), (2, 3), (None, 5))] + [(4, []), (5, None)]
    df = spark.createDataFrame(data, "key int, x array<double>")
    want = rows(slice_windows(df, "x", rate, ["key"], seconds, pad, step))
    chunks = series.chunk_arrays(df, "x", ["key"], chunk).withColumn("window", F.lit("clash"))
    assert rows(series.slice_windows_long(chunks, ["key"], rate, seconds, pad, step)) == want
    long = df.select("key", F.posexplode("x").alias("pos", "v"))
    assert rows(series.slice_windows_long(series.chunk_samples(long, ["key"], "pos", "v", chunk), ["key"], rate, seconds, pad, step)) == want


def test_uneven_chunks_and_gaps(spark):
    data = [(1, 0, [1.0, 2.0, 3.0]), (1, 3, [4.0]), (1, 6, [7.0, 8.0]), (1, 8, []), (1, 9, None)]
    chunks = spark.createDataFrame(data, "key int, at int, samples array<double>")
    got = {r["index"]: r["window"] for r in series.slice_windows_long(chunks, ["key"], 1, 5).collect()}
    assert got == {0: [1.0, 2.0, 3.0, 4.0, 0.0], 1: [0.0, 7.0, 8.0, 0.0, 0.0]}
    assert series.slice_windows_long(chunks.limit(0), ["key"], 1, 5).collect() == []


def test_long_recording_is_spread(spark, many_parts):
    n = 200_000
    samples = spark.range(n, numPartitions=8).select(F.lit(1).alias("key"), F.col("id").alias("pos"), (F.col("id") % 97).alias("v"))
    chunks = series.chunk_samples(samples, ["key"], "pos", "v", 1000)
    cut = series.slice_windows_long(chunks, ["key"], 100, 25.0, step=10.0)
    spread = cut.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in spread) == (n - 2500) // 1000 + 1 and len(spread) > 4
    assert cut.where(F.expr("aggregate(window, 0D, (a, x) -> a + x) != aggregate(sequence(index * 1000, index * 1000 + 2499), 0D, (a, i) -> a + i % 97)")).count() == 0
