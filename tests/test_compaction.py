"""Compacted files hold the rows of the small ones."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from windowlark.sources import compaction


def content(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_rows_files_and_columns(spark, tmp_path):
    df = spark.range(3000).select(
        "id", (F.col("id") % 7).cast("int").alias("track"), F.array(F.col("id") * 0.5).alias("v"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("a b="), "id")).alias("s"),
        F.timestamp_seconds("id").alias("at"), F.struct(F.col("id").alias("n")).alias("o"),
    )
    df.withColumn("kind", F.when(F.col("id") % 3 > 0, F.concat(F.lit("k/ "), F.col("id") % 2))).repartition(5).write.partitionBy("track", "kind").parquet(f"{tmp_path}/small")
    small = spark.read.parquet(f"{tmp_path}/small")
    files = compaction.pack_files(spark, f"{tmp_path}/small", 100_000)
    sizes = {r["bin"]: r["n"] for r in files.groupBy("bin").agg(F.sum("length").alias("n")).collect()}
    assert len(sizes) > 2 and max(sizes.values()) < 110_000
    report = compaction.compact_files(spark, f"{tmp_path}/small", f"{tmp_path}/big", 100_000)
    assert report.agg(F.sum("rows"), F.sum("inputs"), F.count("*")).first() == (3000, files.count(), len(sizes))
    assert {p.name for p in Path(f"{tmp_path}/big").iterdir()} == {r["file"] for r in report.collect()}
    big = spark.read.parquet(f"{tmp_path}/big")
    assert content(big) == content(small) and dict(big.dtypes) == dict(small.dtypes)


def test_files_of_other_schemas_and_leftovers(spark, tmp_path):
    spark.range(5).withColumn("x", F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.range(5, 8).withColumn("y", F.lit("new")).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    spark.range(0).write.parquet(f"{tmp_path}/in/c")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "other.txt").write_text("stays")
    # folders without names of columns are read one by one, as their files are
    paths = [str(p) for p in (tmp_path / "in").rglob("*.parquet")]
    one = tmp_path / "flat"
    one.mkdir()
    for i, p in enumerate(paths):
        (one / f"{i}.parquet").write_bytes(Path(p).read_bytes())
    report = compaction.compact_files(spark, str(one), f"{tmp_path}/out")
    assert [tuple(r)[2:] for r in report.collect()] == [(len(paths), 8)]
    back = spark.read.option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/out")
    assert {(r["id"], r["x"], r["y"]) for r in back.collect()} == {*[(i, 1, None) for i in range(5)], *[(i, None, "new") for i in range(5, 8)]}
    assert (tmp_path / "out" / "other.txt").exists()


def test_nothing_to_compact(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):
        compaction.compact_files(spark, f"{tmp_path}/none", f"{tmp_path}/out")
