"""Shared views over the base tables, as DataFrames and as the text the SQL checks inline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _whole(x: Column) -> Column:
    return x.cast("bigint")


def vecs(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with a true label and a noisy first guess."""
    noisy = F.when(F.col("vec_id") % 4 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("emb"),
        F.col("label").alias("truth"),
        noisy.alias("guess"),
    )


def clips(spark: SparkSession, folder: str) -> DataFrame:
    """Window table: recording, channel, second, score, energy, vector."""
    v = F.col("vec_id")
    channel = _whole(F.floor(v / 10)) % 3
    kind = F.when(channel == 0, "original").when(channel == 1, "source0").otherwise("source1")
    drift = F.when((v * 31) % 10 < 6, F.col("label")).otherwise((F.col("label") + 3) % 10)
    return table(spark, folder, "embeddings").select(
        "vec_id",
        _whole(F.floor(v / 30)).alias("stem"),
        kind.alias("track_type"),
        (v % 10).alias("start_time"),
        F.col("label").alias("species"),
        drift.alias("prediction"),
        (((v * 7919 + 13) % 1000).cast("double") / 1000).alias("probability"),
        ((v * 104729 + 7) % 997).cast("double").alias("energy"),
        "embedding",
    )


def tags(spark: SparkSession, folder: str) -> DataFrame:
    """Label sets per document."""
    tag = F.concat(F.lit("t"), (F.col("l_partkey") % 20).cast("string"))
    return (
        table(spark, folder, "lineitem")
        .select(F.col("l_orderkey").alias("doc"), tag.alias("tag"))
        .distinct()
    )


def durations(spark: SparkSession, folder: str) -> DataFrame:
    """Track lengths with a path-like name."""
    name = F.concat(F.col("source"), F.lit("/XC"), F.col("doc_id").cast("string"), F.lit(".ogg"))
    return table(spark, folder, "documents").select(
        name.alias("filename"),
        (F.col("n_chars").cast("double") / 10).alias("duration"),
        F.col("lang").alias("species"),
    )


def taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf and group of a three-level tree."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("leaf"), F.col("r_name").alias("grp")
    )


def track_meta(spark: SparkSession, folder: str) -> DataFrame:
    """One metadata row per recording: the label of its first window."""
    return (
        table(spark, folder, "embeddings")
        .groupBy(_whole(F.floor(F.col("vec_id") / 30)).alias("stem"))
        .agg(F.min_by("label", "vec_id").alias("primary_label"))
    )


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Longer recordings: three channels of twenty seconds, text labels, ``no_call`` for some windows."""
    v = F.col("vec_id")
    stem = _whole(F.floor(v / 60))
    kind = F.when(v % 3 == 0, "original").when(v % 3 == 1, "source0").otherwise("source1")
    own, seen = F.concat(F.lit("s"), (stem % 3).cast("string")), F.concat(F.lit("s"), F.col("label").cast("string"))
    called = F.when((v * 31) % 10 < 4, own).when((v * 31) % 10 < 7, seen).otherwise("no_call")
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.concat(F.lit("XC"), stem.cast("string")).alias("stem"),
        kind.alias("track_type"),
        _whole(F.floor((v % 60) / 3)).alias("start_time"),
        own.alias("species"),
        called.alias("prediction"),
        (((v * 7919 + 13) % 1000).cast("double") / 1000).alias("probability"),
        "embedding",
        F.col("embedding").alias("prediction_vec"),
    )


def track_files(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of ``tracks``: file, primary label, secondary labels as a printed list."""
    stem = table(spark, folder, "embeddings").select(_whole(F.floor(F.col("vec_id") / 60)).alias("s")).distinct()
    second = F.format_string("['s%d', 's9']", (F.col("s") + 1) % 3)
    return stem.select(
        F.format_string("a/XC%d.ogg", "s").alias("filename"),
        F.format_string("s%d", F.col("s") % 3).alias("primary_label"),
        F.when(F.col("s") % 2 == 0, second).otherwise("[]").alias("secondary_labels"),
    )


VIEW_SQL = {
    "tracks": """SELECT vec_id, concat('XC', CAST(FLOOR(vec_id / 60) AS BIGINT)) AS stem,
        CASE vec_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'source0' ELSE 'source1' END AS track_type,
        CAST(FLOOR((vec_id % 60) / 3) AS BIGINT) AS start_time, concat('s', CAST(FLOOR(vec_id / 60) AS BIGINT) % 3) AS species,
        CASE WHEN (vec_id * 31) % 10 < 4 THEN concat('s', CAST(FLOOR(vec_id / 60) AS BIGINT) % 3) WHEN (vec_id * 31) % 10 < 7 THEN concat('s', label) ELSE 'no_call' END AS prediction,
        CAST((vec_id * 7919 + 13) % 1000 AS DOUBLE) / 1000 AS probability, embedding, embedding AS prediction_vec FROM embeddings""",
    "track_files": """SELECT concat('a/XC', s, '.ogg') AS filename, concat('s', s % 3) AS primary_label,
        CASE WHEN s % 2 = 0 THEN concat('[''s', (s + 1) % 3, ''', ''s9'']') ELSE '[]' END AS secondary_labels
        FROM (SELECT DISTINCT CAST(FLOOR(vec_id / 60) AS BIGINT) AS s FROM embeddings)""",
    "vecs": """SELECT vec_id AS id, embedding AS emb, label AS truth,
        CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE label END AS guess FROM embeddings""",
    "clips": """SELECT vec_id, CAST(FLOOR(vec_id / 30) AS BIGINT) AS stem,
        CASE CAST(FLOOR(vec_id / 10) AS BIGINT) % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'source0' ELSE 'source1' END AS track_type,
        vec_id % 10 AS start_time, label AS species,
        CASE WHEN (vec_id * 31) % 10 < 6 THEN label ELSE (label + 3) % 10 END AS prediction,
        CAST((vec_id * 7919 + 13) % 1000 AS DOUBLE) / 1000 AS probability,
        CAST((vec_id * 104729 + 7) % 997 AS DOUBLE) AS energy, embedding FROM embeddings""",
    "tags": """SELECT DISTINCT l_orderkey AS doc, concat('t', CAST(l_partkey % 20 AS VARCHAR)) AS tag FROM lineitem""",
    "durations": """SELECT concat(source, '/XC', CAST(doc_id AS VARCHAR), '.ogg') AS filename,
        CAST(n_chars AS DOUBLE) / 10 AS duration, lang AS species FROM documents""",
    "taxonomy": """SELECT n_name AS leaf, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "track_meta": """SELECT DISTINCT CAST(FLOOR(vec_id / 30) AS BIGINT) AS stem,
        first_value(label) OVER (PARTITION BY CAST(FLOOR(vec_id / 30) AS BIGINT) ORDER BY vec_id) AS primary_label FROM embeddings""",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """Prefix a statement with the named views; the body may start with more CTEs after a comma."""
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names.split())
    lead = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    return f"{lead}{ctes}{'' if body.startswith(',') else ' '}{body}"
