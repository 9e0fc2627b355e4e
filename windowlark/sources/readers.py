"""Readers. Every path may be any URI that the session's Hadoop file systems accept."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from windowlark.functions.text import parse_vector

INTERVAL_COLUMNS = {
    "Start (s)": "start_sec",
    "End (s)": "end_sec",
    "Confidence": "confidence",
    "Common name": "common_name",
}


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_glob(spark: SparkSession, pattern: str, any_depth: bool = False) -> DataFrame:
    """Many small Parquet files by glob, or all below a folder whatever their depth."""
    reader = spark.read
    if any_depth:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return reader.parquet(pattern)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column a string."""
    return spark.read.csv(path, header=True)


def read_tsv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=ddl)


def read_records(
    spark: SparkSession, path: str, schema: str | StructType | None = None, lines: bool = False
) -> DataFrame:
    """JSON: an array of objects per file, or (``lines``) one object per line, which can be split."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=not lines)


def from_rows(
    spark: SparkSession, rows: Iterable | pd.DataFrame, schema: str | StructType
) -> DataFrame:
    """Rows, dicts or a pandas frame with an explicit schema."""
    return spark.createDataFrame(rows if isinstance(rows, pd.DataFrame) else list(rows), schema)


def register(df: DataFrame, name: str) -> DataFrame:
    """Make a table visible to ``spark.sql`` text under a name."""
    df.createOrReplaceTempView(name)
    return df


def with_path_columns(
    df: DataFrame, extension: str = ".ogg", name: str = "filename", path: Column | None = None
) -> DataFrame:
    """Add ``parent/stem.ogg``, ``parent`` and ``stem`` (name before its first dot) from the file path."""
    path = F.col("_metadata.file_path") if path is None else path
    parts = F.split(F.url_decode(path), "/")
    parent = F.element_at(parts, -2)
    stem = F.split_part(F.element_at(parts, -1), F.lit("."), F.lit(1))
    return df.select(
        "*",
        F.concat(parent, F.lit("/"), stem, F.lit(extension)).alias(name),
        parent.alias("parent"),
        stem.alias("stem"),
    )


def concat_csv(
    spark: SparkSession, pattern: str, renames: dict[str, str], order: Sequence[str], ddl: str
) -> DataFrame:
    """All CSV files of a glob as one table: renamed columns, fixed order, plus the path columns."""
    df = spark.read.csv(pattern, header=True, schema=ddl)
    return with_path_columns(df).withColumnsRenamed(renames).select(*order)


def build_intervals(spark: SparkSession, pattern: str, taxonomy: DataFrame) -> DataFrame:
    """Detector CSVs to one interval table; unknown common names get the code ``unknown`` (M1).

    ``taxonomy`` has ``PRIMARY_COM_NAME`` and ``SPECIES_CODE``; a name listed twice keeps its last code
    in code order, so the join cannot multiply intervals.
    """
    raw = concat_csv(
        spark,
        pattern,
        INTERVAL_COLUMNS,
        ["start_sec", "end_sec", "confidence", "common_name", "filename"],
        "`Start (s)` DOUBLE, `End (s)` DOUBLE, `Scientific name` STRING, `Common name` STRING, Confidence DOUBLE",
    )
    codes = taxonomy.groupBy(F.col("PRIMARY_COM_NAME").alias("common_name")).agg(
        F.max("SPECIES_CODE").alias("code")
    )
    return raw.join(codes, "common_name", "left").select(
        "start_sec",
        "end_sec",
        "confidence",
        F.coalesce("code", F.lit("unknown")).alias("label"),
        "common_name",
        "filename",
    )


def build_embeddings(spark: SparkSession, pattern: str) -> DataFrame:
    """Header-less embedding text files to one table sorted by file and start (M2)."""
    raw = read_tsv(spark, pattern, "start_sec FLOAT, end_sec FLOAT, emb_text STRING")
    return (
        with_path_columns(raw)
        .select("start_sec", "end_sec", "filename", parse_vector("emb_text").alias("emb"))
        .orderBy("filename", "start_sec")
    )


def read_class_dictionary(spark: SparkSession, labels_path: str, mapping_path: str) -> DataFrame:
    """Text lines indexed by position, mapped to codes through a JSON object; a missing key raises.

    A class dictionary is one small file per model, so each file is one row here.
    """
    text = spark.read.text(labels_path, wholetext=True)
    mapping = spark.read.text(mapping_path, wholetext=True)
    lines = text.select(
        F.posexplode(F.split(F.trim(F.regexp_replace("value", r"\r?\n$", "")), "\r?\n")).alias(
            "index", "label"
        )
    )
    pairs = mapping.select(F.explode(F.from_json("value", "map<string,string>")).alias("label", "code"))
    return attach_codes(lines, pairs)


def attach_codes(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(index, label) with the code of each label from (label, code); a label without code is an error."""
    missing = F.raise_error(F.concat(F.lit("no code for label "), F.col("label")))
    return lines.join(pairs, "label", "left").select(
        F.col("index").cast("bigint").alias("index"),
        "label",
        F.coalesce(F.col("code"), missing.cast("string")).alias("mapped_label"),
    )
