"""The training-data pipeline: language, recurring lines, near duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of ``documents``; the last
returns token ids. A runner writes each result as Parquet and reads it back as the next stage's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowlark.llm import bpe, entropy_mix, language_svm, line_templates, order_minhash
from windowlark.llm.support import fresh, table, whole
from windowlark.session import materialize

#: Documents whose language is less sure than this go, as do those without any letter and those whose trigrams lie below
#: the floor of every learned language (other languages and scripts, noise).
LEAST_SURE = 0.2
LEAST_FIT = 0.0


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled rows of ``docs``; drop rows without a letter or without a clear language."""
    model = language_svm.fit_languages(docs)
    # prediction columns get names of their own, so that no column of docs is replaced
    judged = language_svm.predict_languages(docs, model, names=("_lang_pred", "_score", "_fit"))
    clear = (F.col("_score") >= LEAST_SURE) & (F.col("_fit") >= LEAST_FIT)
    return judged.where((F.col("_lang_pred") != language_svm.UNDECIDED) & clear).select(*docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; n_chars follows the text; documents of which nothing is left go too."""
    lines, dropped = fresh(docs, "n_lines", "n_dropped")
    cleaned = line_templates.drop_recurring_lines(docs, counts=True, names=(lines, dropped))
    emptied = (F.col(dropped) > 0) & (F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")) == "")
    size = F.when(F.col(dropped) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars")
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).select(*[size if c == "n_chars" else c for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return order_minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: none, one or several rows."""
    mixed = entropy_mix.mix_sources(docs, carry=True)
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to the text, by the digests of both: texts do not travel along."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    named = docs.select("doc_id", "lang", "source", "text", F.sha2(F.encode(whole("text"), "utf-8"), 256).alias("digest"))
    ids = bpe.bpe_encode(named, "text", ranks, public_tokenizers.PATTERN, carry=["doc_id", "lang", "source", "digest"])
    back = bpe.bpe_decode(ids, "ids", ranks)
    same = F.sha2("decoded", 256) == F.col("digest")
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: SQL cannot fit the language model, sketch texts or solve the mix; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
