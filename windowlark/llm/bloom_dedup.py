"""Exact duplicates by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes every text to one 64-bit word of a blocked Bloom filter and three bits of it. The same bits
seen at least twice are *possibly repeated*; only those enter the filter, so its size follows the number
of repeated texts, not the number of rows. Pass 2 tests every row: rows outside the filter are
certainly unique and pass straight through; the rest are grouped by the SHA-256 of their text.
False positives of the filter only cost a shuffled row; there are no false negatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.llm.support import small_enough, whole
from windowlark.session import materialize

#: Characters that do not count when texts are compared.
WHITE = " \t\n\x0b\x0c\r"

FILTER_ROW_BYTES = 16


def squeezed(text: Column | str) -> Column:
    """The text without white space; null counts as empty."""
    out = whole(text)
    for char in WHITE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def word_bits(rows: int, bits_per_row: int) -> int:
    """log2 of the number of 64-bit words that give every row ``bits_per_row`` bits."""
    return max(4, (max(1, rows) * bits_per_row // 64).bit_length())


def _place(h: Column, words_log2: int) -> tuple[Column, Column]:
    """Word number (high bits of the hash) and the three bits in it (from a second hash)."""
    again = F.xxhash64(h, F.lit(1))
    masks = [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(again, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(3)
    ]
    return F.shiftrightunsigned(h, 64 - words_log2), masks[0].bitwiseOR(masks[1]).bitwiseOR(masks[2])


def repeat_filter(hashes: DataFrame, h: str, words_log2: int) -> DataFrame:
    """Bloom filter (word, mask) of the hashes that occur at least twice; rows combine before the shuffle."""
    word, mask = _place(F.col(h), words_log2)
    seen = hashes.select(word.alias("word"), mask.alias("mask")).groupBy("word", "mask").count()
    return seen.where("count > 1").groupBy("word").agg(F.bit_or("mask").alias("seen"))


def bloom_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree without white space. The row with most code points in its original
    text stays, then the one with the smallest id (null ids last); of rows alike in both, one stays.
    Null texts are empty texts and form a group of their own. Other columns are not read. An empty table gives
    an empty result.

    The filter is broadcast only if its measured size is under the bound; else narrow rows (never texts)
    are joined to it by word number. Groups are written before they are joined back, so adaptive execution
    can split a group that holds a large share of all rows.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words_log2 = word_bits(source.count(), bits_per_row)
    repeats = materialize(repeat_filter(source.select(F.xxhash64(squeezed("text")).alias("h")), "h", words_log2))

    plain = squeezed("text")
    rows = source.select(
        "id",
        F.length(whole("text")).alias("points"),
        F.unhex(F.sha2(plain, 256)).alias("sha"),
        F.xxhash64(plain).alias("h"),
    )
    word, mask = _place(F.col("h"), words_log2)
    rows = rows.select("id", "points", "sha", word.alias("word"), mask.alias("mask"))
    sent = F.broadcast(repeats) if small_enough(repeats, FILTER_ROW_BYTES) else repeats
    maybe = F.coalesce(F.col("seen").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    tested = materialize(
        rows.join(sent, "word", "left").select(
            "id", "points", "sha", maybe.alias("maybe"), F.monotonically_increasing_id().alias("row")
        )
    )

    suspects = tested.where("maybe")
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("row").alias("row")))
    groups = materialize(suspects.groupBy("sha").agg(best.alias("best"), F.count("*").alias("group_size")))
    grouped = suspects.join(groups, "sha").select(
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        "sha",
    )
    alone = tested.where("NOT maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return grouped.unionAll(alone).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )
