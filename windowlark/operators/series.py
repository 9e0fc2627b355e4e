"""Windows over series that are longer than a row: chunk rows in, windows across chunk borders out (I1, I2 in long form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowlark.operators.ordered import join_back


def chunk_arrays(df: DataFrame, series: str, keep: Sequence[str], chunk: int) -> DataFrame:
    """(keep, at, samples): consecutive stretches of an array column; ``at`` is the position of the first sample."""
    starts = F.when(F.size(series) > 0, F.sequence(F.lit(0), F.size(series) - 1, F.lit(chunk)))
    rows = df.select(*keep, series, F.explode(starts).alias("at"))
    return rows.select(*keep, F.col("at").cast("bigint").alias("at"), F.slice(F.col(series), F.col("at") + 1, F.lit(chunk)).alias("samples"))


def chunk_samples(df: DataFrame, keep: Sequence[str], position: str, value: str, chunk: int) -> DataFrame:
    """The same from a row per sample. A group is one chunk, so a long recording is many groups; missing samples are zeros."""
    block = F.floor(F.col(position) / chunk).cast("bigint").alias("_block")
    spot = F.struct(F.pmod(F.col(position), F.lit(chunk)).cast("int").alias("place"), F.col(value).cast("double").alias("x"))
    rows = df.where(F.col(position) >= 0).groupBy(*keep, block).agg(F.array_sort(F.collect_list(spot)).alias("s"))
    filled = F.aggregate(
        "s", F.array().cast("array<double>"),
        lambda acc, s: F.concat(acc, F.array_repeat(F.lit(0.0), s["place"] - F.size(acc)), F.array(F.coalesce(s["x"], F.lit(0.0)))),
    )
    return rows.select(*keep, (F.col("_block") * chunk).alias("at"), filled.alias("samples"))


def slice_windows_long(
    chunks: DataFrame, keep: Sequence[str], rate: int, seconds: float = 3, pad: float = 0, step: float | None = None, at: str = "at", samples: str = "samples"
) -> DataFrame:
    """``slice_windows`` for a recording in chunk rows of any lengths: the same columns, windows and padding.

    ``keep`` identifies a recording, null keys included. A window that lies in one chunk is cut there without a shuffle of samples; of one that
    crosses chunks, each chunk sends its piece, and a group is one window. So no task sees a recording, however long it
    is. Stretches without a chunk read as zeros, chunks must not overlap, and a chunk without samples is none.
    """
    size = int(rate * seconds) + int(rate * pad)
    hop = size if step is None else int(rate * step)
    rows = chunks.where(F.size(samples) > 0).select(*keep, F.col(at).cast("bigint").alias("_at"), F.col(samples).cast("array<double>").alias("_x"))
    stop = F.col("_at") + F.size("_x")
    ends = rows.groupBy(*keep).agg(F.max(stop).alias("_n"))
    padded = F.ceil(F.col("_n") / hop) * hop
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / hop)).cast("bigint")
    last = F.least(F.floor((stop - 1) / hop), F.floor((padded - size) / hop)).cast("bigint")
    told = join_back(rows, ends, keep).withColumns({"_first": first, "_last": last}).where("_last >= _first")
    cut = told.select(*keep, "_at", "_x", "_n", F.explode(F.sequence("_first", "_last")).alias("index"))
    begin = F.greatest(F.col("index") * hop, "_at")
    end = F.least(F.col("index") * hop + size, stop)
    # a stretch between samples of a chunk and the next window has no piece
    pieces = cut.withColumns({"_b": begin, "_e": end}).where("_e > _b").select(
        *keep, "index", (F.col("_b") - F.col("index") * hop).cast("int").alias("_pos"),
        F.slice("_x", (F.col("_b") - F.col("_at") + 1).cast("int"), (F.col("_e") - F.col("_b")).cast("int")).alias("_piece"),
        ((F.col("_b") == F.col("index") * hop) & (F.col("_e") == F.least(F.col("index") * hop + size, F.col("_n")))).alias("_whole"),
    )
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    whole = pieces.where("_whole").select(*keep, "index", F.col("_piece").alias("_w"))
    parts = pieces.where("not _whole").groupBy(*keep, "index").agg(F.array_sort(F.collect_list(F.struct("_pos", "_piece"))).alias("_p"))
    joined = F.aggregate("_p", F.array().cast("array<double>"), lambda acc, p: F.concat(acc, zeros(p["_pos"] - F.size(acc)), p["_piece"]))
    windows = whole.unionByName(parts.select(*keep, "index", joined.alias("_w")))
    return windows.select(
        *keep, "index", (F.col("index") * hop / rate).alias("start"), (F.col("index") * float(seconds)).alias("ref_time"),
        F.concat("_w", zeros(F.lit(size) - F.size("_w"))).alias("window"),
    )
