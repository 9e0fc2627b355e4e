"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_list(col: Column | str) -> Column:
    """A printed list such as ``['a', 'b']`` to an array of strings."""
    return F.from_json(_c(col), "array<string>", {"allowSingleQuotes": "true"})


def parse_vector(col: Column | str, dtype: str = "float") -> Column:
    """Comma-separated numbers to an array; text that is no number gives a null element."""
    return F.transform(F.split(_c(col), ","), lambda x: F.trim(x).try_cast(dtype))


def track_number(col: Column | str) -> Column:
    """Digits after ``XC``; empty when there are none."""
    return F.regexp_extract(_c(col), r"XC(\d+)", 1)


def part_name(stem: Column | str, part: Column | str, suffix: str = ".wav") -> Column:
    return F.format_string(f"%s_part%03d{suffix}", _c(stem), _c(part).cast("int"))


def source_name(stem: Column | str, source: Column | str, suffix: str = ".mp3") -> Column:
    return F.format_string(f"%s_source%d{suffix}", _c(stem), _c(source).cast("int"))


def split_source(name: Column | str) -> tuple[Column, Column]:
    """(stem, channel) of ``stem_source2.mp3``; a name without a channel is ``original``."""
    base = F.regexp_replace(_c(name), r"\.[^.]*$", "")
    stem = F.regexp_replace(base, r"_source.*$", "")
    channel = F.when(base.contains("source"), F.element_at(F.split(base, "_"), -1))
    return stem, F.coalesce(channel, F.lit("original"))


def track_id(*cols: Column | str) -> Column:
    """Key text with a separator, so that (1, 23) and (12, 3) differ."""
    return F.concat_ws("_", *[_c(c).cast("string") for c in cols])
