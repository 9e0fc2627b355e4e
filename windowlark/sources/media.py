"""Inventory of WAV and Ogg files: size and duration from headers read by offset, without decoding or reading the samples."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowlark.sources.readers import with_path_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def wav_seconds(source, length: int) -> float | None:
    """Data bytes by bytes per second, from ``read_at(size, offset)`` of chunk heads only; null if not a PCM WAV.

    Chunks are walked by their sizes (odd ones are padded), so neither their number nor their length matters.
    """
    head = source.read_at(12, 0)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, rate = 12, None
    while at + 8 <= length:
        name = source.read_at(8, at)
        size = int.from_bytes(name[4:8], "little")
        if name[:4] == b"fmt " and size >= 12:
            rate = int.from_bytes(source.read_at(4, at + 16), "little")
        elif name[:4] == b"data":
            return size / rate if rate else None
        at += 8 + size + size % 2
    return None


#: Fixed values of the Ogg format: flags of a page, the largest page (27 + 255 + 255 * 255 bytes), the polynomial of its checksum.
_FIRST = 2
_PAGE_MOST = 65_307
_POLYNOMIAL = 0x04C11DB7


def _checksums() -> list[int]:
    out = []
    for byte in range(256):
        r = byte << 24
        for _ in range(8):
            r = (r << 1 ^ _POLYNOMIAL if r & 1 << 31 else r << 1) & 0xFFFFFFFF
        out.append(r)
    return out


_CHECKSUM = _checksums()


@dataclass
class _Page:
    flags: int
    granule: int
    serial: int
    body: bytes
    size: int


def _page(raw: bytes, at: int, check: bool = True) -> _Page | None:
    """The whole, undamaged page at an offset of a buffer, or null."""
    if raw[at : at + 4] != b"OggS" or len(raw) < at + 27 or raw[at + 4] != 0:
        return None
    lacing = raw[at + 27 : at + 27 + raw[at + 26]]
    size = 27 + raw[at + 26] + sum(lacing)
    page = raw[at : at + size]
    if len(lacing) < raw[at + 26] or len(page) < size:
        return None
    if check:
        r = 0
        for byte in page[:22] + bytes(4) + page[26:]:
            r = (r << 8 & 0xFFFFFFFF) ^ _CHECKSUM[r >> 24 ^ byte]
        if r != int.from_bytes(page[22:26], "little"):
            return None
    granule, serial = int.from_bytes(page[6:14], "little", signed=True), int.from_bytes(page[14:18], "little")
    return _Page(page[5], granule, serial, page[27 + raw[at + 26] :], size)


def _clock(body: bytes) -> tuple[int, int] | None:
    """Granules a second, and granules to leave out at the start, of an audio stream's first packet; else null."""
    if body[:7] == b"\x01vorbis" and len(body) >= 16:
        found = int.from_bytes(body[12:16], "little"), 0
    elif body[:8] == b"OpusHead" and len(body) >= 12:
        found = 48_000, int.from_bytes(body[10:12], "little")
    elif body[:5] == b"\x7fFLAC" and len(body) >= 30:
        found = int.from_bytes(body[27:30], "big") >> 4, 0
    elif body[:8] == b"Speex   " and len(body) >= 40:
        found = int.from_bytes(body[36:40], "little"), 0
    else:
        return None
    return found if found[0] else None


def ogg_seconds(source, length: int) -> float | None:
    """Seconds of the audio in an Ogg file from ``read_at(size, offset)``; null if it is none or damaged at its start.

    The first pages name the streams, among them the first audio stream with its rate; its last page holds the last granule position,
    and is found from the end: a page is at most 64 KB, so two such reads reach it. If another stream ends the
    file, several were chained and the pages are walked by their headers. A file that is cut short lasts to its last whole page.
    """
    at, clock, serial = 0, None, None
    while at < length:
        page = _page(source.read_at(min(_PAGE_MOST, length - at), at), 0)
        if page is None or not page.flags & _FIRST:
            break
        if clock is None and (clock := _clock(page.body)):
            serial = page.serial
        at += page.size
    if clock is None:
        return None
    end = length
    for _ in range(4):
        start = max(0, end - _PAGE_MOST)
        # pages that begin in this stretch may reach beyond it
        tail = source.read_at(min(length, end + _PAGE_MOST) - start, start)
        here = end - start
        while (here := tail.rfind(b"OggS", 0, here + 3 if here < end - start else end - start)) >= 0:
            page = _page(tail, here)
            if page and page.granule >= 0:
                return _lasting(page.granule, clock) if page.serial == serial else _walked(source, length)
        end = start
        if not start:
            break
    return _walked(source, length)


def _lasting(granule: int, clock: tuple[int, int]) -> float:
    return max(0, granule - clock[1]) / clock[0]


def _walked(source, length: int) -> float | None:
    """Sum over chained audio streams, from page headers and the first packets; a damaged page ends the walk."""
    at, clocks, last = 0, {}, {}
    chain = 0
    before = _FIRST
    while at + 27 <= length:
        head = source.read_at(min(27 + 255, length - at), at)
        lacing = head[27 : 27 + head[26]]
        size = 27 + head[26] + sum(lacing)
        if head[:4] != b"OggS" or at + size > length:
            break
        flags, granule, serial = head[5], int.from_bytes(head[6:14], "little", signed=True), int.from_bytes(head[14:18], "little")
        if flags & _FIRST:
            # first pages stand together: one after other pages begins the next chain
            chain += not before & _FIRST
            clock = _clock(source.read_at(min(64, sum(lacing)), at + 27 + head[26]))
            if clock and not any(c == chain for c, _ in clocks):
                clocks[chain, serial] = clock
        elif granule >= 0:
            last[chain, serial] = granule
        before, at = flags, at + size
    ended = [_lasting(last[k], c) for k, c in clocks.items() if k in last]
    return sum(ended) if ended else None


def seconds(source, length: int) -> float | None:
    """By what the file holds, not by its name."""
    return ogg_seconds(source, length) if source.read_at(min(4, length), 0) == b"OggS" else wav_seconds(source, length)


def _durations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            where, name = fs.FileSystem.from_uri(quote(path, safe="/:="))
            with where.open_input_file(name) as source:
                found.append(seconds(source, length))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "duration"])


def media_inventory(spark: SparkSession, pattern: str, extension: str = ".wav") -> DataFrame:
    """One row per WAV or Ogg file: name, KB, seconds. No match raises; a file that is neither has null seconds.

    Only path and length are listed by Spark, which prunes the content; tasks read a few bytes per chunk, or a few pages. The
    names end in ``extension``.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    timed = files.mapInArrow(_durations, "path string, length long, duration double")
    return with_path_columns(timed, extension, path=F.col("path")).select(
        "filename", F.col("parent").alias("species"), (F.col("length") / 1024).alias("size_kb"), "duration"
    )


def inventory_summary(inventory: DataFrame) -> DataFrame:
    """Count, mean size and the set of distinct durations (A10)."""
    return inventory.agg(
        F.count("*").alias("n"),
        F.avg("size_kb").alias("mean_kb"),
        F.sum("duration").alias("total_sec"),
        F.count_distinct("duration").alias("n_durations"),
    )
