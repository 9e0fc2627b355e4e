"""Durations of Ogg files from hand-made pages."""

import random
import struct

import pyarrow as pa
import pytest

from windowlark.sources import media


def page(body, granule, flags=0, serial=1, number=0):
    lacing = bytes([255] * (len(body) // 255) + [len(body) % 255])
    head = b"OggS" + struct.pack("<BBqIII", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    r = 0
    for byte in head + body:
        r ^= byte << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 1 << 31 else r << 1) & 0xFFFFFFFF
    return head[:22] + struct.pack("<I", r) + head[26:] + body


VORBIS = b"\x01vorbis" + struct.pack("<IBIIIIBB", 0, 1, 32000, 0, 96000, 0, 0xB8, 1)
OPUS = b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 312, 16000, 0, 0)
FLAC = b"\x7fFLAC\x01\x00\x00\x01fLaC\x00\x00\x00\x22" + b"\x10\x00" * 2 + bytes(6) + (44100 << 4).to_bytes(3, "big") + bytes(21)
SPEEX = b"Speex   " + bytes(28) + struct.pack("<I", 8000) + bytes(40)


def stream(head=VORBIS, granules=(1000, 96000), serial=1, size=500):
    rng = random.Random(serial)
    pages = [page(head, 0, 2, serial)]
    return b"".join([*pages, *[page(rng.randbytes(size), g, 0, serial, i + 1) for i, g in enumerate(granules)]])


class Source:
    """Counts what is read."""

    def __init__(self, raw):
        self.file, self.read = pa.BufferReader(raw), 0

    def read_at(self, size, offset):
        self.read += size
        return self.file.read_at(size, offset)


def seconds(raw):
    return media.seconds(Source(raw), len(raw))


@pytest.mark.parametrize(
    ("head", "last", "want"), [(VORBIS, 96000, 3.0), (OPUS, 48312, 1.0), (FLAC, 88200, 2.0), (SPEEX, 4000, 0.5)]
)
def test_codecs(head, last, want):
    assert seconds(stream(head, (10, last))) == want


def test_reads_are_bounded():
    big = stream(granules=range(100, 32000 * 60, 32000), size=65_000)
    source = Source(big)
    assert media.ogg_seconds(source, len(big)) == (32000 * 59 + 100) / 32000 and source.read < 5 * 65_307 < len(big)


def test_last_pages_that_do_not_count():
    # no packet ends on the last page; a page name inside samples; samples that look like a page
    whole = stream(granules=(1000, 64000))
    assert seconds(whole + page(b"x" * 300, -1)) == 2.0
    fake = page(b"y" * 50, 999_999)[:-1] + b"z"
    assert seconds(whole + page(b"OggS\0" + fake, 96000)) == 3.0
    assert seconds(whole + b"OggS" + bytes(40)) == 2.0


def test_cut_and_damaged_files():
    whole = stream(granules=(32000, 64000, 96000), size=3000)
    assert seconds(whole[:-100]) == 2.0
    assert seconds(whole + bytes(200_000)) == 3.0
    assert seconds(b"OggS" + bytes(100)) is None and seconds(b"") is None and seconds(whole[:20]) is None
    assert seconds(page(b"\x80theora" + bytes(40), 0, 2) + page(b"q", 5)) is None
    broken = bytearray(whole)
    broken[40] ^= 1
    assert seconds(bytes(broken)) is None
    assert seconds(page(VORBIS, 0, 2)) == 0.0


def test_chained_and_multiplexed_streams():
    assert seconds(stream(granules=(32000,)) + stream(OPUS, (96312,), serial=2)) == 3.0
    first = page(b"\x80theora" + bytes(40), 0, 2, 9) + page(VORBIS, 0, 2, 1)
    assert seconds(first + page(b"v", 7, 0, 9) + page(b"a" * 90, 64000, 4, 1) + page(b"v", 9, 4, 9)) == 2.0


def test_inventory(spark, tmp_path):
    for species in ("foo", "bar", "baz"):
        (tmp_path / species).mkdir()
        for i, s in enumerate((15, 2)):
            (tmp_path / species / f"XC{i}.ogg").write_bytes(stream(granules=(10, 32000 * s)))
    (tmp_path / "foo" / "a b#1.ogg").write_bytes(stream(granules=(10, 32000)))
    (tmp_path / "foo" / "none.ogg").write_bytes(b"text")
    inventory = media.media_inventory(spark, f"{tmp_path}/*/*.ogg", ".ogg")
    rows = {r.filename: r.duration for r in inventory.collect()}
    assert rows["bar/XC0.ogg"] == 15.0 and rows["foo/none.ogg"] is None and len(rows) == 8 and rows["foo/a b#1.ogg"] == 1.0
    assert media.inventory_summary(inventory).first().total_sec == 52.0
