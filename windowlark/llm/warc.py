"""WARC archives as a chunked record table.

A payload is never one value once it has left its row: it is cut into rows of (record, chunk number, at most CHUNK
bytes). Writers receive the chunks of a record in order, send them through one gzip member and keep a
running SHA-1; readers inflate in the same steps and return chunk rows, each with the SHA-1 of the payload up to and
including that chunk, so the last one carries the digest of the whole payload.

Archives lie in the shared folder. A task writes files with names of their own, and what it lists in the manifest, a table
Spark commits, is all that readers look at; files of lost or repeated attempts are never listed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowlark.llm.support import small_enough, whole
from windowlark.session import materialize, work_folder

CHUNK = 1 << 20
#: A file is closed past this size and a reader's share of a file is about so large.
FILE_BYTES, SHARE_BYTES = 1 << 30, 32 << 20
#: Most read tasks; with more shares than that a task reads several.
READERS = 20_000
GZIP_LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Row of a repeated payload: digest, its first page and two counts.
REPEAT_ROW_BYTES = 64

_PAGE = "urn:page:"
_END = b"\r\n\r\n"

MANIFEST = "file string, start long, stop long, records long"
CHUNKS = (
    "record string, chunk_no int, offset long, data binary, payload_digest string, last boolean, record_type string, "
    "page_id long, refers_to long, target string, payload_bytes long"
)


def base32_digest(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def chunk_rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """The record table to write: one row per chunk, revisits with one empty chunk.

    Pages with equal payloads: the one with the smallest id is the response, pages with other ids (null ids too, if
    any has an id) are revisits of it. Rows that repeat id and payload are all responses. Rows are numbered where they are
    read, before any shuffle, so that a task that runs again gives its records the same numbers. The table of repeated
    payloads is broadcast only if its measured size is under the bound; else it is joined by digest, where
    adaptive execution splits a hot digest.
    """
    payload = F.encode(whole(payload_col), "utf-8")
    base = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("target"), payload.alias("payload"),
        F.unhex(F.sha1(payload)).alias("digest"),
    )
    firsts = base.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = materialize(firsts.select("digest", "first"))
    sent = F.broadcast(repeats) if small_enough(repeats, REPEAT_ROW_BYTES) else repeats
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = base.join(sent, "digest", "left").select(
        "row", "page_id", "target", "digest",
        F.octet_length("payload").cast("bigint").alias("size"), F.when(again, F.col("first")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    pieces = F.ceil(F.greatest(F.octet_length(F.coalesce("payload", F.lit(b""))), F.lit(1)) / CHUNK).cast("int")
    cut = typed.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), pieces - 1)))
    part = F.substring(F.coalesce("payload", F.lit(b"")), F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))
    return cut.withColumn("data", part).drop("payload")


class _Archive:
    """One file being written, a gzip member per record."""

    def __init__(self, folder: str):
        where, self.path = fs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        where.create_dir(self.path, recursive=True)
        self.out = where.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.shares: list[tuple[int, int, int]] = []
        self.at = self.start = self.records = 0

    def write(self, raw: bytes) -> None:
        if raw:
            self.out.write(raw)
            self.at += len(raw)

    def close_share(self) -> None:
        if self.records:
            self.shares.append((self.start, self.at, self.records))
        self.start, self.records = self.at, 0


class _Record:
    """A record under way: head, chunks, end."""

    def __init__(self, archive: _Archive, row: dict):
        self.archive, self.row = archive, row
        self.zip = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
        self.sha, self.seen = hashlib.sha1(), 0
        revisit = row["refers_to"] is not None
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
        own = row["page_id"] if row["page_id"] is not None else f"null-{row['row']}"
        lines = [
            "WARC/1.1",
            f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{_PAGE}{own}>",
            f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{base32_digest(row['digest'])}",
            f"X-Payload-Length: {row['size']}",
            "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(http) + (0 if revisit else row['size'])}",
        ]
        if row["target"]:
            lines.insert(4, "WARC-Target-URI: " + " ".join(row["target"].split()))
        if revisit:
            lines.insert(4, f"WARC-Refers-To: <{_PAGE}{row['refers_to']}>")
            lines.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        archive.write(self.zip.compress("\r\n".join(lines).encode() + _END + http))

    def add(self, data: bytes) -> None:
        self.sha.update(data)
        self.seen += len(data)
        self.archive.write(self.zip.compress(data))

    def end(self) -> None:
        if self.row["refers_to"] is None and (self.seen != self.row["size"] or self.sha.digest() != self.row["digest"]):
            raise ValueError(f"chunks of record {self.row['page_id']} do not make up its payload")
        self.archive.write(self.zip.compress(_END) + self.zip.flush())
        self.archive.records += 1
        if self.archive.at - self.archive.start >= SHARE_BYTES:
            self.archive.close_share()


def write_archives(chunks: DataFrame, folder: str, archives: int) -> DataFrame:
    """Write the chunk table as ``archives`` or more files; returns the written manifest of shares of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = record = None

        def listed(done: _Archive) -> pa.RecordBatch:
            done.close_share()
            done.out.close()
            rows = [(f"{folder}/{done.name}", *share) for share in done.shares]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                ["file", "start", "stop", "records"],
            )

        for batch in batches:
            names = [n for n in batch.schema.names if n != "data"]
            data = batch.column("data")
            for i, row in enumerate(batch.select(names).to_pylist()):
                if row["chunk_no"] == 0:
                    if record:
                        record.end()
                    if archive and archive.at >= FILE_BYTES:
                        yield listed(archive)
                        archive = None
                    archive = archive or _Archive(folder)
                    record = _Record(archive, row)
                record.add(data[i].as_py())
        if record:
            record.end()
            yield listed(archive)

    ordered = chunks.repartition(archives, "row").sortWithinPartitions("row", "chunk_no")
    return materialize(ordered.mapInArrow(run, MANIFEST))


class _Inflater:
    """Reads a share of a file member by member, in bounded steps."""

    def __init__(self, source, stop: int):
        self.source, self.left = source, stop
        self.raw, self.plain = b"", b""
        self.zip = zlib.decompressobj(31)

    def more(self) -> bool:
        """Inflate a little more into ``plain``; false at the end of the share."""
        if not self.raw:
            self.raw = self.source.read(min(CHUNK // 4, self.left))
            self.left -= len(self.raw)
        if not self.raw:
            # all is read; what the inflater still holds back comes out without new input
            held = b"" if self.zip.eof else self.zip.decompress(b"", CHUNK)
            self.plain += held
            return bool(held)
        if self.zip.eof:
            self.zip = zlib.decompressobj(31)
        self.plain += self.zip.decompress(self.raw, CHUNK)
        self.raw = self.zip.unconsumed_tail or self.zip.unused_data
        return True

    def head(self) -> dict[str, str] | None:
        while _END not in self.plain:
            if not self.more():
                if self.plain:
                    raise ValueError("a record is cut short")
                return None
        head, self.plain = self.plain.split(_END, 1)
        lines = head.decode("utf-8").split("\r\n")
        return {"": lines[0], **dict(line.split(": ", 1) for line in lines[1:])}

    def take(self, size: int) -> bytes:
        while len(self.plain) < size:
            if not self.more():
                raise ValueError("a record is cut short")
        out, self.plain = self.plain[:size], self.plain[size:]
        return out


def _records(source, stop: int) -> Iterator[tuple]:
    share = _Inflater(source, stop)
    while (head := share.head()) is not None:
        if not head[""].startswith("WARC/"):
            raise ValueError("not a WARC record")
        length = int(head["Content-Length"])
        http = share.head()  # the HTTP head of the block; its lines and the blank line count into the length
        size = int(http["Content-Length"]) if head["WARC-Type"] == "response" else 0
        http_size = sum(len(f"{k}: {v}".encode()) + 2 for k, v in http.items() if k) + len(http[""].encode()) + 2 + 2
        if http_size + size != length:
            raise ValueError("block length does not match its head")
        name = head["WARC-Record-ID"].strip("<>")
        page = name.removeprefix(_PAGE)
        refers = head.get("WARC-Refers-To", "").strip("<>").removeprefix(_PAGE)
        named = (
            head["WARC-Type"], int(page) if not page.startswith("null-") else None, int(refers) if refers else None,
            head.get("WARC-Target-URI"), int(head["X-Payload-Length"]),
        )
        told = head["WARC-Payload-Digest"].removeprefix("sha1:")
        sha, offset, number = hashlib.sha1(), 0, 0
        while True:
            data = share.take(min(CHUNK, size - offset))
            sha.update(data)
            last = offset + len(data) == size
            digest = base32_digest(sha.copy().digest()) if head["WARC-Type"] == "response" else told
            if last and digest != told:
                raise ValueError(f"payload digest of {name} does not match")
            yield (name, number, offset, data, digest, last, *named)
            offset, number = offset + len(data), number + 1
            if last:
                break
        if share.take(4) != _END:
            raise ValueError("a record does not end where its length says")


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The chunk table of all listed archives; ``payload`` false leaves data null but still digests it.

    There is a task per share (up to READERS), whatever the size of the manifest. A batch holds at most about eight chunks,
    however long the records. Damaged records and payloads that do
    not match their digest raise an error.
    """
    schema = manifest.sparkSession.createDataFrame([], CHUNKS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        names = [f.name for f in schema.fields]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for share in batch.to_pylist():
                where, path = fs.FileSystem.from_uri(share["file"])
                with where.open_input_file(path) as source:
                    source.seek(share["start"])
                    rows, held = [], 0
                    for row in _records(source, share["stop"] - share["start"]):
                        held += len(row[3]) if payload else 0
                        rows.append(row if payload else (*row[:3], None, *row[4:]))
                        if held >= 8 * CHUNK or len(rows) >= 5000:
                            yield table(rows)
                            rows, held = [], 0
                    if rows:
                        yield table(rows)

    # a stated number is kept by adaptive execution, which would merge the few bytes of a manifest into one task
    readers = min(max(manifest.count(), 1), READERS)
    return manifest.select("file", "start", "stop").repartitionByRange(readers, "file", "start").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per page to the shared folder and return the manifest.

    Null payloads are empty. Null ids get a record name of their own; null urls no target. There are as many files as
    shuffle partitions, or more where they would pass FILE_BYTES. Extra columns are not read.
    """
    spark = pages.sparkSession
    folder = work_folder(spark).rstrip("/")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    chunks = chunk_rows(pages, id_col, url_col, payload_col)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return write_archives(chunks, f"{folder}/windowlark-warc/{uuid.uuid4().hex}", files)
