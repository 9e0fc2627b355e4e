"""Compaction of many small Parquet files without a shuffle of their rows (M8).

Files are packed into bins by their listed sizes; what is exchanged is the list of files. One task copies the files of a bin, batch by
batch, into one file, checks the rows against the footers it read, and reports it. The reports are a table that Spark commits,
and only files in it count: a lost or repeated task writes under another name, which is removed in the end.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowlark.operators.ordered import running_totals
from windowlark.session import materialize

#: Bytes of input for one output file, and rows read at once.
BIN_BYTES, BATCH_ROWS = 256 << 20, 16_384

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_REPORT = "bin long, file string, inputs long, rows long"


def pack_files(spark: SparkSession, source: str, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """(path, length, bin): files of a folder and its subfolders in path order, a new bin after every ``bin_bytes``. A larger file is not cut."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source)
    files = listed.select("path", "length").withColumn("all", F.lit(1))
    summed = running_totals(files, ["all"], ["path"], {"sum": F.col("length")})
    return summed.select("path", "length", F.floor((F.col("sum") - F.col("length")) / bin_bytes).cast("bigint").alias("bin"))


def _folder_values(path: str) -> dict[str, str | None]:
    """Columns that are spelled as ``name=value`` in the folders of a path."""
    pairs = [part.split("=", 1) for part in path.split("/")[:-1] if "=" in part]
    return {k: None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, v in pairs}


def compact_files(spark: SparkSession, source: str, target: str, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """Copy the Parquet files below ``source`` into about as many files in ``target`` as they fill bins; returns the report of the bins.

    Columns of ``name=value`` folders become columns of the files. Columns a file lacks are null in its rows, and numbers are widened to the type
    that Spark reads the folder with. ``target`` must be another folder, empty or new; it is readable as any table afterwards. No files raise.
    """
    arrow = spark.read.option("mergeSchema", "true").parquet(source).limit(0).toArrow().schema
    work = f"{target.rstrip('/')}/part-{uuid.uuid4().hex}"

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = root = None
        open_bin = writer = None
        name, inputs, rows, expected = "", 0, 0, 0

        def report() -> pa.RecordBatch:
            writer.close()
            if rows != expected:
                raise RuntimeError(f"bin {open_bin}: {rows} rows written of {expected}")
            columns = [pa.array([open_bin], pa.int64()), pa.array([name]), pa.array([inputs], pa.int64()), pa.array([rows], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["bin", "file", "inputs", "rows"])

        for batch in batches:
            for number, path in zip(batch.column("bin").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if writer is not None and number != open_bin:
                    yield report()
                    writer = None
                if writer is None:
                    where, root = fs.FileSystem.from_uri(work)
                    where.create_dir(root.rpartition("/")[0], recursive=True)
                    open_bin, inputs, rows, expected = number, 0, 0, 0
                    name = f"{root.rpartition('/')[2]}-{number:06}-{uuid.uuid4().hex[:8]}.parquet"
                    writer = pq.ParquetWriter(f"{root.rpartition('/')[0]}/{name}", arrow, filesystem=where)
                # the listing names files as they are, a URI has its odd characters escaped
                disk, file = fs.FileSystem.from_uri(quote(path, safe="/:="))
                fixed = _folder_values(path)
                with disk.open_input_file(file) as stream:
                    table = pq.ParquetFile(stream)
                    expected, inputs = expected + table.metadata.num_rows, inputs + 1
                    for part in table.iter_batches(BATCH_ROWS):
                        writer.write_batch(_fitted(part, arrow, fixed))
                        rows += part.num_rows
        if writer is not None:
            yield report()

    files = pack_files(spark, source, bin_bytes).repartition("bin").sortWithinPartitions("bin", "path")
    done = materialize(files.select("bin", "path").mapInArrow(copy, _REPORT))
    # what attempts that were not committed have left
    kept = {r["file"] for r in done.select("file").collect()}
    where, root = fs.FileSystem.from_uri(work)
    for info in where.get_file_info(fs.FileSelector(root.rpartition("/")[0])):
        if info.base_name.startswith(root.rpartition("/")[2]) and info.base_name not in kept:
            where.delete_file(info.path)
    return done


def _fitted(batch: pa.RecordBatch, schema: pa.Schema, fixed: dict[str, str | None]) -> pa.RecordBatch:
    columns = []
    for field in schema:
        at = batch.schema.get_field_index(field.name)
        if at >= 0:
            columns.append(batch.column(at).cast(field.type))
        elif fixed.get(field.name) is not None:
            columns.append(pa.array([fixed[field.name]] * batch.num_rows, pa.string()).cast(field.type))
        else:
            columns.append(pa.nulls(batch.num_rows, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)
