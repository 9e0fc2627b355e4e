"""Sources and sinks: a table is written in a format, read back by the reader, and must be the table (A, M1, M2, M8)."""

import uuid

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.plans import views as v
from windowlark.session import work_folder
from windowlark.sources import compaction, readers, writers


def _fresh(spark) -> str:
    """A new path below the shared folder."""
    return f"{work_folder(spark).rstrip('/')}/windowlark/{uuid.uuid4().hex}"


_CUSTOMER = ["c_custkey", "c_name", "c_mktsegment"]
_TEXT = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer"


@query("sink_parquet", "SELECT c_custkey, c_name, c_mktsegment, CAST(3 AS BIGINT) AS files FROM customer")
def _(spark, folder):
    path = _fresh(spark)
    writers.write_table(v.table(spark, folder, "customer").select(*_CUSTOMER), path, partitions=3, compression="gzip")
    back = readers.read_table(spark, path, _CUSTOMER).withColumn("file", F.input_file_name())
    return back.select(*_CUSTOMER, back.agg(F.count_distinct("file")).scalar().alias("files"))


@query("sink_single", "SELECT c_custkey, c_name, c_mktsegment, CAST(1 AS BIGINT) AS files FROM customer")
def _(spark, folder):
    path = _fresh(spark)
    writers.write_single(v.table(spark, folder, "customer").select(*_CUSTOMER), path)
    back = readers.read_table(spark, path).withColumn("file", F.input_file_name())
    return back.select(*_CUSTOMER, back.agg(F.count_distinct("file")).scalar().alias("files"))


@query("glob_depth", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, folder):
    path, orders = _fresh(spark), v.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    orders.where("o_orderkey % 3 = 0").write.parquet(f"{path}/a/x")
    orders.where("o_orderkey % 3 = 1").write.parquet(f"{path}/a/y/z")
    orders.where("o_orderkey % 3 = 2").write.parquet(f"{path}/b/x")
    return readers.read_glob(spark, path, any_depth=True)


@query("glob_pattern", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, folder):
    path, orders = _fresh(spark), v.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    orders.where("o_orderkey % 2 = 0").write.parquet(f"{path}/a/x")
    orders.where("o_orderkey % 2 = 1").write.parquet(f"{path}/b/x")
    return readers.read_glob(spark, f"{path}/*/*/*.parquet")


@query("csv_strings", _TEXT)
def _(spark, folder):
    path = _fresh(spark)
    writers.write_csv(v.table(spark, folder, "customer").select(*_CUSTOMER), path)
    return readers.read_csv(spark, path)


@query("tsv_schema", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, folder):
    path = _fresh(spark)
    v.table(spark, folder, "customer").select(*_CUSTOMER).write.csv(path, sep="\t")
    return readers.read_tsv(spark, path, "c_custkey BIGINT, c_name STRING, c_mktsegment STRING")


@query("json_records", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, folder):
    path = _fresh(spark)
    writers.write_records(v.table(spark, folder, "customer").select(*_CUSTOMER), path)
    return readers.read_records(spark, path, "c_custkey BIGINT, c_name STRING, c_mktsegment STRING", lines=True)


@query("json_array", "SELECT r_regionkey, r_name FROM region")
def _(spark, folder):
    """One file that is an array of objects."""
    path, region = _fresh(spark), v.table(spark, folder, "region").select("r_regionkey", "r_name")
    region.agg(F.to_json(F.collect_list(F.struct("*")))).write.text(path)
    return readers.read_records(spark, path, region.schema)


@query("rows_to_table", "SELECT r_regionkey, r_name FROM region")
def _(spark, folder):
    region = v.table(spark, folder, "region").select("r_regionkey", "r_name")
    return readers.from_rows(spark, region.toPandas(), region.schema)


@query(
    "detector_intervals",
    """SELECT CAST(vec_id AS DOUBLE) AS start_sec, CAST(vec_id + 3 AS DOUBLE) AS end_sec, (vec_id % 100) / 100.0::DOUBLE AS confidence,
              CASE WHEN label < 8 THEN concat('code', label) ELSE 'unknown' END AS label, concat('Bird ', label) AS common_name, 'tracks' AS parent
       FROM embeddings""",
)
def _(spark, folder):
    """Detector CSVs of all windows, codes for eight of ten names; a file stands for a recording."""
    path, e = _fresh(spark), v.table(spark, folder, "embeddings")
    writers.write_csv(
        e.select(
            F.col("vec_id").cast("double").alias("Start (s)"), (F.col("vec_id") + 3).cast("double").alias("End (s)"),
            F.lit("X y").alias("Scientific name"), F.concat(F.lit("Bird "), "label").alias("Common name"),
            (F.col("vec_id") % 100 / 100).alias("Confidence"),
        ),
        f"{path}/tracks",
    )
    names = e.where("label < 8").select(F.concat(F.lit("Bird "), "label").alias("PRIMARY_COM_NAME"), F.concat(F.lit("code"), "label").alias("SPECIES_CODE"))
    out = readers.build_intervals(spark, f"{path}/tracks/*.csv", names.distinct())
    return out.withColumn("parent", F.split("filename", "/")[0]).drop("filename")


@query(
    "embedding_texts",
    """SELECT CAST(vec_id AS FLOAT) AS start_sec, CAST(vec_id + 3 AS FLOAT) AS end_sec, CAST(i AS INTEGER) AS pos, round(CAST(embedding[i + 1] AS DOUBLE), 4) + 0.0 AS x
       FROM embeddings, range(0, 64) t(i)""",
)
def _(spark, folder):
    path, e = _fresh(spark), v.table(spark, folder, "embeddings")
    text = F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")
    e.select(F.col("vec_id").cast("float"), (F.col("vec_id") + 3).cast("float"), text.alias("t")).write.csv(f"{path}/tracks", sep="\t")
    out = readers.build_embeddings(spark, f"{path}/tracks/*.csv")
    return out.select("start_sec", "end_sec", F.posexplode("emb").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4) + 0.0)


@query("compact_tracks", "SELECT CAST(count(DISTINCT label) AS BIGINT) AS tracks, count(*) AS n, CAST(2 AS BIGINT) AS files FROM embeddings")
def _(spark, folder):
    """Many small outputs, one per track, compacted into two files without losing a track (M8)."""
    path, e = _fresh(spark), v.table(spark, folder, "embeddings").select("vec_id", "label")
    e.write.partitionBy("label").parquet(f"{path}/tracks")
    writers.write_table(readers.read_table(spark, f"{path}/tracks"), f"{path}/compact", partitions=2)
    back = readers.read_table(spark, f"{path}/compact").withColumn("file", F.input_file_name())
    return back.agg(F.count_distinct("label").alias("tracks"), F.count("*").alias("n"), F.count_distinct("file").alias("files"))


@query(
    "compact_files",
    "SELECT label, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, round(sum(embedding[1]::DOUBLE), 6) + 0.0 AS first_entries FROM embeddings GROUP BY label",
)
def _(spark, folder):
    """The same small outputs packed by size, without a shuffle of rows (M8)."""
    path, e = _fresh(spark), v.table(spark, folder, "embeddings")
    e.write.partitionBy("label").parquet(f"{path}/tracks")
    compaction.compact_files(spark, f"{path}/tracks", f"{path}/packed", bin_bytes=1 << 20)
    back = readers.read_table(spark, f"{path}/packed")
    first = F.round(F.sum(F.col("embedding")[0].cast("double")), 6) + 0.0
    return back.groupBy("label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"), first.alias("first_entries"))
