"""Scans, work lists and SQL text over views (section 2.1)."""

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.plans import views as v
from windowlark.sources.readers import attach_codes, read_table
from windowlark.sources.writers import assign_batches, pending


@query(
    "scan_parquet",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
       WHERE l_quantity > 30 AND l_discount < 0.05""",
)
def _(spark, folder):
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]
    df = read_table(spark, f"{folder}/lineitem.parquet", columns)
    return df.where("l_quantity > 30 and l_discount < 0.05")


@query(
    "class_dictionary",
    """SELECT CAST(n_nationkey AS BIGINT) AS "index", n_name AS label, concat(r_name, '_', CAST(n_nationkey AS VARCHAR)) AS mapped_label
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def _(spark, folder):
    nation, region = v.table(spark, folder, "nation"), v.table(spark, folder, "region")
    lines = nation.select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("label"))
    code = F.concat_ws("_", "r_name", F.col("n_nationkey").cast("string"))
    pairs = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("label"), code.alias("code")
    )
    return attach_codes(lines, pairs)


@query(
    "pending_antijoin",
    """SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def _(spark, folder):
    work = v.table(spark, folder, "documents").select("doc_id", "n_chars")
    return pending(work, v.table(spark, folder, "labels"), "doc_id")


@query(
    "batch_assign",
    """SELECT o_orderkey, CAST(FLOOR((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) / 100) AS BIGINT) AS batch
       FROM orders""",
)
def _(spark, folder):
    work = v.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    placed = assign_batches(work, 100, [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return placed.select("o_orderkey", "batch")


@query(
    "sql_group_count",
    v.with_views("vecs", "SELECT truth, count(*) AS n FROM vecs GROUP BY truth"),
)
def _(spark, folder):
    return spark.sql("SELECT truth, count(*) AS n FROM {nodes} GROUP BY truth ORDER BY n DESC, truth", nodes=v.vecs(spark, folder))
