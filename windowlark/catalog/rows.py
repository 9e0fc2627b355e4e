"""Projections, filters and row expansion (section 2.2)."""

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.functions.vector import top_indices
from windowlark.operators import rows
from windowlark.plans import views as v


@query(
    "project_alias",
    """SELECT l_orderkey AS order_id, l_linenumber AS line, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem""",
)
def _(spark, folder):
    return v.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey as order_id",
        "l_linenumber as line",
        "round(l_extendedprice * (1 - l_discount), 4) as revenue",
    )


@query(
    "rename_drop",
    """SELECT c_custkey AS customer_id, c_name, c_mktsegment, round(c_acctbal / 1000, 5) AS balance_k FROM customer""",
)
def _(spark, folder):
    return (
        v.table(spark, folder, "customer")
        .withColumn("balance_k", F.round(F.col("c_acctbal") / 1000, 5))
        .withColumnRenamed("c_custkey", "customer_id")
        .drop("c_nationkey", "c_acctbal")
    )


@query(
    "flatten_struct",
    v.with_views("clips", "SELECT vec_id, stem, start_time, prediction, probability FROM clips"),
)
def _(spark, folder):
    packed = v.clips(spark, folder).select(
        "vec_id", F.struct("stem", "start_time", "prediction", "probability").alias("window")
    )
    return packed.select("vec_id", "window.*")


@query(
    "explode_zip",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders)
       SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE p <= 5""",
)
def _(spark, folder):
    from windowlark.operators.aggregates import collect_ordered
    from windowlark.operators.windows import top_per_group

    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    best = top_per_group(v.table(spark, folder, "orders"), ["o_custkey"], order, 5)
    lists = collect_ordered(best, ["o_custkey"], ["o_totalprice"], ["o_orderkey", "o_totalprice"])
    return rows.explode_zip(lists, ["o_orderkey", "o_totalprice"], ["o_custkey"])


@query(
    "posexplode_vec",
    """SELECT vec_id, CAST(i - 1 AS INTEGER) AS "index", CAST(embedding[i] AS DOUBLE) AS value
       FROM embeddings, range(1, 65) t(i)""",
)
def _(spark, folder):
    vectors = v.table(spark, folder, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rows.explode_indexed(vectors, "embedding", ["vec_id"])


@query("explode_tags", v.with_views("tags", "SELECT doc, tag FROM tags"))
def _(spark, folder):
    from windowlark.operators.aggregates import collect_distinct

    sets = collect_distinct(v.tags(spark, folder), ["doc"], "tag", "tags")
    return sets.select("doc", F.explode("tags").alias("tag"))


@query(
    "filter_between",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderkey < o_totalprice""",
)
def _(spark, folder):
    orders = v.table(spark, folder, "orders")
    kept = orders.where("o_totalprice between 100000 and 200000").where(F.col("o_orderkey") < F.col("o_totalprice"))
    return kept.select("o_orderkey", "o_totalprice")


@query(
    "filter_isin",
    """SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders
       WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')""",
)
def _(spark, folder):
    orders = v.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).where(~F.col("o_orderstatus").isin("P"))


@query(
    "filter_like",
    """SELECT doc_id, source FROM documents WHERE text LIKE '%the%' AND source NOT LIKE '%1'""",
)
def _(spark, folder):
    return (
        v.table(spark, folder, "documents")
        .where("text like '%the%'")
        .where("source not like '%1'")
        .select("doc_id", "source")
    )


@query(
    "align_frames",
    v.with_views(
        "clips",
        """SELECT vec_id, start_time, CAST(FLOOR(start_time / 5) AS BIGINT) AS seq_id FROM clips
           WHERE start_time % 5 = 0 OR (start_time + 2) % 5 = 0""",
    ),
)
def _(spark, folder):
    return rows.align_frames(v.clips(spark, folder), "start_time").select("vec_id", "start_time", "seq_id")


@query(
    "align_frames_ten",
    v.with_views(
        "clips",
        """SELECT vec_id, start_time, CAST(FLOOR(start_time / 5) AS BIGINT) AS seq_id FROM clips
           WHERE start_time % 2 = 0 AND start_time % 5 = 0""",
    ),
)
def _(spark, folder):
    aligned = rows.align_frames(v.clips(spark, folder), "start_time", frame=10, offsets=(0,))
    return aligned.select("vec_id", "start_time", "seq_id")


@query(
    "filter_size",
    v.with_views("tags", "SELECT doc, count(*) AS n FROM tags GROUP BY doc HAVING count(*) > 3"),
)
def _(spark, folder):
    from windowlark.operators.aggregates import collect_distinct

    sets = collect_distinct(v.tags(spark, folder), ["doc"], "tag", "tags")
    return sets.where(F.size("tags") > 3).select("doc", F.size("tags").cast("bigint").alias("n"))


@query(
    "case_label",
    v.with_views(
        "clips",
        """SELECT vec_id, CASE WHEN probability > 0.5 THEN CAST(species AS VARCHAR) ELSE 'no_call' END AS label FROM clips""",
    ),
)
def _(spark, folder):
    label = F.when(F.col("probability") > 0.5, F.col("species").cast("string")).otherwise("no_call")
    return v.clips(spark, folder).select("vec_id", label.alias("label"))


@query(
    "coalesce_self",
    """SELECT d.doc_id, COALESCE(CAST(l.quality AS BIGINT), d.n_chars) AS value, COALESCE(CAST(l.toxic AS VARCHAR), 'none') AS toxic
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, folder):
    joined = v.table(spark, folder, "documents").join(v.table(spark, folder, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id",
        F.coalesce(F.col("quality").cast("bigint"), "n_chars").alias("value"),
        F.col("toxic").cast("string").alias("toxic"),
    ).fillna("none", subset=["toxic"])


@query("const_label", v.with_views("clips", "SELECT vec_id, 'no_call' AS species FROM clips WHERE probability < 0.1"))
def _(spark, folder):
    quiet = v.clips(spark, folder).where("probability < 0.1")
    return quiet.select("vec_id", F.lit("no_call").alias("species"))


@query(
    "vec_to_cols",
    "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS embedding{i}" for i in range(64)) + " FROM embeddings",
)
def _(spark, folder):
    return rows.vector_to_columns(v.table(spark, folder, "embeddings"), "embedding", 64, ["vec_id"])


@query(
    "top_entries",
    """WITH e AS (SELECT vec_id, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)),
       r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, dim) AS p FROM e)
       SELECT vec_id, CAST(p AS INTEGER) AS place, dim FROM r WHERE p <= 3""",
)
def _(spark, folder):
    vectors = v.table(spark, folder, "embeddings")
    best = vectors.select("vec_id", F.posexplode(top_indices("embedding", 3)).alias("place", "dim"))
    return best.withColumn("place", F.col("place") + 1)
