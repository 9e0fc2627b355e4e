"""Set operations (section 2.7)."""

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.operators import sets
from windowlark.plans import views as v


@query(
    "union_all",
    """SELECT c_nationkey AS nationkey, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""",
)
def _(spark, folder):
    customers = v.table(spark, folder, "customer").selectExpr("c_nationkey as nationkey", "c_acctbal as balance")
    suppliers = v.table(spark, folder, "supplier").selectExpr("s_nationkey as nationkey", "s_acctbal as balance")
    return customers.unionByName(suppliers)


@query("union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, folder):
    customers = v.table(spark, folder, "customer").selectExpr("c_nationkey as nationkey")
    return customers.union(v.table(spark, folder, "supplier").selectExpr("s_nationkey")).distinct()


@query(
    "union_aligned",
    v.with_views(
        "clips",
        """SELECT species, vec_id, start_time FROM clips WHERE probability > 0.9
           UNION ALL SELECT prediction, vec_id, start_time FROM clips WHERE energy < 50""",
    ),
)
def _(spark, folder):
    clips = v.clips(spark, folder)
    sure = clips.where("probability > 0.9").select("species", "vec_id", "start_time")
    quiet = clips.where("energy < 50").drop("species").withColumnRenamed("prediction", "species")
    return sets.union_aligned(sure, quiet)


@query(
    "key_overlap",
    """WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), b AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F')
       SELECT count(*) AS n, count(b.k) AS shared, round(count(b.k) / count(*), 6) AS share FROM a LEFT JOIN b ON a.k = b.k""",
)
def _(spark, folder):
    lines = v.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"))
    closed = v.table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return sets.overlap_share(lines, closed, "k").withColumn("share", F.round("share", 6))


@query("key_except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def _(spark, folder):
    buyers = v.table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))
    solvent = v.table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return sets.keys_except(buyers, solvent, "k")
