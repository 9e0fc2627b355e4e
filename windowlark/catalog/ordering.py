"""Order, limits, sampling and splits (section 2.6)."""

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.operators import sampling as smp
from windowlark.plans import views as v

MIX = "(o_orderkey * 7919 + 13) % 1000"


@query("sort_multi", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer")
def _(spark, folder):
    customers = v.table(spark, folder, "customer").select("c_mktsegment", "c_acctbal", "c_custkey")
    return customers.orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@query(
    "topk_limit",
    v.with_views(
        "durations",
        "SELECT filename, duration FROM durations WHERE duration > 29 ORDER BY duration DESC, filename LIMIT 50",
    ),
)
def _(spark, folder):
    long = v.durations(spark, folder).where("duration > 29").select("filename", "duration")
    return smp.top_k(long, [F.desc("duration"), F.asc("filename")], 50)


@query(
    "nth_frequent",
    v.with_views(
        "vecs",
        """, c AS (SELECT truth, row_number() OVER (ORDER BY count(*) DESC, truth) AS r FROM vecs GROUP BY truth)
           SELECT id, truth, guess FROM vecs WHERE truth = (SELECT truth FROM c WHERE r = 3)""",
    ),
)
def _(spark, folder):
    return smp.nth_frequent(v.vecs(spark, folder).select("id", "truth", "guess"), "truth", 2)


@query("shuffle_rows", "SELECT c_custkey, c_name FROM customer")
def _(spark, folder):
    return smp.shuffle_rows(v.table(spark, folder, "customer").select("c_custkey", "c_name"), ["c_custkey"], seed=3)


@query(
    "sample_strata",
    """SELECT event_id, event_type FROM events
       WHERE (event_id * 7919 + 13) % 1000 < CASE event_type WHEN 'click' THEN 600 WHEN 'view' THEN 100 ELSE 300 END""",
)
def _(spark, folder):
    u = F.expr("(event_id * 7919 + 13) % 1000") / 1000
    rate = F.when(F.col("event_type") == "click", 0.6).when(F.col("event_type") == "view", 0.1).otherwise(0.3)
    return smp.sample_strata(v.table(spark, folder, "events").select("event_id", "event_type"), ["event_id"], rate, bucket=u)


@query(
    "hash_split",
    f"""SELECT o_orderkey, CASE WHEN {MIX} < 800 THEN 0 WHEN {MIX} < 900 THEN 1 ELSE 2 END AS part FROM orders""",
)
def _(spark, folder):
    orders = v.table(spark, folder, "orders").select("o_orderkey")
    return smp.split(orders, ["o_orderkey"], [800, 100, 100], bucket=F.expr(MIX) / 1000)


@query(
    "split_stratified",
    f"""SELECT o_orderkey, o_orderpriority,
        row_number() OVER (PARTITION BY o_orderpriority ORDER BY {MIX}, o_orderkey) <= floor(0.67 * count(*) OVER (PARTITION BY o_orderpriority)) AS is_train
        FROM orders""",
)
def _(spark, folder):
    orders = v.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    order = [F.expr(MIX), F.col("o_orderkey")]
    return smp.split_stratified(orders, "o_orderpriority", 0.67, ["o_orderkey"], order=order)


@query(
    "split_positional",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(0.7 * (SELECT count(*) FROM orders)) AS is_train FROM orders""",
)
def _(spark, folder):
    orders = v.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return smp.split_positional(orders, ["o_orderdate", "o_orderkey"], 0.7).drop("o_orderdate")


@query(
    "reindex_edges",
    v.with_views(
        "vecs",
        """, r AS (SELECT id, row_number() OVER (ORDER BY emb[1], id) - 1 AS rank FROM vecs),
           e AS (SELECT id, (id * 31 + 7) % (SELECT count(*) FROM vecs) AS neighbor_id FROM vecs)
           SELECT e.id, e.neighbor_id, a.rank AS mapped_id, b.rank AS mapped_neighbor FROM e JOIN r a ON e.id = a.id JOIN r b ON e.neighbor_id = b.id""",
    ),
)
def _(spark, folder):
    nodes = v.vecs(spark, folder)
    total = nodes.agg(F.count("*")).scalar()
    edges = nodes.select("id", ((F.col("id") * 31 + 7) % total).alias("neighbor_id"))
    coord = nodes.select("id", F.get("emb", F.lit(0)).alias("x"))
    return smp.reindex_edges(edges, coord, ["x", "id"])
