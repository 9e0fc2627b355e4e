"""Per-group ranking and neighbouring rows (section 2.5)."""

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.operators import windows as win
from windowlark.operators.aggregates import reduce_frames
from windowlark.operators.ordered import assign_row_id, group_position
from windowlark.plans import views as v


@query(
    "best_per_group",
    v.with_views(
        "clips",
        """SELECT stem, vec_id, probability FROM clips
           QUALIFY row_number() OVER (PARTITION BY stem ORDER BY probability DESC, vec_id) = 1""",
    ),
)
def _(spark, folder):
    best = win.top_per_group(v.clips(spark, folder), ["stem"], [F.desc("probability"), F.asc("vec_id")])
    return best.select("stem", "vec_id", "probability")


@query(
    "rank_ties",
    """SELECT o_custkey, o_orderkey, o_orderpriority FROM orders
       QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) = 1""",
)
def _(spark, folder):
    orders = v.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return win.best_with_ties(orders, ["o_custkey"], "o_orderpriority")


@query(
    "row_id",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey) AS id FROM orders""",
)
def _(spark, folder):
    orders = v.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return assign_row_id(orders, ["o_orderpriority", "o_totalprice", "o_orderkey"]).select("o_orderkey", "id")


@query(
    "group_position",
    """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS pos FROM events""",
)
def _(spark, folder):
    events = v.table(spark, folder, "events").select("event_id", "event_type", "value")
    return group_position(events, ["event_type"], [F.desc("value"), F.asc("event_id")]).drop("value")


@query(
    "share_of_group",
    v.with_views(
        "vecs",
        """, c AS (SELECT truth, guess, count(*) AS n FROM vecs GROUP BY truth, guess)
           SELECT truth, guess, n, CAST(sum(n) OVER (PARTITION BY truth) AS BIGINT) AS total,
                  round(n / sum(n) OVER (PARTITION BY truth), 6) AS share FROM c""",
    ),
)
def _(spark, folder):
    counts = v.vecs(spark, folder).groupBy("truth", "guess").agg(F.count("*").alias("n"))
    return win.share_of_group(counts, ["truth"], "n").withColumn("share", F.round("share", 6))


@query(
    "group_size_filter",
    """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS group_size FROM events
       QUALIFY count(*) OVER (PARTITION BY user_id) > 1""",
)
def _(spark, folder):
    events = v.table(spark, folder, "events").select("event_id", "user_id")
    return win.with_group_size(events, ["user_id"]).where("group_size > 1")


@query(
    "lead_or_self",
    """SELECT user_id, event_id, COALESCE(lead(value) OVER (PARTITION BY user_id ORDER BY event_id), value) AS next_value FROM events""",
)
def _(spark, folder):
    events = v.table(spark, folder, "events").select("user_id", "event_id", "value")
    # a narrow block, so that rows do cross block borders
    return win.lead_or_self(events, ["user_id"], "event_id", "value", "next_value", width=512).drop("value")


@query(
    "topk_per_group",
    v.with_views(
        "clips",
        """SELECT species, vec_id, energy FROM clips
           QUALIFY row_number() OVER (PARTITION BY species ORDER BY energy DESC, vec_id) <= 5""",
    ),
)
def _(spark, folder):
    best = win.top_per_group(v.clips(spark, folder), ["species"], [F.desc("energy"), F.asc("vec_id")], 5)
    return best.select("species", "vec_id", "energy")


@query(
    "topk_per_group_large",
    """SELECT event_type, event_id FROM events
       QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 1500""",
)
def _(spark, folder):
    events = v.table(spark, folder, "events").select("event_type", "event_id", "value")
    return win.top_per_group(events, ["event_type"], [F.desc("value"), F.asc("event_id")], 1500).drop("value")


@query(
    "sample_per_group",
    "SELECT user_id, least(count(*), 10) AS n FROM events GROUP BY user_id",
)
def _(spark, folder):
    picked = win.sample_per_group(v.table(spark, folder, "events"), ["user_id"], ["event_id"], 10, seed=7)
    return picked.groupBy("user_id").agg(F.count_distinct("event_id").alias("n"))


@query(
    "busiest_group",
    v.with_views(
        "tags",
        """, d AS (SELECT doc, count(*) AS size FROM tags GROUP BY doc),
           o AS (SELECT o_custkey, doc, size, sum(size) OVER (PARTITION BY o_custkey) AS total FROM d JOIN orders ON doc = o_orderkey)
           SELECT o_custkey, doc, CAST(total AS BIGINT) AS total FROM o WHERE total = (SELECT max(total) FROM o)""",
    ),
)
def _(spark, folder):
    from windowlark.operators.aggregates import collect_distinct

    sets = collect_distinct(v.tags(spark, folder), ["doc"], "tag", "tags")
    owners = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc"), "o_custkey")
    rows = win.busiest_group(sets.join(owners, "doc"), ["o_custkey"], F.size("tags"))
    return rows.select("o_custkey", "doc", "total")


@query(
    "moving_avg3",
    """SELECT event_id, CASE WHEN count(value) OVER w = 3 THEN round(avg(value) OVER w, 6) END AS mean3 FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def _(spark, folder):
    events = v.table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    smooth = win.moving_avg(events, ["user_id"], ["ts", "event_id"], "value", 3, "mean3", width=64)
    return smooth.select("event_id", F.round("mean3", 6).alias("mean3"))


@query(
    "reduce_pairs",
    """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r FROM events)
       SELECT user_id, CAST(floor(r / 2) AS BIGINT) AS frame, max(value) AS peak FROM p GROUP BY 1, 2""",
)
def _(spark, folder):
    events = v.table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return reduce_frames(events, ["user_id"], ["ts", "event_id"], 2, F.max("value"), "peak")


@query(
    "sql_vote_mode",
    v.with_views(
        "tags",
        """, n AS (SELECT o_custkey, tag, count(*) AS n FROM tags JOIN orders ON doc = o_orderkey GROUP BY 1, 2)
           SELECT o_custkey, tag FROM n QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, tag) = 1""",
    ),
)
def _(spark, folder):
    return spark.sql(
        """WITH votes AS (SELECT o_custkey, tag, count(*) AS n FROM {doc_tags} JOIN {doc_owner} ON doc = o_orderkey GROUP BY 1, 2),
                ranked AS (SELECT o_custkey, tag, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, tag) AS place FROM votes)
           SELECT o_custkey, tag FROM ranked WHERE place = 1""",
        doc_tags=v.tags(spark, folder), doc_owner=v.table(spark, folder, "orders"),
    )
