"""Aggregations (section 2.4)."""

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.operators import aggregates as agg
from windowlark.operators import itemsets
from windowlark.plans import views as v


@query("count_by_key", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, folder):
    lines = v.table(spark, folder, "lineitem")
    return agg.count_by(lines, ["l_returnflag", "l_linestatus"]).orderBy(F.desc("n"))


@query(
    "agg_basic",
    v.with_views(
        "clips",
        """SELECT stem, track_type, round(sum(energy), 6) AS total, round(avg(probability), 6) AS mean, min(start_time) AS first_sec,
           max(start_time) + 3 AS end_sec, count(*) AS n FROM clips GROUP BY stem, track_type""",
    ),
)
def _(spark, folder):
    return (
        v.clips(spark, folder)
        .groupBy("stem", "track_type")
        .agg(
            F.round(F.sum("energy"), 6).alias("total"),
            F.round(F.avg("probability"), 6).alias("mean"),
            F.min("start_time").alias("first_sec"),
            (F.max("start_time") + 3).alias("end_sec"),
            F.count("*").alias("n"),
        )
    )


@query(
    "match_rate",
    v.with_views(
        "vecs",
        """SELECT truth, count(*) AS n, round(avg(CAST(truth = guess AS INTEGER)), 6) AS rate FROM vecs GROUP BY truth""",
    ),
)
def _(spark, folder):
    return agg.match_rate(v.vecs(spark, folder), "truth", "guess", ["truth"]).withColumn("rate", F.round("rate", 6))


@query("having_rare", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) < 100")
def _(spark, folder):
    return agg.count_by(v.table(spark, folder, "events"), ["user_id"]).where("n < 100")


@query(
    "percentiles_by_type",
    """SELECT event_type, quantile_disc(value, 0.05) AS value_p05, quantile_disc(value, 0.5) AS value_p50,
       quantile_disc(value, 0.95) AS value_p95 FROM events GROUP BY event_type""",
)
def _(spark, folder):
    return agg.percentiles(v.table(spark, folder, "events"), "value", [0.05, 0.5, 0.95], ["event_type"])


@query(
    "collect_tags",
    v.with_views("tags", "SELECT doc, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY doc"),
)
def _(spark, folder):
    sets = agg.collect_distinct(v.tags(spark, folder), ["doc"], "tag", "tags")
    return sets.select("doc", F.array_join("tags", ",").alias("tags"))


@query(
    "collect_ordered",
    v.with_views(
        "clips",
        """SELECT stem, start_time, string_agg(CAST(prediction AS VARCHAR), ',' ORDER BY probability DESC) AS predictions
           FROM clips WHERE probability > 0.3 GROUP BY stem, start_time""",
    ),
)
def _(spark, folder):
    likely = v.clips(spark, folder).where("probability > 0.3")
    lists = agg.collect_ordered(likely, ["stem", "start_time"], ["probability"], ["prediction"], desc=True)
    return lists.select("stem", "start_time", F.array_join(F.col("prediction").cast("array<string>"), ",").alias("predictions"))


@query(
    "freq_of_freq",
    v.with_views("tags", "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM tags GROUP BY doc) GROUP BY size"),
)
def _(spark, folder):
    return agg.freq_of_freq(v.tags(spark, folder), ["doc"])


@query(
    "distinct_count",
    """SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag""",
)
def _(spark, folder):
    return (
        v.table(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))
    )


@query("distinct_rows", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def _(spark, folder):
    return v.table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct().agg(F.count("*").alias("n"))


@query(
    "dedupe_keys",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1""",
)
def _(spark, folder):
    lines = v.table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return agg.dedupe(lines, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"])


@query(
    "coverage_pct",
    v.with_views("clips", "SELECT round(count(*) FILTER (WHERE probability > 0.5) * 100.0 / count(*), 6) AS pct FROM clips"),
)
def _(spark, folder):
    return agg.coverage_pct(v.clips(spark, folder), F.col("probability") > 0.5).withColumn("pct", F.round("pct", 6))


@query(
    "summary_stats",
    v.with_views(
        "durations",
        """SELECT count(duration) AS n, round(avg(duration), 4) AS mean, round(stddev_samp(duration), 4) AS stddev, min(duration) AS min,
           quantile_disc(duration, 0.25) AS p25, quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.75) AS p75,
           max(duration) AS max FROM durations""",
    ),
)
def _(spark, folder):
    stats = agg.summarize(v.durations(spark, folder), "duration")
    return stats.withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 4)})


@query(
    "total_share",
    v.with_views(
        "durations",
        """SELECT species, round(sum(duration) / 3600, 6) AS hours, round(sum(duration) / (SELECT sum(duration) FROM durations), 6) AS share
           FROM durations GROUP BY species""",
    ),
)
def _(spark, folder):
    tracks = v.durations(spark, folder)
    total = tracks.agg(F.sum("duration")).scalar()
    sums = tracks.groupBy("species").agg(F.sum("duration").alias("s"))
    return sums.select("species", F.round(F.col("s") / 3600, 6).alias("hours"), F.round(F.col("s") / total, 6).alias("share"))


@query(
    "mean_vector",
    """WITH e AS (SELECT label, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i))
       SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) + 0.0 AS mean FROM e GROUP BY label, dim""",
)
def _(spark, folder):
    means = agg.mean_vector(v.table(spark, folder, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("embedding").alias("dim", "x")).select(
        "label", "dim", F.round("x", 6).alias("mean")
    )


@query(
    "hist_equiwidth",
    """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
       SELECT CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM events, b GROUP BY 1""",
)
def _(spark, folder):
    return agg.histogram(v.table(spark, folder, "events"), F.col("value"), 20)


@query(
    "hist_log",
    """WITH x AS (SELECT ln(o_totalprice) AS y FROM orders), b AS (SELECT min(y) AS lo, max(y) AS hi FROM x)
       SELECT CAST(least(floor((y - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM x, b GROUP BY 1""",
)
def _(spark, folder):
    return agg.histogram(v.table(spark, folder, "orders"), F.log("o_totalprice"), 20)


@query(
    "lump_top_n",
    """WITH top AS (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 5)
       SELECT COALESCE(top.p_type, 'other') AS lump, count(*) AS n FROM part LEFT JOIN top ON part.p_type = top.p_type GROUP BY 1""",
)
def _(spark, folder):
    lumped = agg.lump_top_n(v.table(spark, folder, "part").select("p_partkey", "p_type"), "p_type", 5)
    return agg.count_by(lumped, ["lump"])


@query(
    "cooccurrence",
    v.with_views(
        "tags",
        """, first AS (SELECT doc, min(tag) AS primary_tag FROM tags GROUP BY doc),
           pairs AS (SELECT DISTINCT primary_tag, tag FROM tags JOIN first USING (doc))
           SELECT primary_tag, string_agg(tag, ',' ORDER BY tag) AS together FROM pairs GROUP BY primary_tag""",
    ),
)
def _(spark, folder):
    sets = agg.collect_distinct(v.tags(spark, folder), ["doc"], "tag", "tags")
    marked = sets.withColumn("primary_tag", F.array_min("tags"))
    found = agg.cooccurrence(marked, "primary_tag", "tags")
    return found.select("primary_tag", F.array_join("together", ",").alias("together"))


@query(
    "freq_pairs",
    v.with_views(
        "tags",
        """, n AS (SELECT count(DISTINCT doc) AS docs FROM tags),
           p AS (SELECT a.tag AS first_tag, b.tag AS second_tag, count(*) AS freq FROM tags a JOIN tags b ON a.doc = b.doc AND a.tag < b.tag GROUP BY 1, 2)
           SELECT first_tag, second_tag, freq FROM p, n WHERE freq >= 0.02 * docs""",
    ),
)
def _(spark, folder):
    sets = agg.collect_distinct(v.tags(spark, folder), ["doc"], "tag", "tags")
    found = agg.frequent_itemsets(sets, "tags", support=0.02, max_size=2)
    return found.select(
        F.get("items", F.lit(0)).alias("first_tag"), F.get("items", F.lit(1)).alias("second_tag"), "freq"
    )


_SETS = """, n AS (SELECT count(DISTINCT doc) AS docs FROM tags),
  s AS (SELECT [tag] AS items, count(*) AS freq FROM tags GROUP BY tag
    UNION ALL SELECT [a.tag, b.tag], count(*) FROM tags a JOIN tags b ON a.doc = b.doc AND a.tag < b.tag GROUP BY a.tag, b.tag
    UNION ALL SELECT [a.tag, b.tag, c.tag], count(*) FROM tags a JOIN tags b ON a.doc = b.doc AND a.tag < b.tag JOIN tags c ON a.doc = c.doc AND b.tag < c.tag
      GROUP BY a.tag, b.tag, c.tag
    UNION ALL SELECT [a.tag, b.tag, c.tag, d.tag], count(*) FROM tags a JOIN tags b ON a.doc = b.doc AND a.tag < b.tag JOIN tags c ON a.doc = c.doc AND b.tag < c.tag
      JOIN tags d ON a.doc = d.doc AND c.tag < d.tag GROUP BY a.tag, b.tag, c.tag, d.tag),
  f AS (SELECT items, freq FROM s, n WHERE freq >= 0.001 * docs)"""


@query("freq_sets", v.with_views("tags", _SETS + " SELECT array_to_string(items, ',') AS items, CAST(len(items) AS INTEGER) AS size, freq FROM f"))
def _(spark, folder):
    """Sets of up to four items in a thousandth of the baskets."""
    sets = agg.collect_distinct(v.tags(spark, folder), ["doc"], "tag", "tags")
    found = itemsets.frequent_sets(sets, "tags", 0.001)
    return found.select(F.array_join("items", ",").alias("items"), F.size("items").alias("size"), "freq")


@query(
    "freq_rules",
    v.with_views(
        "tags",
        _SETS + """, w AS (SELECT items, freq, unnest(items) AS consequent FROM f WHERE len(items) > 1),
          r AS (SELECT w.consequent, w.freq, p.items, w.freq / p.freq AS confidence, o.freq AS own FROM w
            JOIN f p ON p.items = list_filter(w.items, lambda x: x <> w.consequent) JOIN f o ON o.items = [w.consequent])
          SELECT array_to_string(items, ',') AS antecedent, consequent, freq, round(confidence, 9) AS confidence, round(confidence / (own / docs), 9) AS lift
          FROM r, n WHERE confidence >= 0.2""",
    ),
)
def _(spark, folder):
    """Rules with one item as consequent, at a confidence of a fifth."""
    sets = agg.collect_distinct(v.tags(spark, folder), ["doc"], "tag", "tags")
    rules = itemsets.association_rules(itemsets.frequent_sets(sets, "tags", 0.001), sets.count(), 0.2)
    return rules.select(
        F.array_join("antecedent", ",").alias("antecedent"), "consequent", "freq", F.round("confidence", 9).alias("confidence"), F.round("lift", 9).alias("lift")
    )


@query(
    "label_prior",
    v.with_views(
        "tags",
        """SELECT tag AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM tags), 6) AS share FROM tags GROUP BY tag""",
    ),
)
def _(spark, folder):
    sets = agg.collect_distinct(v.tags(spark, folder), ["doc"], "tag", "tags")
    return agg.label_prior(sets, "tags").withColumn("share", F.round("share", 6))


@query("label_pairs", v.with_views("vecs", "SELECT truth, guess, count(*) AS n FROM vecs GROUP BY truth, guess"))
def _(spark, folder):
    return agg.count_by(v.vecs(spark, folder), ["truth", "guess"])


@query(
    "pct_match",
    v.with_views("clips", """SELECT species, round(sum(CASE WHEN species = prediction AND probability > 0.9 THEN 1 ELSE 0 END) * 100 / count(*), 6) AS pct FROM clips GROUP BY species"""),
)
def _(spark, folder):
    sure = F.when(F.col("probability") > 0.9, F.col("prediction"))
    clips = v.clips(spark, folder).withColumn("sure", sure)
    return agg.pct_match(clips, "species", "sure").withColumn("pct", F.round("pct", 6))
