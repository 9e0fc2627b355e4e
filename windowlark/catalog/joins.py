"""Joins (section 2.3)."""

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.operators import joins
from windowlark.operators.aggregates import count_by
from windowlark.operators.ordered import assign_row_id, join_back
from windowlark.plans import views as v



@query(
    "join_multikey",
    v.with_views(
        "clips",
        """SELECT a.vec_id AS vec_id, b.vec_id AS other_id, a.stem, a.start_time FROM clips a
           JOIN clips b ON a.stem = b.stem AND a.start_time = b.start_time
           WHERE a.track_type = 'original' AND b.track_type = 'source0'""",
    ),
)
def _(spark, folder):
    clips = v.clips(spark, folder)
    original = clips.where("track_type = 'original'").select("vec_id", "stem", "start_time")
    separated = clips.where("track_type = 'source0'").select(F.col("vec_id").alias("other_id"), "stem", "start_time")
    return original.join(separated, ["stem", "start_time"], "inner")


@query(
    "join_dimension",
    v.with_views(
        "clips track_meta",
        """SELECT vec_id, clips.stem, primary_label, (species = primary_label) AS same FROM clips JOIN track_meta ON clips.stem = track_meta.stem""",
    ),
)
def _(spark, folder):
    meta = v.track_meta(spark, folder).select("stem", "primary_label")
    joined = v.clips(spark, folder).join(meta, "stem")
    return joined.select("vec_id", "stem", "primary_label", (F.col("species") == F.col("primary_label")).alias("same"))


@query(
    "neighbor_attach",
    v.with_views(
        "vecs",
        """, edges AS (SELECT id, (id + 1) % (SELECT count(*) FROM vecs) AS neighbor_id FROM vecs)
           SELECT e.id, e.neighbor_id, n.guess AS neighbor_guess FROM edges e JOIN vecs n ON e.neighbor_id = n.id""",
    ),
)
def _(spark, folder):
    nodes = v.vecs(spark, folder)
    total = nodes.agg(F.count("*")).scalar()
    ring = nodes.select("id", ((F.col("id") + 1) % total).alias("neighbor_id"))
    return joins.attach_neighbor(ring, nodes.select("id", F.col("guess").alias("neighbor_guess")))


@query(
    "rejoin_agg",
    """SELECT o_orderkey, o_custkey, o_totalprice, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share,
       count(*) OVER (PARTITION BY o_custkey) AS n FROM orders""",
)
def _(spark, folder):
    orders = v.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    totals = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    joined = join_back(orders, totals, ["o_custkey"])
    return joined.withColumn("share", F.round(F.col("o_totalprice") / F.col("total"), 6)).drop("total")


@query(
    "anti_rare",
    """SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) < 80)""",
)
def _(spark, folder):
    part = v.table(spark, folder, "part").select("p_partkey", "p_brand")
    rare = count_by(part, ["p_brand"]).where("n < 80")
    return part.join(rare, "p_brand", "left_anti")


@query(
    "semi_common",
    """SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= 80)""",
)
def _(spark, folder):
    part = v.table(spark, folder, "part").select("p_partkey", "p_brand")
    common = count_by(part, ["p_brand"]).where("n >= 80")
    return part.join(common, "p_brand", "left_semi")


@query(
    "outer_annotate",
    v.with_views(
        "clips",
        """, loud AS (SELECT stem, start_time, max(energy) AS energy FROM clips WHERE energy > 700 GROUP BY stem, start_time),
           called AS (SELECT stem, start_time, max(prediction) AS prediction FROM clips WHERE probability > 0.8 GROUP BY stem, start_time)
           SELECT COALESCE(l.stem, c.stem) AS stem, COALESCE(l.start_time, c.start_time) AS start_time, l.energy,
                  COALESCE(CAST(c.prediction AS VARCHAR), 'none') AS label
           FROM loud l FULL JOIN called c ON l.stem = c.stem AND l.start_time = c.start_time""",
    ),
)
def _(spark, folder):
    from windowlark.plans.reports import annotate_tracks

    clips = v.clips(spark, folder)
    keys = ["stem", "start_time"]
    loud = clips.where("energy > 700").groupBy(*keys).agg(F.max("energy").alias("energy"))
    called = clips.where("probability > 0.8").groupBy(*keys).agg(F.max("prediction").cast("string").alias("label"))
    return annotate_tracks(loud, called, keys, "label")


@query(
    "cross_noise",
    v.with_views(
        "clips",
        """, noise AS (SELECT vec_id AS noise_id, embedding AS noise FROM clips ORDER BY probability, vec_id LIMIT 20)
           SELECT vec_id, noise_id, round(CAST(embedding[1] AS DOUBLE) + CAST(noise[1] AS DOUBLE), 6) AS first_sum
           FROM clips, noise WHERE track_type = 'source1'""",
    ),
)
def _(spark, folder):
    clips = v.clips(spark, folder)
    noise = clips.select("probability", F.col("vec_id").alias("noise_id"), F.col("embedding").alias("noise"))
    base = clips.where("track_type = 'source1'").select("vec_id", "embedding")
    pairs = joins.pair_with_slots(base, noise, 20, ["probability", "noise_id"])
    first = F.get("embedding", F.lit(0)).cast("double") + F.get("noise", F.lit(0)).cast("double")
    return pairs.select("vec_id", "noise_id", F.round(first, 6).alias("first_sum"))


@query(
    "partner_pairs",
    """WITH dense AS (SELECT vec_id AS other_id, label AS other_label, row_number() OVER (ORDER BY label, vec_id) - 1 AS "index" FROM embeddings)
        SELECT e.vec_id, d.other_id, e.label + d.other_label AS label_sum FROM embeddings e
        JOIN dense d ON (vec_id * 7919 + 13) % (SELECT count(*) FROM embeddings) = d."index" """,
)
def _(spark, folder):
    e = v.table(spark, folder, "embeddings").select("vec_id", "label")
    dense = assign_row_id(
        e.select(F.col("vec_id").alias("other_id"), F.col("label").alias("other_label")),
        ["other_label", "other_id"],
        "index",
        start=0,
    )
    drawn = joins.random_partner(e, dense, ["vec_id"], bucket=F.expr("vec_id * 7919 + 13"))
    return drawn.select("vec_id", "other_id", (F.col("label") + F.col("other_label")).alias("label_sum"))


@query(
    "propagate_labels",
    v.with_views(
        "clips",
        """SELECT a.vec_id, a.track_type, b.track_type AS from_type, b.prediction AS label FROM clips a
           JOIN clips b ON a.stem = b.stem AND a.start_time = b.start_time WHERE b.track_type <> 'original'""",
    ),
)
def _(spark, folder):
    clips = v.clips(spark, folder)
    labels = clips.where("track_type <> 'original'").select(
        "stem", "start_time", F.col("track_type").alias("from_type"), F.col("prediction").alias("label")
    )
    out = joins.propagate_labels(clips.select("vec_id", "stem", "start_time", "track_type"), labels, ["stem", "start_time"])
    return out.select("vec_id", "track_type", "from_type", "label")


@query(
    "sql_pct_match",
    v.with_views(
        "vecs",
        """, totals AS (SELECT truth, count(*) AS n FROM vecs GROUP BY 1),
           matched AS (SELECT truth, count(*) AS n FROM vecs WHERE truth = guess GROUP BY 1)
           SELECT truth, round(matched.n * 100.0 / totals.n, 6) AS pct FROM matched JOIN totals USING (truth)""",
    ),
)
def _(spark, folder):
    return spark.sql(
        """WITH totals AS (SELECT truth, count(*) AS n FROM {nodes} GROUP BY 1),
                matched AS (SELECT truth, count(*) AS n FROM {nodes} WHERE truth = guess GROUP BY 1)
           SELECT truth, round(double(matched.n) / totals.n * 100, 6) AS pct
           FROM matched JOIN totals USING (truth) ORDER BY pct DESC, truth""",
        nodes=v.vecs(spark, folder),
    )


@query(
    "join_regex_key",
    v.with_views(
        "durations",
        """, l AS (SELECT filename, duration, regexp_extract(filename, 'XC(\\d+)', 1) AS xc FROM durations),
           r AS (SELECT concat('XC', CAST(doc_id AS VARCHAR), '_part000.wav') AS clip, regexp_extract(concat('XC', CAST(doc_id AS VARCHAR), '_part000.wav'), 'XC(\\d+)', 1) AS xc, quality FROM labels)
           SELECT l.xc AS xc, filename, clip, duration, quality FROM l JOIN r ON l.xc = r.xc""",
    ),
)
def _(spark, folder):
    clip = F.concat(F.lit("XC"), F.col("doc_id").cast("string"), F.lit("_part000.wav"))
    rated = v.table(spark, folder, "labels").select(clip.alias("clip"), "quality")
    tracks = v.durations(spark, folder).select("filename", "duration")
    return joins.join_on_pattern(tracks, "filename", rated, "clip", r"XC(\d+)", "xc")


@query(
    "lookup_default",
    """SELECT s_suppkey, s_nationkey, COALESCE(n_name, 'unknown') AS nation FROM supplier
       LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey""",
)
def _(spark, folder):
    dim = v.table(spark, folder, "nation").where("n_regionkey < 3")
    dim = dim.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return joins.lookup(v.table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), dim, "s_nationkey", "nation")


@query(
    "overlap_count",
    """SELECT d.lang, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""",
)
def _(spark, folder):
    both = v.table(spark, folder, "documents").join(v.table(spark, folder, "labels").select("doc_id"), "doc_id")
    return count_by(both, ["lang"]).orderBy(F.desc("n"), "lang")


@query(
    "class_attach",
    """WITH e AS (SELECT vec_id, i - 1 AS "index", CAST(embedding[i] AS DOUBLE) AS logit FROM embeddings, range(1, 65) t(i))
       SELECT vec_id, e."index", n_name AS label, round(1 / (1 + exp(-logit)), 6) AS probability
       FROM e JOIN nation ON n_nationkey = e."index" WHERE n_nationkey IN (1, 7, 12, 24)""",
)
def _(spark, folder):
    from windowlark.functions.vector import sigmoid
    from windowlark.operators.rows import explode_classes

    names = v.table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("index"), F.col("n_name").alias("label")
    )
    scores = explode_classes(v.table(spark, folder, "embeddings"), "embedding", [1, 7, 12, 24], ["vec_id"])
    out = joins.attach_class(scores, names)
    return out.select("vec_id", "index", "label", F.round(sigmoid("logit"), 6).alias("probability"))
