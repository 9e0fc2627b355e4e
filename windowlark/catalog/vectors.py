"""Vector analytics and neighbour graphs (section 2.11)."""

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.functions import vector as vec
from windowlark.operators import descent, features, graphs, knn, labels, projection
from windowlark.operators.aggregates import histogram
from windowlark.plans import views as v

# rank by the full-precision distance, then id: the same order on both sides
NEAR = """, p AS (SELECT a.id, b.id AS neighbor_id, list_distance(CAST(a.emb AS DOUBLE[]), CAST(b.emb AS DOUBLE[])) AS distance FROM vecs a, vecs b),
e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor_id) - 1 AS pos FROM p QUALIFY pos < 10)"""
VOTE = """, votes AS (SELECT e.id, v.guess AS knn_label, count(*) AS n FROM e JOIN vecs v ON e.neighbor_id = v.id GROUP BY 1, 2),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY n DESC, knn_label) AS r FROM votes),
spread AS (SELECT id, quantile_disc(distance, 0.05) AS p05, quantile_disc(distance, 0.5) AS p50, quantile_disc(distance, 0.95) AS p95 FROM e GROUP BY id),
labeled AS (SELECT r.id, knn_label, n, CAST(total AS BIGINT) AS total, n / total AS score, p05, p50, p95, truth AS ego_truth, guess AS ego_label
  FROM ranked r JOIN spread s ON r.id = s.id JOIN vecs v ON r.id = v.id WHERE r.r = 1)"""


def graph(spark, folder, k=10):
    return knn.knn_exact(v.vecs(spark, folder), "id", "emb", k)


@query("knn_exact", v.with_views("vecs", NEAR + " SELECT id, CAST(pos AS INTEGER) AS pos, neighbor_id, round(distance, 6) AS distance FROM e"))
def _(spark, folder):
    return knn.edges_long(graph(spark, folder)).withColumn("distance", F.round("distance", 6))


@query("knn_probe")
def _(spark, folder):
    near = knn.knn_probe(v.vecs(spark, folder), "id", "emb", 10, probes=4, block=64)
    return knn.edges_long(near).withColumn("distance", F.round("distance", 6))


@query("knn_probe_all", v.with_views("vecs", NEAR + " SELECT id, CAST(pos AS INTEGER) AS pos, neighbor_id, round(distance, 6) AS distance FROM e"))
def _(spark, folder):
    """As many probes as blocks: exact."""
    near = knn.knn_probe(v.vecs(spark, folder), "id", "emb", 10, probes=1 << 30, block=64)
    return knn.edges_long(near).withColumn("distance", F.round("distance", 6))


@query("knn_probe_recall", "SELECT true AS enough, CAST(count(*) * 10 AS BIGINT) AS edges FROM embeddings")
def _(spark, folder):
    """At least nine of ten true neighbours, and ten for every row."""
    key = ["id", "neighbor_id"]
    near = knn.edges_long(knn.knn_probe(v.vecs(spark, folder), "id", "emb", 10, probes=40, block=128)).select(*key)
    hits = near.join(knn.edges_long(graph(spark, folder)).select(*key), key).agg(F.count("*")).scalar()
    return near.agg((hits >= 0.9 * F.count("*")).alias("enough"), F.count("*").alias("edges"))


@query("knn_descent")
def _(spark, folder):
    """Built with 30 neighbours, asked for 50."""
    near = descent.knn_descent(v.vecs(spark, folder), "id", "emb", 50, build=30)
    return knn.edges_long(near).withColumn("distance", F.round("distance", 6))


@query(
    "knn_descent_recall",
    v.with_views("vecs", NEAR + """ SELECT truth, true AS enough, count(*) AS edges, round(max(distance), 6) AS farthest
        FROM e JOIN vecs USING (id) GROUP BY truth"""),
)
def _(spark, folder):
    """By label: at least nine of ten edges of the exact graph, and the exact graph's edges and longest edge."""
    nodes = v.vecs(spark, folder)
    near = knn.edges_long(descent.knn_descent(nodes, "id", "emb", 10)).select("id", "neighbor_id", F.lit(1).alias("hit"))
    true = knn.edges_long(graph(spark, folder)).join(near, ["id", "neighbor_id"], "left").join(nodes.select("id", "truth"), "id")
    return true.groupBy("truth").agg(
        (F.count("hit") >= 0.9 * F.count("*")).alias("enough"), F.count("*").alias("edges"), F.round(F.max("distance"), 6).alias("farthest")
    )


@query(
    "knn_others",
    v.with_views(
        "vecs",
        """, p AS (SELECT a.id, b.id AS neighbor_id, list_distance(CAST(a.emb AS DOUBLE[]), CAST(b.emb AS DOUBLE[])) AS distance FROM vecs a JOIN vecs b ON a.id <> b.id)
           SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbor_id) - 1 AS INTEGER) AS pos, neighbor_id, round(distance, 6) AS distance
           FROM p QUALIFY pos < 5""",
    ),
)
def _(spark, folder):
    near = knn.knn_exact(v.vecs(spark, folder), "id", "emb", 5, include_self=False, block=128)
    return knn.edges_long(near).withColumn("distance", F.round("distance", 6))


@query(
    "edges_nested",
    v.with_views("vecs", NEAR + " SELECT id, string_agg(CAST(neighbor_id AS VARCHAR), ',' ORDER BY pos) AS neighbors FROM e GROUP BY id"),
)
def _(spark, folder):
    nested = knn.edges_nested(knn.edges_long(graph(spark, folder)))
    return nested.select("id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query(
    "knn_labels",
    v.with_views(
        "vecs",
        NEAR + VOTE + """ SELECT id, knn_label, n, total, round(score, 6) AS score, round(p05, 6) AS distance_p05, round(p50, 6) AS distance_p50,
        round(p95, 6) AS distance_p95, ego_truth, ego_label FROM labeled""",
    ),
)
def _(spark, folder):
    labeled = labels.knn_labels(v.vecs(spark, folder), knn.edges_long(graph(spark, folder)))
    names = ["score", "distance_p05", "distance_p50", "distance_p95"]
    return labeled.withColumns({c: F.round(c, 6) for c in names})


@query(
    "knn_distance_pct",
    v.with_views(
        "vecs",
        NEAR + """ SELECT id, round(quantile_disc(distance, 0.05), 6) AS distance_p05, round(quantile_disc(distance, 0.5), 6) AS distance_p50,
        round(quantile_disc(distance, 0.95), 6) AS distance_p95 FROM e GROUP BY id""",
    ),
)
def _(spark, folder):
    from windowlark.operators.aggregates import percentiles

    spread = percentiles(knn.edges_long(graph(spark, folder)), "distance", [0.05, 0.5, 0.95], ["id"])
    return spread.withColumns({c: F.round(c, 6) for c in spread.columns if c != "id"})


@query(
    "label_agreement",
    v.with_views(
        "vecs",
        NEAR + VOTE + """ SELECT ego_truth, count(*) AS n, count(*) FILTER (WHERE ego_truth = ego_label) AS n_ego_matches,
        count(*) FILTER (WHERE ego_truth = knn_label) AS n_knn_matches,
        round(count(*) FILTER (WHERE ego_truth = ego_label) / count(*), 6) AS pct_ego_matches,
        round(count(*) FILTER (WHERE ego_truth = knn_label) / count(*), 6) AS pct_knn_matches FROM labeled GROUP BY ego_truth""",
    ),
)
def _(spark, folder):
    labeled = labels.knn_labels(v.vecs(spark, folder), knn.edges_long(graph(spark, folder)))
    report = labels.label_agreement(labeled)
    return report.withColumns({c: F.round(c, 6) for c in ("pct_ego_matches", "pct_knn_matches")})


@query(
    "sql_knn_mode",
    v.with_views("vecs", NEAR + VOTE + " SELECT id, knn_label FROM labeled"),
)
def _(spark, folder):
    return spark.sql(
        """WITH votes AS (SELECT n.id, guess AS knn_label, count(*) AS votes FROM {neighbors} n JOIN {nodes} m ON n.neighbor_id = m.id GROUP BY 1, 2),
                ranked AS (SELECT id, knn_label, row_number() OVER (PARTITION BY id ORDER BY votes DESC, knn_label) AS place FROM votes)
           SELECT id, knn_label FROM ranked JOIN {nodes} USING (id) WHERE place = 1""",
        neighbors=knn.edges_long(graph(spark, folder)), nodes=v.vecs(spark, folder),
    )


@query(
    "class_subset",
    v.with_views(
        "vecs",
        NEAR + VOTE + """, c AS (SELECT truth, row_number() OVER (ORDER BY count(*) DESC, truth) AS r FROM vecs GROUP BY truth)
        SELECT id, knn_label, n, round(emb[1], 4) AS first_entry FROM labeled JOIN vecs USING (id) WHERE truth = (SELECT truth FROM c WHERE r = 1)""",
    ),
)
def _(spark, folder):
    nodes = v.vecs(spark, folder)
    labeled = labels.knn_labels(nodes, knn.edges_long(graph(spark, folder)))
    chosen = labels.class_subset(nodes, labeled, 0)
    return chosen.select("id", "knn_label", "n", F.round(F.get("emb", F.lit(0)), 4).alias("first_entry"))


@query(
    "knn_classify",
    """WITH train AS (SELECT vec_id, embedding, label FROM embeddings WHERE (vec_id * 7919 + 13) % 1000 < 700),
       test AS (SELECT vec_id, embedding FROM embeddings WHERE (vec_id * 7919 + 13) % 1000 >= 700),
       p AS (SELECT a.vec_id AS id, b.vec_id AS nid, b.label, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM test a, train b),
       e AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, nid) <= 5),
       votes AS (SELECT id, label, count(*) AS n FROM e GROUP BY 1, 2)
       SELECT id, label AS prediction, n AS votes FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1""",
)
def _(spark, folder):
    rows = v.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    in_train = F.expr("(id * 7919 + 13) % 1000 < 700")
    near = knn.knn_between(rows.where(~in_train), rows.where(in_train), "id", "embedding", 5)
    return labels.knn_classify(knn.edges_long(near), rows, "label")


@query(
    "neighbor_gap",
    v.with_views(
        "vecs",
        NEAR + """, g AS (SELECT ln(abs(neighbor_id - id) + 1) AS gap FROM e), b AS (SELECT min(gap) AS lo, max(gap) AS hi FROM g)
        SELECT CAST(least(floor((gap - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM g, b GROUP BY 1""",
    ),
)
def _(spark, folder):
    return histogram(knn.edges_long(graph(spark, folder)), vec.log_gap("neighbor_id", "id"), 20)


@query(
    "blend_vectors",
    """SELECT a.vec_id, i - 1 AS dim, round((CAST(a.embedding[i] AS DOUBLE) * 0.75 + CAST(b.embedding[i] AS DOUBLE) * 0.25) / 2, 6) + 0.0 AS half_blend,
       round((CAST(a.embedding[i] AS DOUBLE) + CAST(b.embedding[i] AS DOUBLE)) / 2, 6) + 0.0 AS pair_mean
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(1, 65) t(i)""",
)
def _(spark, folder):
    a = v.table(spark, folder, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mixed = a.join(b, "vec_id").select(
        "vec_id",
        F.posexplode(
            F.arrays_zip(
                vec.blend_vectors("embedding", "other", 0.75, scale=0.5).alias("h"),
                vec.mean_of_vectors("embedding", "other").alias("m"),
            )
        ).alias("dim", "z"),
    )
    return mixed.select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("z.h", 6).alias("half_blend"), F.round("z.m", 6).alias("pair_mean")
    )


_PROBS = """WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding][1:10] AS z FROM embeddings),
s AS (SELECT vec_id, label, list_transform(z, lambda x: exp(x)) AS x FROM e),
p AS (SELECT vec_id, label, x[label + 1] / list_sum(x) AS prob FROM s) """


@query("prob_of_label", _PROBS + "SELECT vec_id, label, round(prob, 6) AS prob FROM p")
def _(spark, folder):
    return _label_probs(spark, folder).select("vec_id", "label", F.round("prob", 6).alias("prob"))


@query("mean_true_prob", _PROBS + "SELECT label, count(*) AS n, round(avg(prob), 6) AS prob FROM p GROUP BY label")
def _(spark, folder):
    probs = _label_probs(spark, folder)
    return probs.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("prob"))


def _label_probs(spark, folder):
    logits = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    weights = F.transform(logits, F.exp)
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    probs = F.transform(weights, lambda x: x / total)
    return v.table(spark, folder, "embeddings").select(
        "vec_id", "label", vec.prob_of_label(probs, list(range(10)), "label").alias("prob")
    )


@query(
    "standard_scale",
    """WITH e AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i))
       SELECT vec_id, dim, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 5) + 0.0 AS z FROM e WINDOW w AS (PARTITION BY dim)""",
)
def _(spark, folder):
    scaled = features.standard_scale(v.table(spark, folder, "embeddings"), "embedding")
    rows = scaled.select("vec_id", F.posexplode("embedding").alias("dim", "z"))
    return rows.select("vec_id", "dim", F.round("z", 5).alias("z"))


_F = """WITH e AS (SELECT label, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)),
m AS (SELECT dim, label, avg(x) AS cm, count(*) AS cn, sum(x * x) - count(*) * avg(x) * avg(x) AS ss FROM e GROUP BY dim, label),
g AS (SELECT dim, avg(x) AS gm, count(*) AS n FROM e GROUP BY dim),
f AS (SELECT m.dim, (sum(cn * (cm - gm) * (cm - gm)) / (count(*) - 1)) / (sum(ss) / (any_value(n) - count(*))) AS f FROM m JOIN g ON m.dim = g.dim GROUP BY m.dim) """


@query("anova_f", _F + "SELECT dim, round(f, 6) AS f FROM f")
def _(spark, folder):
    scores = features.anova_f(v.table(spark, folder, "embeddings"), "embedding", "label")
    return scores.select("dim", F.round("f", 6).alias("f"))


@query(
    "select_dims",
    _F + """, top AS (SELECT dim FROM f ORDER BY f DESC, dim LIMIT 8), o AS (SELECT dim, row_number() OVER (ORDER BY dim) - 1 AS slot FROM top)
    SELECT vec_id, CAST(slot AS INTEGER) AS slot, round(CAST(embedding[dim + 1] AS DOUBLE), 6) + 0.0 AS x FROM embeddings, o""",
)
def _(spark, folder):
    chosen = features.select_dims(v.table(spark, folder, "embeddings"), "embedding", "label", 8)
    rows = chosen.select("vec_id", F.posexplode("selected").alias("slot", "x"))
    return rows.select("vec_id", "slot", F.round("x", 6).alias("x"))


@query(
    "concat_vectors",
    """SELECT a.vec_id, CAST(len(list_concat(a.embedding, b.embedding)) AS INTEGER) AS n, round(CAST(b.embedding[1] AS DOUBLE), 6) + 0.0 AS entry64
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, folder):
    a = v.table(spark, folder, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = a.join(b, "vec_id").withColumn("wide", vec.concat_vectors("embedding", "other"))
    return both.select("vec_id", F.size("wide").alias("n"), F.round(F.get("wide", F.lit(64)), 6).alias("entry64"))


@query(
    "masked_mse",
    """WITH j AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
       e AS (SELECT vec_id, i, pow(CAST(x[i] AS DOUBLE) - CAST(y[i] AS DOUBLE), 2) AS sq FROM j, range(1, 65) t(i)),
       m AS (SELECT vec_id, avg(sq) FILTER (WHERE (vec_id * 31 + (i - 1) * 17) % 100 < 15) AS mse FROM e GROUP BY vec_id)
       SELECT j.vec_id, round(mse, 6) AS mse, CAST(list_position(x, list_max(x)) = list_position(y, list_max(y)) AS INTEGER) AS hit FROM j JOIN m ON j.vec_id = m.vec_id""",
)
def _(spark, folder):
    a = v.table(spark, folder, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mask = F.transform("embedding", lambda _, i: (F.col("vec_id") * 31 + i * 17) % 100 < 15)
    joined = a.join(b, "vec_id").withColumn("mask", mask)
    return joined.select(
        "vec_id",
        F.round(vec.masked_mse("embedding", "other", "mask"), 6).alias("mse"),
        vec.argmax_hit("embedding", "other").alias("hit"),
    )


@query("mask_vectors")
def _(spark, folder):
    masked, mask = vec.mask_vectors("embedding", "vec_id", 0.15, seed=5)
    e = v.table(spark, folder, "embeddings").select("vec_id", masked.alias("masked"), mask.alias("mask"))
    return e.select("vec_id", F.size(F.filter("mask", lambda m: m)).alias("n_masked"), vec.energy("masked").alias("energy"))


@query("pca_project")
def _(spark, folder):
    out = features.pca(v.table(spark, folder, "embeddings"), "embedding", variance=0.9)
    return out.select("vec_id", F.size("projected").alias("n"), F.round(vec.energy("projected"), 6).alias("energy"))


@query(
    "pca_energy",
    """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
       m AS (SELECT dim, avg(x) AS m, var_samp(x) AS var FROM x GROUP BY dim)
       SELECT vec_id, round(sum((x - m) * (x - m)), 6) AS energy, (SELECT round(sum(var), 6) FROM m) AS total, true AS explained FROM x JOIN m USING (dim) GROUP BY vec_id""",
)
def _(spark, folder):
    """What a vector has along the components and off them adds up to its distance from the mean; 0.9 of all variance is along them."""
    e = v.table(spark, folder, "embeddings")
    found = projection.fit_components(e, "embedding", variance=0.9)
    return e.select(
        "vec_id", F.round(vec.energy(found.apply("embedding")) + found.left_over("embedding"), 6).alias("energy"), F.round(F.lit(found.total), 6).alias("total"),
        F.lit(bool(0.9 <= found.shares.sum() + 1e-9 and found.shares[:-1].sum() < 0.9)).alias("explained"),
    )


_TREE = """, e AS (SELECT leaf AS a, grp AS b FROM taxonomy UNION SELECT grp, 'root' FROM taxonomy),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (SELECT DISTINCT a AS s, a AS t, 0 AS d FROM u UNION SELECT w.s, u.b, w.d + 1 FROM walk w JOIN u ON w.t = u.a WHERE w.d < 4),
sp AS (SELECT s, t, min(d) AS d FROM walk GROUP BY s, t) """


@query(
    "closeness",
    v.with_views(
        "taxonomy", _TREE + "SELECT s AS node, round((count(*) - 1) / sum(d), 6) AS closeness FROM sp GROUP BY s", recursive=True
    ),
)
def _(spark, folder):
    tree = v.taxonomy(spark, folder)
    return features.closeness(tree, "leaf", "grp").select("node", F.round("closeness", 6).alias("closeness"))


@query(
    "closeness_graph",
    """WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
         UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + 1) % 25 FROM nation),
       u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
       walk AS (SELECT DISTINCT a AS s, a AS t, 0 AS d FROM u UNION SELECT w.s, u.b, w.d + 1 FROM walk w JOIN u ON w.t = u.a WHERE w.d < 12),
       sp AS (SELECT s, t, min(d) AS d FROM walk GROUP BY s, t), n AS (SELECT count(DISTINCT a) AS n FROM u)
       SELECT s AS node, count(*) AS reach, CAST(sum(d) AS BIGINT) AS distances,
         round((count(*) - 1) / sum(d) * (count(*) - 1) / (any_value(n) - 1), 9) AS closeness FROM sp, n GROUP BY s""",
)
def _(spark, folder):
    """Suppliers on nations, nations on regions and in a ring: a graph with cycles, small enough to be counted exactly."""
    supplier, nation = v.table(spark, folder, "supplier"), v.table(spark, folder, "nation")
    tag = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    edges = supplier.select(tag("s", F.col("s_suppkey")).alias("src"), tag("n", F.col("s_nationkey")).alias("dst"))
    edges = edges.union(nation.select(tag("n", F.col("n_nationkey")), tag("r", F.col("n_regionkey"))))
    edges = edges.union(nation.select(tag("n", F.col("n_nationkey")), tag("n", (F.col("n_nationkey") + 1) % 25)))
    return graphs.closeness_edges(edges, lg_k=16).withColumn("closeness", F.round("closeness", 9))


@query(
    "closeness_added",
    v.with_views(
        "taxonomy",
        """, known AS (SELECT * FROM taxonomy WHERE leaf < 'NATION_17'), cand AS (SELECT leaf, grp FROM taxonomy),
           t AS (SELECT c.leaf AS cand, k.leaf, k.grp FROM cand c, known k UNION SELECT leaf, leaf, grp FROM cand),
           e AS (SELECT cand, leaf AS a, grp AS b FROM t UNION SELECT cand, grp, 'root' FROM t),
           u AS (SELECT cand, a, b FROM e UNION SELECT cand, b, a FROM e),
           walk AS (SELECT DISTINCT cand, cand AS t, 0 AS d FROM u UNION SELECT w.cand, u.b, w.d + 1 FROM walk w JOIN u ON w.cand = u.cand AND w.t = u.a WHERE w.d < 4),
           sp AS (SELECT cand, t, min(d) AS d FROM walk GROUP BY cand, t)
           SELECT cand AS node, round((count(*) - 1) / sum(d), 6) AS closeness FROM sp GROUP BY cand""",
        recursive=True,
    ),
)
def _(spark, folder):
    tree = v.taxonomy(spark, folder)
    added = features.closeness_when_added(tree.where("leaf < 'NATION_17'"), tree, "leaf", "grp")
    return added.select("node", F.round("closeness", 6).alias("closeness"))
