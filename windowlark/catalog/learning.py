"""Learning and evaluation on tables (section 2.12)."""

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.functions.vector import sigmoid
from windowlark.learn import metrics, models, prepare
from windowlark.operators.aggregates import collect_distinct, label_prior
from windowlark.operators.features import stack_scores
from windowlark.plans import views as v

_ROUND = ("precision", "recall", "f1")


@query(
    "encode_labels",
    "SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS code FROM part",
)
def _(spark, folder):
    return prepare.encode_labels(v.table(spark, folder, "part").select("p_partkey", "p_type"), "p_type")


@query(
    "binarize_labels",
    v.with_views(
        "tags",
        """, d AS (SELECT DISTINCT doc FROM tags)
           SELECT d.doc, CAST(c AS INTEGER) AS class, CAST(CASE WHEN tags.tag IS NULL THEN 0 ELSE 1 END AS INTEGER) AS flag
           FROM d CROSS JOIN range(0, 8) t(c) LEFT JOIN tags ON tags.doc = d.doc AND tags.tag = concat('t', c)""",
    ),
)
def _(spark, folder):
    sets = collect_distinct(v.tags(spark, folder), ["doc"], "tag", "tags")
    binary = prepare.binarize_labels(sets, "tags", [f"t{i}" for i in range(8)])
    return binary.select("doc", F.posexplode("binary").alias("class", "flag"))


@query(
    "balanced_weight",
    """SELECT event_id, event_type, round(count(*) OVER () / ((SELECT count(DISTINCT event_type) FROM events) * count(*) OVER (PARTITION BY event_type)), 6) AS weight FROM events""",
)
def _(spark, folder):
    events = v.table(spark, folder, "events").select("event_id", "event_type")
    return prepare.balanced_weight(events, "event_type").withColumn("weight", F.round("weight", 6))


_MACRO = """, l AS (SELECT truth AS label FROM {0} UNION SELECT guess FROM {0}),
c AS (SELECT label, (SELECT count(*) FROM {0} WHERE truth = label) AS support, (SELECT count(*) FROM {0} WHERE guess = label) AS predicted,
  (SELECT count(*) FROM {0} WHERE truth = label AND guess = label) AS tp FROM l),
m AS (SELECT label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r,
  2 * tp / (predicted + support) AS f FROM c) """


@query(
    "class_metrics",
    v.with_views("vecs", _MACRO.format("vecs") + "SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM m"),
)
def _(spark, folder):
    per_class = metrics.class_metrics(v.vecs(spark, folder), "truth", "guess")
    return per_class.withColumns({c: F.round(c, 6) for c in _ROUND})


@query(
    "macro_metrics",
    v.with_views(
        "vecs",
        _MACRO.format("vecs")
        + """SELECT (SELECT round(avg(CAST(truth = guess AS INTEGER)), 6) FROM vecs) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM m""",
    ),
)
def _(spark, folder):
    report = metrics.classification_metrics(v.vecs(spark, folder), "truth", "guess")
    return report.withColumns({c: F.round(c, 6) for c in ("accuracy", *_ROUND)})


@query(
    "multilabel_metrics",
    v.with_views(
        "tags",
        """, pred AS (SELECT doc, CASE WHEN tag = 't7' THEN 't8' ELSE tag END AS tag FROM tags WHERE doc % 3 > 0 OR tag <> 't1' GROUP BY 1, 2),
           docs AS (SELECT DISTINCT doc FROM tags),
           u AS (SELECT t.doc AS td, p.doc AS pd, COALESCE(t.tag, p.tag) AS label, COALESCE(t.doc, p.doc) AS doc FROM tags t FULL JOIN pred p ON t.doc = p.doc AND t.tag = p.tag),
           c AS (SELECT label, count(*) FILTER (WHERE td IS NOT NULL AND pd IS NOT NULL) AS tp, count(td) AS support, count(pd) AS predicted FROM u GROUP BY label),
           m AS (SELECT CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r, 2 * tp / (predicted + support) AS f FROM c),
           s AS (SELECT doc, bool_and(td IS NOT NULL AND pd IS NOT NULL) AS same FROM u GROUP BY doc)
           SELECT (SELECT round(avg(CAST(same AS INTEGER)), 6) FROM s) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1 FROM m""",
    ),
)
def _(spark, folder):
    sets = collect_distinct(v.tags(spark, folder), ["doc"], "tag", "truth")
    swapped = F.transform("truth", lambda t: F.when(t == "t7", "t8").otherwise(t))
    kept = F.when(F.col("doc") % 3 > 0, swapped).otherwise(F.filter(swapped, lambda t: t != "t1"))
    report = metrics.multilabel_metrics(sets.withColumn("pred", F.array_distinct(kept)), "truth", "pred")
    return report.withColumns({c: F.round(c, 6) for c in ("accuracy", *_ROUND)})


@query(
    "average_precision",
    """WITH g AS (SELECT event_type, value AS score, count(*) AS n, count(*) FILTER (WHERE user_id % 3 = 0) AS pos FROM events GROUP BY 1, 2),
       c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (PARTITION BY event_type ORDER BY score DESC))
       SELECT event_type, round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM c GROUP BY event_type""",
)
def _(spark, folder):
    events = v.table(spark, folder, "events").withColumn("hit", (F.col("user_id") % 3 == 0).cast("int"))
    report = metrics.average_precision(events, "value", "hit", ["event_type"])
    return report.withColumn("average_precision", F.round("average_precision", 6))


@query(
    "stack_scores",
    """SELECT vec_id, CAST(i - 1 AS INTEGER) AS slot, round(CAST(CASE WHEN i <= 4 THEN embedding[i] ELSE embedding[i + 6] END AS DOUBLE), 6) + 0.0 AS x
       FROM embeddings, range(1, 9) t(i)""",
)
def _(spark, folder):
    e = v.table(spark, folder, "embeddings")
    first = e.select("vec_id", F.slice("embedding", 1, 4).alias("a"))
    second = e.select("vec_id", F.slice("embedding", 11, 4).alias("b"))
    stacked = stack_scores([(first, "a"), (second, "b")], ["vec_id"])
    return stacked.select("vec_id", F.posexplode("stacked").alias("slot", "x")).withColumn("x", F.round("x", 6))


@query(
    "prior_scaled",
    v.with_views(
        "tags",
        """, prior AS (SELECT tag AS label, count(*) / (SELECT count(*) FROM tags) AS share FROM tags GROUP BY tag)
           SELECT vec_id, prior.label AS label, round(share / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 6) AS scaled FROM embeddings, prior""",
    ),
)
def _(spark, folder):
    prior = label_prior(collect_distinct(v.tags(spark, folder), ["doc"], "tag", "tags"), "tags")
    scores = v.table(spark, folder, "embeddings").select("vec_id", sigmoid(F.get("embedding", F.lit(0))).alias("score"))
    return prepare.prior_scaled(scores, "score", prior, ["vec_id"]).withColumn("scaled", F.round("scaled", 6))


@query("logistic_report")
def _(spark, folder):
    rows = v.table(spark, folder, "embeddings").withColumn("truth", F.col("label").cast("string"))
    model = models.train_logistic(rows, "embedding", "truth", max_iter=20, reg=0.01)
    scored = models.score_vectors(rows, model, "embedding", "truth")
    report = metrics.class_metrics(scored, "truth", "prediction")
    return report.withColumns({c: F.round(c, 6) for c in _ROUND})


@query("tree_report")
def _(spark, folder):
    rows = v.table(spark, folder, "embeddings").withColumn("truth", F.col("label").cast("string"))
    model = models.train_tree(rows, "embedding", "truth")
    scored = models.score_vectors(rows, model, "embedding", "truth")
    report = metrics.class_metrics(scored, "truth", "prediction")
    return report.withColumns({c: F.round(c, 6) for c in _ROUND})
