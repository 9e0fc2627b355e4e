"""Composite dataflows (section 2.13)."""

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.functions.text import parse_list
from windowlark.operators import knn, labels
from windowlark.operators.aggregates import count_by
from windowlark.plans import reports, training
from windowlark.plans import views as v
from windowlark.session import materialize


@query(
    "neighbor_table",
    v.with_views(
        "clips track_meta",
        """, j AS (SELECT clips.stem, track_type, start_time, primary_label, prediction, embedding, vec_id,
                row_number() OVER (ORDER BY clips.stem, track_type, start_time, vec_id) AS id FROM clips JOIN track_meta ON clips.stem = track_meta.stem),
           p AS (SELECT a.id, b.id AS neighbor_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM j a, j b),
           e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor_id) - 1 AS pos FROM p QUALIFY pos < 5)
           SELECT j.id, vec_id, primary_label, prediction, CAST(pos AS INTEGER) AS pos, neighbor_id, round(d, 6) AS distance FROM e JOIN j ON e.id = j.id""",
    ),
)
def _(spark, folder):
    table = reports.build_neighbor_table(
        v.clips(spark, folder).drop("embedding"),
        v.clips(spark, folder).select("vec_id", "embedding"),
        v.track_meta(spark, folder),
        ["vec_id"],
        "stem",
        ["stem", "track_type", "start_time", "vec_id"],
        "embedding",
        k=5,
    )
    edges = knn.edges_long(table)
    out = table.select("id", "vec_id", "primary_label", "prediction").join(edges, "id")
    return out.withColumn("distance", F.round("distance", 6))


@query(
    "best_window_subset",
    v.with_views(
        "clips",
        """, b AS (SELECT * FROM clips WHERE species IN (2, 5, 7) QUALIFY row_number() OVER (PARTITION BY stem, species ORDER BY probability DESC, vec_id) = 1),
           n AS (SELECT *, row_number() OVER (ORDER BY stem, species) AS id FROM b),
           p AS (SELECT a.id, c.id AS neighbor_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS d FROM n a, n c),
           e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor_id) AS pos FROM p QUALIFY pos <= 20)
           SELECT n.id, vec_id, string_agg(CAST(neighbor_id AS VARCHAR), ',' ORDER BY pos) AS neighbors FROM n JOIN e ON n.id = e.id GROUP BY n.id, vec_id""",
    ),
)
def _(spark, folder):
    chosen = v.clips(spark, folder).where(F.col("species").isin(2, 5, 7))
    subset = reports.best_window_subset(chosen, ["stem", "species"], [F.desc("probability"), F.asc("vec_id")], ["stem", "species"], "embedding", k=20)
    return subset.select("id", "vec_id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query(
    "duration_profile",
    v.with_views(
        "durations",
        """SELECT species, count(*) AS n, round(sum(duration) / 3600, 6) AS hours, round(avg(duration), 4) AS mean_sec, min(duration) AS min_sec, max(duration) AS max_sec,
           count(*) FILTER (WHERE duration BETWEEN 29 AND 31) AS n_half_minute, count(*) FILTER (WHERE duration < 5) AS n_short FROM durations GROUP BY species""",
    ),
)
def _(spark, folder):
    profile = reports.duration_profile(v.durations(spark, folder), "species")
    return profile.withColumns({"hours": F.round("hours", 6), "mean_sec": F.round("mean_sec", 4)})


_REP = """, h AS (SELECT stem, track_type, count(*) AS n FROM {0} WHERE track_type <> 'original' AND species = prediction GROUP BY 1, 2),
rep AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY stem ORDER BY n DESC, track_type) = 1)"""


@query("representative_source", v.with_views("clips", _REP.format("clips") + " SELECT stem, track_type, n FROM rep"))
def _(spark, folder):
    return labels.representative_source(v.clips(spark, folder), "stem", "track_type", "species", "prediction")


@query(
    "noise_negatives",
    v.with_views(
        "clips",
        """, e AS (SELECT vec_id, c - 1 AS "index", CAST(embedding[c] AS DOUBLE) AS x FROM clips, (VALUES (11), (13), (21), (41)) t(c))
           SELECT vec_id, CAST("index" AS BIGINT) AS "index", 'no_call' AS species, round(1 / (1 + exp(-x)), 6) AS probability FROM e
           QUALIFY row_number() OVER (PARTITION BY "index" ORDER BY x DESC, vec_id) <= 25""",
    ),
)
def _(spark, folder):
    negatives = labels.noise_negatives(v.clips(spark, folder), "embedding", [10, 12, 20, 40], ["vec_id"], n=25)
    return negatives.withColumn("probability", F.round("probability", 6))


@query(
    "noise_above",
    v.with_views(
        "clips",
        """, e AS (SELECT vec_id, c - 1 AS "index", CAST(embedding[c] AS DOUBLE) AS x FROM clips, (VALUES (11), (13), (21), (41)) t(c))
           SELECT vec_id, CAST("index" AS BIGINT) AS "index", 'no_call' AS species, round(1 / (1 + exp(-x)), 6) AS probability FROM e WHERE 1 / (1 + exp(-x)) > 0.53""",
    ),
)
def _(spark, folder):
    negatives = labels.noise_negatives(v.clips(spark, folder), "embedding", [10, 12, 20, 40], ["vec_id"], threshold=0.53)
    return negatives.withColumn("probability", F.round("probability", 6))


@query(
    "underrepresented",
    v.with_views(
        "clips", "SELECT vec_id, prediction FROM clips WHERE prediction IN (SELECT prediction FROM clips GROUP BY prediction HAVING count(*) < 50)"
    ),
)
def _(spark, folder):
    return labels.underrepresented(v.clips(spark, folder).select("vec_id", "prediction"), "prediction")


@query(
    "adaptive_threshold",
    v.with_views(
        "clips",
        """, c AS (SELECT species, count(*) AS n FROM clips GROUP BY species)
           SELECT vec_id, clips.species, probability FROM clips JOIN c ON clips.species = c.species WHERE probability > CASE WHEN n < 48 THEN 0.05 ELSE 0.4 END""",
    ),
)
def _(spark, folder):
    clips = v.clips(spark, folder).select("vec_id", "species", "probability")
    return labels.adaptive_threshold(clips, "species", "probability", min_count=48)


_LABELS = """, labels_ AS (SELECT regexp_extract(filename, 'XC(\\d+)', 1) AS xc_id, primary_label,
  list_distinct(list_concat([primary_label], CASE WHEN secondary_labels = '[]' THEN [] ELSE string_split(replace(replace(secondary_labels, '[''', ''), ''']', ''), ''', ''') END)) AS metadata_species FROM track_files)"""


def _meta(spark, folder):
    return training.track_labels(v.track_files(spark, folder))


def _joined(column):
    return F.array_join(F.array_sort(column), ",").alias(column)


@query(
    "training_v2",
    v.with_views(
        "tracks track_files",
        _LABELS
        + """, a AS (SELECT *, CAST(FLOOR(start_time / 5) AS BIGINT) AS seq_id FROM tracks WHERE start_time % 10 = 0),
           o AS (SELECT DISTINCT stem, seq_id, embedding FROM a WHERE track_type = 'original'),
           s AS (SELECT stem, seq_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM o, range(1, 65) t(i) GROUP BY 1, 2, 3),
           st AS (SELECT stem, seq_id, min(start_time) AS start_time FROM a WHERE track_type = 'original' GROUP BY 1, 2),
           n AS (SELECT *, COALESCE(lead(x) OVER (PARTITION BY stem, i ORDER BY seq_id), x) AS nx, avg(x) OVER (PARTITION BY stem, i) AS tx FROM s),
           p AS (SELECT stem, seq_id, string_agg(prediction, ',' ORDER BY probability DESC, prediction DESC) AS predicted, string_agg(CAST(probability AS VARCHAR), ',' ORDER BY probability DESC, prediction DESC) AS probs
                 FROM a WHERE prediction <> 'no_call' AND probability > 0.5 GROUP BY 1, 2)
           SELECT n.stem, st.start_time, CAST(i - 1 AS INTEGER) AS dim, predicted, probs, array_to_string(list_sort(metadata_species), ',') AS metadata_species,
                  round(x, 6) + 0.0 AS x, round(nx, 6) + 0.0 AS nx, round(tx, 6) + 0.0 AS tx
           FROM n JOIN st ON n.stem = st.stem AND n.seq_id = st.seq_id JOIN p ON n.stem = p.stem AND n.seq_id = p.seq_id JOIN labels_ ON regexp_extract(n.stem, 'XC(\\d+)', 1) = xc_id""",
    ),
)
def _(spark, folder):
    out = training.training_v2(v.tracks(spark, folder), _meta(spark, folder))
    probs = F.array_join(F.col("predicted_species_prob").cast("array<string>"), ",")
    rows = out.select(
        "stem", "start_time", F.array_join("predicted_species", ",").alias("predicted"), probs.alias("probs"), _joined("metadata_species"),
        F.posexplode(F.arrays_zip("embedding", "next_embedding", "track_embedding")).alias("dim", "z"),
    )
    return rows.select(
        "stem", "start_time", "dim", "predicted", "probs", "metadata_species",
        F.round("z.embedding", 6).alias("x"), F.round("z.next_embedding", 6).alias("nx"), F.round("z.track_embedding", 6).alias("tx"),
    )


_V5 = (
    _LABELS
    + """, a AS (SELECT *, CAST(FLOOR(start_time / 5) AS BIGINT) AS seq_id FROM tracks WHERE start_time % 5 IN (0, 3)),
o AS (SELECT stem, seq_id, min(start_time) AS start_time FROM a WHERE track_type = 'original' GROUP BY 1, 2),
c AS (SELECT stem, seq_id, list(DISTINCT prediction) AS p FROM a WHERE prediction <> 'no_call' AND probability > 0.7 GROUP BY 1, 2),
j AS (SELECT COALESCE(o.stem, c.stem) AS stem, COALESCE(o.seq_id, c.seq_id) AS seq_id, start_time, COALESCE(p, ['no_call']) AS p FROM o FULL JOIN c ON o.stem = c.stem AND o.seq_id = c.seq_id),
b AS (SELECT j.*, primary_label, metadata_species FROM j JOIN labels_ ON regexp_extract(stem, 'XC(\\d+)', 1) = xc_id)"""
)


@query(
    "training_v5_base",
    v.with_views(
        "tracks track_files",
        _V5
        + """ SELECT stem, seq_id, start_time, primary_label, array_to_string(list_sort(metadata_species), ',') AS metadata_species, array_to_string(list_sort(p), ',') AS predicted_species FROM b""",
    ),
)
def _(spark, folder):
    base = training.training_v5_base(v.tracks(spark, folder), _meta(spark, folder))
    return base.select("stem", "seq_id", "start_time", "primary_label", _joined("metadata_species"), _joined("predicted_species"))


@query(
    "restrict_labels",
    v.with_views(
        "tracks track_files",
        _V5
        + """, co AS (SELECT primary_label, list(DISTINCT m) AS together FROM (SELECT primary_label, unnest(metadata_species) AS m FROM b) GROUP BY 1),
           k AS (SELECT b.*, list_intersect(p, list_concat(together, ['no_call'])) AS kept FROM b JOIN co ON b.primary_label = co.primary_label),
           f AS (SELECT *, CASE WHEN len(kept) = 0 THEN [primary_label] ELSE kept END AS filled FROM k)
           SELECT stem, seq_id, array_to_string(list_sort(list_filter(filled, lambda x: x <> 'no_call')), ',') AS predicted_species FROM f""",
    ),
)
def _(spark, folder):
    base = materialize(training.training_v5_base(v.tracks(spark, folder), _meta(spark, folder)))
    return training.restrict_labels(base, base).select("stem", "seq_id", _joined("predicted_species"))


_V6 = (
    _LABELS
    + """, a AS (SELECT *, CAST(FLOOR(start_time / 5) AS BIGINT) AS seq_id FROM tracks WHERE start_time % 5 IN (0, 3)),
f AS (SELECT stem, track_type, seq_id, min(start_time) AS start_time, max(probability) AS probability, flatten(list(CAST(embedding AS DOUBLE[]) ORDER BY start_time)) AS emb,
  list(CAST(prediction_vec AS DOUBLE[]) ORDER BY start_time) AS pv FROM a GROUP BY 1, 2, 3 HAVING count(*) = 2),
h AS (SELECT stem, track_type, count(*) AS n FROM a JOIN labels_ ON regexp_extract(stem, 'XC(\\d+)', 1) = xc_id WHERE track_type <> 'original' AND primary_label = prediction GROUP BY 1, 2),
ok AS (SELECT stem, track_type FROM h QUALIFY row_number() OVER (PARTITION BY stem ORDER BY n DESC, track_type) = 1 UNION SELECT stem, 'original' FROM a),
b AS (SELECT f.*, primary_label, metadata_species, COALESCE(lead(emb) OVER (PARTITION BY f.stem, f.track_type ORDER BY seq_id), emb) AS nxt
  FROM f JOIN ok ON f.stem = ok.stem AND f.track_type = ok.track_type JOIN labels_ ON regexp_extract(f.stem, 'XC(\\d+)', 1) = xc_id)"""
)
_CALLS = """, cnt AS (SELECT primary_label FROM b WHERE probability > 0.5 GROUP BY 1 HAVING count(*) > {0}),
calls AS (SELECT stem, start_time, emb, CASE WHEN probability > CASE WHEN primary_label IN (SELECT primary_label FROM cnt) THEN 0.5 ELSE 0.1 END THEN primary_label ELSE 'no_call' END AS species
  FROM b WHERE track_type <> 'original')"""


@query(
    "training_v6",
    v.with_views(
        "tracks track_files",
        _V6
        + """, t AS (SELECT stem, track_type, i, avg(emb[i]) AS m FROM (SELECT DISTINCT stem, track_type, emb FROM b), range(1, 129) r(i) GROUP BY 1, 2, 3)
           SELECT b.stem, b.track_type, start_time, primary_label, array_to_string(list_sort(metadata_species), ',') AS metadata_species, probability,
                  CAST(t.i - 1 AS INTEGER) AS dim, round(emb[t.i], 6) + 0.0 AS x, round(nxt[t.i], 6) + 0.0 AS nx, round(m, 6) + 0.0 AS tx
           FROM b JOIN t ON b.stem = t.stem AND b.track_type = t.track_type""",
    ),
)
def _(spark, folder):
    out = training.training_v6(v.tracks(spark, folder), _meta(spark, folder))
    rows = out.select(
        "stem", "track_type", "start_time", "primary_label", _joined("metadata_species"), "probability",
        F.posexplode(F.arrays_zip("embedding", "next_embedding", "track_embedding")).alias("dim", "z"),
    )
    return rows.select(
        "stem", "track_type", "start_time", "primary_label", "metadata_species", "probability", "dim",
        F.round("z.embedding", 6).alias("x"), F.round("z.next_embedding", 6).alias("nx"), F.round("z.track_embedding", 6).alias("tx"),
    )


@query(
    "training_v7",
    v.with_views(
        "tracks track_files",
        _V6
        + _CALLS.format(10)
        + """ SELECT b.stem, b.track_type, b.start_time, species, CAST(i - 1 AS INTEGER) AS dim, round((pv[1][i] + pv[2][i]) / 2, 6) + 0.0 AS score
           FROM b JOIN calls c ON b.stem = c.stem AND b.start_time = c.start_time, range(1, 65) r(i)""",
    ),
)
def _(spark, folder):
    base = materialize(training.training_v7_base(v.tracks(spark, folder), _meta(spark, folder)))
    rows = training.training_v7(base).select("stem", "track_type", "start_time", "species", F.posexplode("prediction_vec").alias("dim", "x"))
    return rows.select("stem", "track_type", "start_time", "species", "dim", F.round("x", 6).alias("score"))


@query(
    "relabel_v6",
    v.with_views(
        "tracks track_files",
        _V6
        + _CALLS.format(0)
        + """, r AS (SELECT stem, start_time, species, emb FROM calls UNION ALL SELECT b.stem, b.start_time, species, b.emb FROM b JOIN calls c ON b.stem = c.stem AND b.start_time = c.start_time WHERE track_type = 'original')
           SELECT stem, start_time, species, round(emb[1], 6) + 0.0 AS x0, count(*) OVER (PARTITION BY species) AS species_count FROM r QUALIFY count(*) OVER (PARTITION BY species) > 1""",
    ),
)
def _(spark, folder):
    base = materialize(training.training_v6(v.tracks(spark, folder), _meta(spark, folder)))
    first = F.round(F.get("embedding", F.lit(0)), 6).alias("x0")
    return training.relabel_v6(base).select("stem", "start_time", "species", first, "species_count")


@query("training_v1")
def _(spark, folder):
    out = training.training_v1(v.tracks(spark, folder), _meta(spark, folder), "prediction_vec", [10, 12, 20, 40], [20, 40], ["vec_id"])
    return count_by(out.select(F.array_join(F.array_sort("species"), ",").alias("labels")), ["labels"])


# which rows are blended is drawn by hash, so the checks count rows: 20 rows a class meet up to 20 noise rows, 20 are kept
_NOISE = """, low AS (SELECT stem FROM tracks WHERE start_time % 3 = 0 AND probability < 0.01 ORDER BY probability, stem, vec_id LIMIT 1000),
z AS (SELECT least(20, count(DISTINCT stem)) AS m FROM low)"""


@query(
    "training_v3",
    v.with_views(
        "tracks track_files",
        _LABELS
        + """, o AS (SELECT DISTINCT stem, CAST(FLOOR(start_time / 5) AS BIGINT) AS seq_id FROM tracks WHERE start_time % 10 = 0 AND track_type = 'original'),
           p AS (SELECT DISTINCT stem, CAST(FLOOR(start_time / 5) AS BIGINT) AS seq_id FROM tracks WHERE start_time % 10 = 0 AND prediction <> 'no_call' AND probability > 0.5),
           g AS (SELECT primary_label, count(*) AS n FROM o JOIN p ON o.stem = p.stem AND o.seq_id = p.seq_id JOIN labels_ ON regexp_extract(o.stem, 'XC(\\d+)', 1) = xc_id GROUP BY 1)"""
        + _NOISE
        + " SELECT primary_label, CAST(n + least(20, least(20, n) * m) AS BIGINT) AS n FROM g, z",
    ),
)
def _(spark, folder):
    out = training.training_v3(v.tracks(spark, folder), _meta(spark, folder), ["stem", "vec_id"])
    return count_by(out.select(F.get("metadata_species", F.lit(0)).alias("primary_label")), ["primary_label"])


@query(
    "training_v5",
    v.with_views(
        "tracks track_files",
        _V5
        + _NOISE
        + """, g AS (SELECT primary_label, count(*) AS n, count(*) FILTER (WHERE start_time IS NOT NULL AND p[1] <> 'no_call') AS called FROM b GROUP BY 1)
           SELECT primary_label, CAST(n + least(20, least(20, called) * m) AS BIGINT) AS n FROM g, z""",
    ),
)
def _(spark, folder):
    out = training.training_v5(v.tracks(spark, folder), _meta(spark, folder), ["stem", "vec_id"])
    return count_by(out, ["primary_label"])


@query(
    "augment_v6",
    v.with_views(
        "tracks track_files",
        _V6
        + """, g AS (SELECT primary_label, count(*) AS n FROM b GROUP BY 1), z AS (SELECT least(20, count(*)) AS m FROM b)
           SELECT primary_label, CAST(n + least(20, least(20, n) * m) AS BIGINT) AS n FROM g, z""",
    ),
)
def _(spark, folder):
    base = materialize(training.training_v6(v.tracks(spark, folder), _meta(spark, folder)))
    return count_by(training.augment_v6(base), ["primary_label"])


@query(
    "binary_set",
    v.with_views(
        "tracks",
        """, g AS (SELECT species, count(*) AS n FROM tracks GROUP BY 1),
           u AS (SELECT 'call' AS species, vec_id FROM tracks JOIN g USING (species) WHERE n >= 100 AND probability > 0.5
                 UNION ALL SELECT 'no_call', vec_id FROM tracks WHERE 1 / (1 + exp(-CAST(prediction_vec[11] AS DOUBLE))) > 0.53
                 UNION ALL SELECT 'no_call', vec_id FROM tracks WHERE 1 / (1 + exp(-CAST(prediction_vec[13] AS DOUBLE))) > 0.53
                 UNION ALL SELECT 'no_call', vec_id FROM tracks WHERE probability < 0.1
                 UNION ALL SELECT 'no_call', vec_id FROM tracks WHERE prediction = 'no_call' AND track_type = 'original')
           SELECT u.species, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE)), 5) AS x0 FROM u JOIN tracks USING (vec_id) GROUP BY u.species""",
    ),
)
def _(spark, folder):
    tracks = v.tracks(spark, folder)
    noise = labels.noise_negatives(tracks, "prediction_vec", [10, 12], ["vec_id", "embedding"], threshold=0.53)
    background = tracks.where("prediction = 'no_call' and track_type = 'original'")
    both = training.build_binary(tracks, noise, background, ["vec_id"], fraction=1.0)
    return both.groupBy("species").agg(F.count("*").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 5).alias("x0"))


@query(
    "wide_matrix",
    v.with_views(
        "clips",
        "SELECT concat_ws('_', CAST(stem AS VARCHAR), CAST(start_time AS VARCHAR), track_type) AS track_id, species, "
        + ", ".join(f"embedding[{i + 1}] AS embedding{i}" for i in range(64))
        + " FROM clips WHERE probability > 0.5",
    ),
)
def _(spark, folder):
    return training.wide_matrix(v.clips(spark, folder), ["stem", "start_time", "track_type"], 64)


@query(
    "background_table",
    v.with_views(
        "tracks",
        "SELECT concat_ws('_', stem, CAST(vec_id AS VARCHAR)) AS row_id, "
        + ", ".join(f"round(CAST(prediction_vec[{i + 1}] AS DOUBLE), 6) + 0.0 AS s{i}" for i in range(10))
        + " FROM tracks",
    ),
)
def _(spark, folder):
    scores = v.tracks(spark, folder).withColumn("p", F.col("prediction_vec").cast("array<double>"))
    return training.background_table(scores, "stem", "vec_id", "p", [f"s{i}" for i in range(10)]).drop("embedding")


@query(
    "label_profile",
    v.with_views(
        "track_files",
        _LABELS + ", e AS (SELECT xc_id, unnest(metadata_species) AS label FROM labels_) SELECT label, count(*) AS n FROM e GROUP BY label",
    ),
)
def _(spark, folder):
    files = v.track_files(spark, folder).withColumn("secondary", parse_list("secondary_labels"))
    return reports.label_profile(files)[0]


@query(
    "multi_label_files",
    v.with_views(
        "track_files",
        _LABELS + " SELECT xc_id, array_to_string(list_sort(metadata_species), ',') AS labels FROM labels_ WHERE len(metadata_species) > 1",
    ),
)
def _(spark, folder):
    files = v.track_files(spark, folder).withColumn("secondary", parse_list("secondary_labels"))
    return reports.label_profile(files)[1].select("xc_id", F.array_join("labels", ",").alias("labels"))


@query(
    "fixture_subset",
    v.with_views(
        "vecs",
        """, c AS (SELECT truth FROM vecs GROUP BY truth ORDER BY count(*), truth LIMIT 3)
           SELECT id, truth, guess FROM vecs WHERE truth IN (SELECT truth FROM c) QUALIFY row_number() OVER (PARTITION BY truth ORDER BY id) <= 9""",
    ),
)
def _(spark, folder):
    return reports.fixture_subset(v.vecs(spark, folder).select("id", "truth", "guess"), "truth", ["id"], classes=3, rows=9)


@query(
    "best_scored_window",
    v.with_views(
        "clips",
        """SELECT stem, CASE WHEN probability < 0.3 THEN 0 ELSE 1 END AS is_call, vec_id, round(CAST(list_max(embedding) AS DOUBLE), 6) + 0.0 AS max_score FROM clips
           QUALIFY rank() OVER (PARTITION BY stem, CASE WHEN probability < 0.3 THEN 0 ELSE 1 END ORDER BY list_max(embedding) DESC) = 1""",
    ),
)
def _(spark, folder):
    clips = v.clips(spark, folder).withColumn("is_call", F.when(F.col("probability") < 0.3, 0).otherwise(1))
    best = labels.best_scored_window(clips, ["stem", "is_call"], "embedding")
    return best.select("stem", "is_call", "vec_id", F.round(F.col("max_score").cast("double"), 6).alias("max_score"))


@query(
    "taxonomy_overlap",
    v.with_views(
        "taxonomy",
        "SELECT count(*) AS n, count(*) FILTER (WHERE grp <> 'ASIA') AS shared, round(count(*) FILTER (WHERE grp <> 'ASIA') / count(*), 6) AS share FROM taxonomy",
    ),
)
def _(spark, folder):
    from windowlark.operators.sets import overlap_share

    tree = v.taxonomy(spark, folder)
    return overlap_share(tree, tree.where("grp <> 'ASIA'"), "leaf").withColumn("share", F.round("share", 6))
