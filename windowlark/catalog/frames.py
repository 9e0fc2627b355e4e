"""Windows in time (section 2.9)."""

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.functions.vector import energy
from windowlark.operators import frames as fr
from windowlark.operators import series
from windowlark.operators.labels import loudest_channel
from windowlark.plans import views as v

ENTRIES = "SELECT *, CAST(i - 1 AS BIGINT) AS dim FROM embeddings, range(1, 65) t(i)"


@query(
    "slice_windows",
    """WITH w AS (SELECT vec_id, embedding, CAST(w AS BIGINT) AS "index", w * 10 AS off FROM embeddings, range(0, 6) t(w))
       SELECT vec_id, "index", off / 5 AS start, CAST("index" * 3 AS DOUBLE) AS ref_time, CAST(p AS INTEGER) AS pos,
              COALESCE(CAST(embedding[off + p + 1] AS DOUBLE), 0.0) AS x FROM w, range(0, 15) s(p)""",
)
def _(spark, folder):
    series = v.table(spark, folder, "embeddings")
    cut = fr.slice_windows(series, "embedding", rate=5, keep=["vec_id"], seconds=3, step=2)
    return cut.select("vec_id", "index", "start", "ref_time", F.posexplode("window").alias("pos", "x"))


@query(
    "slice_windows_long",
    """WITH w AS (SELECT vec_id, embedding, CAST(w AS BIGINT) AS "index", w * 10 AS off FROM embeddings, range(0, 6) t(w))
       SELECT vec_id, "index", off / 5 AS start, CAST("index" * 3 AS DOUBLE) AS ref_time, CAST(p AS INTEGER) AS pos,
              COALESCE(CAST(embedding[off + p + 1] AS DOUBLE), 0.0) AS x FROM w, range(0, 15) s(p)""",
)
def _(spark, folder):
    """The same windows from rows of seven samples each, cut across their borders."""
    chunks = series.chunk_arrays(v.table(spark, folder, "embeddings"), "embedding", ["vec_id"], 7)
    cut = series.slice_windows_long(chunks, ["vec_id"], rate=5, seconds=3, step=2)
    return cut.select("vec_id", "index", "start", "ref_time", F.posexplode("window").alias("pos", "x"))


@query(
    "build_sequences",
    v.with_views(
        "clips",
        """SELECT vec_id, s AS seq_start, start_time - s AS pos FROM clips, range(0, 12, 3) t(s)
           WHERE s + 6 <= 12 AND start_time BETWEEN s AND s + 5""",
    ),
)
def _(spark, folder):
    runs = fr.build_sequences(v.clips(spark, folder), "start_time", F.lit(12), min_duration=6, hop=1)
    return runs.select("vec_id", "seq_start", "pos")


@query(
    "pad_center",
    """SELECT vec_id, CAST(p AS INTEGER) AS pos, CASE WHEN p BETWEEN 13 AND 76 THEN CAST(embedding[p - 12] AS DOUBLE) ELSE 0.0 END AS x
       FROM embeddings, range(0, 90) t(p)""",
)
def _(spark, folder):
    padded = fr.pad_center_noise(v.table(spark, folder, "embeddings"), "embedding", rate=10, key="vec_id", alpha=0)
    return padded.select("vec_id", F.posexplode("padded").alias("pos", "x"))


@query("pad_noise")
def _(spark, folder):
    padded = fr.pad_center_noise(v.table(spark, folder, "embeddings"), "embedding", rate=10, key="vec_id", seed=3)
    return padded.select("vec_id", F.size("padded").alias("n"), F.round(energy("padded"), 6).alias("energy"))


@query(
    "vec_energy",
    f"SELECT vec_id, round(sum(pow(CAST(embedding[i] AS DOUBLE), 2)), 6) AS energy FROM ({ENTRIES}) GROUP BY vec_id",
)
def _(spark, folder):
    return v.table(spark, folder, "embeddings").select("vec_id", F.round(energy("embedding"), 6).alias("energy"))


_TOP = """, e AS (SELECT stem, vec_id, start_time, CAST(i - 1 AS BIGINT) AS "index", CAST(embedding[i] AS DOUBLE) AS x FROM clips, range(1, 65) t(i)),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x {0}, "index") <= 6),
c AS (SELECT stem, "index", count(*) AS n FROM b GROUP BY stem, "index"),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY stem ORDER BY n DESC, "index") <= 3)"""


@query("frequent_top_classes", v.with_views("clips", _TOP.format("DESC") + ' SELECT stem, "index", n FROM k'))
def _(spark, folder):
    return fr.frequent_top_classes(v.clips(spark, folder), ["stem"], "embedding", 3)


@query("frequent_low_classes", v.with_views("clips", _TOP.format("ASC") + ' SELECT stem, "index", n FROM k'))
def _(spark, folder):
    return fr.frequent_top_classes(v.clips(spark, folder), ["stem"], "embedding", 3, largest=False)


@query(
    "rank_predictions",
    v.with_views(
        "clips",
        _TOP.format("DESC")
        + """ SELECT e.vec_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY x DESC, e."index") - 1 AS rank, e."index",
             round(1 / (1 + exp(-x)), 6) AS probability FROM e JOIN k ON e.stem = k.stem AND e."index" = k."index" """,
    ),
)
def _(spark, folder):
    clips = v.clips(spark, folder)
    classes = fr.frequent_top_classes(clips, ["stem"], "embedding", 3)
    ranked = fr.rank_predictions(clips, classes, ["stem"], "embedding", ["vec_id"])
    return ranked.withColumn("probability", F.round("probability", 6))


@query(
    "active_windows",
    v.with_views(
        "clips",
        """SELECT vec_id, start_time * 3.0::DOUBLE AS "offset", round(1 / (1 + exp(-CAST(list_max(embedding) AS DOUBLE))), 6) AS peak FROM clips
           WHERE 1 / (1 + exp(-CAST(list_max(embedding) AS DOUBLE))) > 0.57""",
    ),
)
def _(spark, folder):
    active = fr.active_windows(v.clips(spark, folder), "embedding", 0.57, "start_time", hop=3)
    return active.select("vec_id", "offset", F.round("peak", 6).alias("peak"))


@query(
    "loudest_channel",
    v.with_views(
        "clips",
        """SELECT DISTINCT stem, track_type FROM (SELECT stem, track_type, rank() OVER (PARTITION BY stem ORDER BY energy DESC) AS r FROM clips) WHERE r = 1""",
    ),
)
def _(spark, folder):
    return loudest_channel(v.clips(spark, folder), "stem", "track_type", "energy")


_FRAMES = """, w AS (SELECT *, CAST(FLOOR(start_time / 5) AS BIGINT) AS seq_id FROM clips WHERE start_time % 5 IN (0, 3)),
f AS (SELECT stem, track_type, seq_id, min(start_time) AS start_time, list(CAST(embedding AS DOUBLE[]) ORDER BY start_time) AS z FROM w GROUP BY 1, 2, 3 HAVING count(*) = 2),
g AS (SELECT stem, track_type, seq_id, start_time, flatten(z) AS emb FROM f)"""


@query(
    "frame_vectors",
    v.with_views(
        "clips",
        _FRAMES + " SELECT stem, track_type, seq_id, start_time, CAST(i - 1 AS INTEGER) AS dim, round(emb[i], 6) + 0.0 AS x FROM g, range(1, 129) t(i)",
    ),
)
def _(spark, folder):
    frames = fr.frame_vectors(v.clips(spark, folder), ["stem", "track_type"], "start_time", "embedding")
    rows = frames.select("stem", "track_type", "seq_id", "start_time", F.posexplode("embedding").alias("dim", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query(
    "context_vectors",
    v.with_views(
        "clips",
        _FRAMES
        + """, n AS (SELECT *, COALESCE(lead(emb) OVER (PARTITION BY stem, track_type ORDER BY seq_id), emb) AS nxt FROM g),
           d AS (SELECT DISTINCT stem, track_type, emb FROM g),
           t AS (SELECT stem, track_type, i, avg(emb[i]) AS m FROM d, range(1, 129) t(i) GROUP BY 1, 2, 3)
           SELECT n.stem, n.track_type, seq_id, CAST(t.i - 1 AS INTEGER) AS dim, round(nxt[t.i], 6) + 0.0 AS next_x, round(t.m, 6) + 0.0 AS track_x
           FROM n JOIN t ON n.stem = t.stem AND n.track_type = t.track_type""",
    ),
)
def _(spark, folder):
    by = ["stem", "track_type"]
    frames = fr.frame_vectors(v.clips(spark, folder), by, "start_time", "embedding")
    context = fr.context_vectors(frames, by)
    rows = context.select(*by, "seq_id", F.posexplode(F.arrays_zip("next_embedding", "track_embedding")).alias("dim", "z"))
    return rows.select(
        *by, "seq_id", "dim", F.round("z.next_embedding", 6).alias("next_x"), F.round("z.track_embedding", 6).alias("track_x")
    )


@query(
    "class_series",
    v.with_views(
        "clips",
        _TOP.format("DESC")
        + """ SELECT c.vec_id, c.stem, c.start_time, k."index", round(CAST(c.embedding[k."index" + 1] AS DOUBLE), 6) + 0.0 AS score
             FROM clips c JOIN k ON c.stem = k.stem""",
    ),
)
def _(spark, folder):
    clips = v.clips(spark, folder)
    series = fr.class_series(clips.withColumn("at", F.struct("vec_id", "start_time")), ["stem"], "at", "embedding", 3)
    return series.select("at.vec_id", "stem", "at.start_time", "index", F.round("score", 6).alias("score"))
