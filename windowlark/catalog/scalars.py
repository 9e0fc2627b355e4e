"""Scalar functions (section 2.8)."""

from pyspark.sql import functions as F

from windowlark.catalog import query
from windowlark.functions import text as tx
from windowlark.functions import vector as vec
from windowlark.operators.aggregates import collect_distinct
from windowlark.operators.rows import plan_segments
from windowlark.plans import views as v


@query(
    "str_split",
    v.with_views("durations", "SELECT filename, split_part(filename, '/', 1) AS source, split_part(split_part(filename, '/', 2), '.', 1) AS stem FROM durations"),
)
def _(spark, folder):
    parts = F.split("filename", "/")
    return v.durations(spark, folder).select(
        "filename", F.get(parts, F.lit(0)).alias("source"), F.get(F.split(F.get(parts, F.lit(1)), r"\."), F.lit(0)).alias("stem")
    )


@query(
    "str_regex_extract",
    v.with_views("durations", "SELECT filename, regexp_extract(filename, 'XC(\\d+)', 1) AS xc_id FROM durations"),
)
def _(spark, folder):
    return v.durations(spark, folder).select("filename", tx.track_number("filename").alias("xc_id"))


@query(
    "str_regex_replace",
    v.with_views("durations", "SELECT filename, regexp_replace(filename, '\\.ogg$', '') AS stem FROM durations"),
)
def _(spark, folder):
    return v.durations(spark, folder).select("filename", F.regexp_replace("filename", r"\.ogg$", "").alias("stem"))


@query(
    "str_track_id",
    v.with_views("clips", "SELECT vec_id, concat_ws('_', CAST(stem AS VARCHAR), CAST(start_time AS VARCHAR), track_type) AS track_id FROM clips"),
)
def _(spark, folder):
    return v.clips(spark, folder).select("vec_id", tx.track_id("stem", "start_time", "track_type").alias("track_id"))


@query(
    "str_format",
    v.with_views(
        "clips",
        """SELECT vec_id, format('{}_part{:03d}.wav', stem, start_time) AS part, CASE WHEN track_type = 'original' THEN concat(stem, '.mp3')
           ELSE concat(stem, '_', track_type, '.mp3') END AS mp3, CAST(stem AS VARCHAR) AS stem_back, track_type AS channel_back FROM clips""",
    ),
)
def _(spark, folder):
    clips = v.clips(spark, folder).withColumn("stem", F.col("stem").cast("string"))
    number = F.regexp_extract("track_type", r"(\d+)$", 1).try_cast("int")
    mp3 = F.when(F.col("track_type") == "original", F.concat("stem", F.lit(".mp3"))).otherwise(tx.source_name("stem", number))
    named = clips.select("vec_id", tx.part_name("stem", "start_time").alias("part"), mp3.alias("mp3"))
    stem, channel = tx.split_source("mp3")
    return named.select("*", stem.alias("stem_back"), channel.alias("channel_back"))


@query(
    "parse_list",
    v.with_views("tags", "SELECT doc, tag FROM tags"),
)
def _(spark, folder):
    sets = collect_distinct(v.tags(spark, folder), ["doc"], "tag", "tags")
    printed = F.concat(F.lit("['"), F.array_join("tags", "', '"), F.lit("']"))
    return sets.select("doc", printed.alias("text")).select("doc", F.explode(tx.parse_list("text")).alias("tag"))


@query(
    "parse_vector",
    """SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, CAST(round(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) AS milli FROM embeddings, range(1, 65) t(i)""",
)
def _(spark, folder):
    as_text = F.array_join(F.transform(F.col("embedding").cast("array<double>"), lambda x: x.cast("string")), ",")
    parsed = v.table(spark, folder, "embeddings").select("vec_id", tx.parse_vector(as_text, "double").alias("e"))
    rows = parsed.select("vec_id", F.posexplode("e").alias("dim", "x"))
    return rows.select("vec_id", "dim", F.round(F.col("x") * 1000).cast("bigint").alias("milli"))


@query(
    "sigmoid",
    """SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(1 / (1 + exp(-CAST(embedding[i] AS DOUBLE))), 6) AS p FROM embeddings, range(1, 65) t(i)""",
)
def _(spark, folder):
    scored = v.table(spark, folder, "embeddings").select("vec_id", F.posexplode(vec.sigmoid_vec("embedding")).alias("dim", "x"))
    return scored.select("vec_id", "dim", F.round("x", 6).alias("p"))


@query("log_gap", "SELECT l_orderkey, l_linenumber, round(ln(abs(l_partkey - l_suppkey) + 1), 6) AS gap FROM lineitem")
def _(spark, folder):
    lines = v.table(spark, folder, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", F.round(vec.log_gap("l_partkey", "l_suppkey"), 6).alias("gap"))


_SETS = """, s AS (SELECT doc, list_sort(list(tag)) AS t FROM tags GROUP BY doc)
SELECT doc, array_to_string(list_sort(list_distinct(list_concat(t, ['t3', 'x']))), ',') AS joined,
  array_to_string(list_sort(list_intersect(t, ['t1', 't2', 't3', 't4'])), ',') AS shared,
  array_to_string(list_filter(t, lambda x: x <> 't5'), ',') AS without,
  CAST(len(t) + 1 AS INTEGER) AS longer FROM s"""


@query("array_sets", v.with_views("tags", _SETS))
def _(spark, folder):
    sets = collect_distinct(v.tags(spark, folder), ["doc"], "tag", "t")
    few = F.array(*[F.lit(x) for x in ("t1", "t2", "t3", "t4")])
    joined = F.array_union("t", F.array(F.lit("t3"), F.lit("x")))
    return sets.select(
        "doc",
        F.array_join(F.array_sort(joined), ",").alias("joined"),
        F.array_join(F.array_sort(F.array_intersect("t", few)), ",").alias("shared"),
        F.array_join(F.array_remove("t", "t5"), ",").alias("without"),
        F.size(F.concat("t", F.array(F.lit("t5")))).alias("longer"),
    )


@query(
    "array_reduce",
    """SELECT vec_id, list_max(embedding) AS peak, CAST(len(embedding) AS INTEGER) AS n, list_sort(embedding)[1] AS lowest,
       CAST(len(embedding) * 2 AS INTEGER) AS doubled FROM embeddings""",
)
def _(spark, folder):
    return v.table(spark, folder, "embeddings").select(
        "vec_id",
        F.array_max("embedding").alias("peak"),
        F.size("embedding").alias("n"),
        F.get(F.sort_array("embedding"), F.lit(0)).alias("lowest"),
        F.size(F.flatten(F.array("embedding", "embedding"))).alias("doubled"),
    )


@query(
    "nested_access",
    v.with_views(
        "clips",
        """SELECT stem, start_time, arg_max(prediction, probability) AS first_label, max(probability) AS first_prob, count(*) AS n FROM clips GROUP BY stem, start_time""",
    ),
)
def _(spark, folder):
    # the reader's shape: an array of structs per window, read by position and by field
    packed = v.clips(spark, folder).groupBy("stem", "start_time").agg(
        F.sort_array(F.collect_list(F.struct("probability", "prediction")), asc=False).alias("predictions")
    )
    first = F.get("predictions", F.lit(0))
    return packed.select(
        "stem",
        "start_time",
        first["prediction"].alias("first_label"),
        first["probability"].alias("first_prob"),
        F.size("predictions.prediction").cast("bigint").alias("n"),
    )


@query(
    "nested_build",
    v.with_views("clips", "SELECT vec_id, 'kind' AS k, track_type AS a, CAST(species AS VARCHAR) AS b FROM clips"),
)
def _(spark, folder):
    built = v.clips(spark, folder).select(
        "vec_id",
        F.struct(F.lit("kind").alias("k"), F.array("track_type", F.col("species").cast("string")).alias("values")).alias("s"),
    )
    return built.select("vec_id", "s.k", F.get("s.values", F.lit(0)).alias("a"), F.get("s.values", F.lit(1)).alias("b"))


@query("clip01", "SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 10 - 0.5)) AS clipped FROM events")
def _(spark, folder):
    return v.table(spark, folder, "events").select("event_id", vec.clip01(F.col("value") / 10 - 0.5).alias("clipped"))


@query(
    "duration_parts",
    v.with_views(
        "durations",
        """, h AS (SELECT filename, duration, CASE WHEN duration <= 50 THEN 1 ELSE CAST(pow(2, ceil(log2(duration / 50))) AS BIGINT) END AS parts FROM durations)
           SELECT filename, parts, CAST(i AS BIGINT) AS part, round(duration / parts, 6) AS part_sec,
                  format('{}_part{:03d}.wav', regexp_replace(filename, '\\.ogg$', ''), i) AS part_name
           FROM h, LATERAL (SELECT unnest(range(parts)) AS i)""",
    ),
)
def _(spark, folder):
    tracks = v.durations(spark, folder).drop("species")
    plan = plan_segments(tracks, F.regexp_replace("filename", r"\.ogg$", ""), "duration", 50.0)
    return plan.select("filename", "parts", "part", F.round("part_sec", 6).alias("part_sec"), "part_name")
