"""Windows in time: slicing series, framing windows, class scores per track."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.functions import vector as V
from windowlark.operators.aggregates import count_by, mean_of, mean_vector
from windowlark.operators.ordered import join_back
from windowlark.operators.rows import align_frames
from windowlark.operators.windows import lead_or_self, top_per_group
from windowlark.session import materialize


def slice_windows(
    df: DataFrame, series: str, rate: int, keep: Sequence[str], seconds: float = 3, pad: float = 0, step: float | None = None
) -> DataFrame:
    """Windows of a sample array, the end padded with zeros to a multiple of the step.

    Adds ``index``, ``start`` (seconds where the window begins), ``ref_time`` (``index * seconds``) and
    ``window``. A series shorter than one window gives no row. Each window copies only its own samples.
    """
    size = int(rate * seconds) + int(rate * pad)
    hop = size if step is None else int(rate * step)
    padded = F.ceil(F.size(series) / hop).cast("int") * hop
    starts = F.when(padded >= size, F.sequence(F.lit(0), padded - size, F.lit(hop)))
    rows = df.select(*keep, series, F.posexplode(starts).alias("index", "_at"))
    # slice first: a cast before it would convert the whole series for every window
    part = F.slice(F.col(series), F.col("_at") + 1, F.lit(size)).cast("array<double>")
    full = F.concat(part, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(part)))
    return rows.select(
        *keep,
        F.col("index").cast("bigint").alias("index"),
        (F.col("_at") / rate).alias("start"),
        (F.col("index") * float(seconds)).alias("ref_time"),
        full.alias("window"),
    )


def build_sequences(
    df: DataFrame, index: str, seconds: Column | str, min_duration: int, hop: int, seq_step: int | None = None
) -> DataFrame:
    """Runs of ``min_duration // hop`` consecutive windows, one run every ``seq_step``.

    Long form: each window row is copied to the runs that hold it, with ``seq_start`` and ``pos``. Runs
    that would pass the end of the series, and series shorter than ``min_duration``, give no rows.
    The assignment is arithmetic on the window index, so there is neither a join nor a shuffle.
    """
    n = min_duration // hop
    step = seq_step or min_duration // 2
    length = F.col(seconds) if isinstance(seconds, str) else seconds
    i = F.col(index)
    first = F.greatest(F.lit(0), F.ceil((i - n + 1) / step)).cast("bigint")
    last = F.floor(i / step).cast("bigint")
    runs = F.when(last >= first, F.sequence(first, last))
    rows = df.where(length >= min_duration).withColumn("_run", F.explode(runs))
    return (
        rows.withColumn("seq_start", F.col("_run") * step)
        .where(F.col("seq_start") + n <= length)
        .withColumn("pos", i - F.col("seq_start"))
        .drop("_run")
    )


def pad_center_noise(
    df: DataFrame, series: str, rate: int, key: str, alpha: float = 0.1, seed: int = 0, name: str = "padded"
) -> DataFrame:
    """Centre a series in a zero frame of the next longer multiple of 3 s and mix in Gaussian noise (I4).

    The noise has the series' own mean and deviation and is drawn from a hash of (key, position), so a
    retried task gives the same samples.
    """
    x = F.col(series).cast("array<double>")
    n = F.size(series)
    frame = ((F.floor(n / rate / 3) + 1) * 3 * rate).cast("int")
    lead = F.floor((frame - n) / 2).cast("int")
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    sized = df.withColumns({"_n": n, "_frame": frame, "_lead": lead, "_mean": mean})
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean")))
    sized = sized.withColumn("_std", F.sqrt(square / F.col("_n")))
    centred = F.concat(
        F.array_repeat(F.lit(0.0), F.col("_lead")), x, F.array_repeat(F.lit(0.0), F.col("_frame") - F.col("_n") - F.col("_lead"))
    )

    def mixed(value: Column, i: Column) -> Column:
        u = F.greatest(V.unit_hash(F.col(key), i, seed=seed), F.lit(1e-12))
        w = V.unit_hash(F.col(key), i, seed=seed + 1)
        normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * w)
        return value * (1 - alpha) + (F.col("_mean") + F.col("_std") * normal) * alpha

    out = centred if alpha == 0 else F.transform(centred, mixed)
    return sized.withColumn(name, out).drop("_n", "_frame", "_lead", "_mean", "_std")


def frequent_top_classes(df: DataFrame, by: Sequence[str], vec: str, k: int, largest: bool = True) -> DataFrame:
    """The ``k`` classes that are most often among a window's ``2k`` best, per track.

    The best classes are chosen inside each row's array; only ``2k`` of them are exploded.
    """
    best = df.select(*by, F.explode(V.top_indices(vec, 2 * k, largest)).alias("index"))
    return top_per_group(count_by(best, [*by, "index"]), by, [F.desc("n"), F.asc("index")], k)


def rank_predictions(df: DataFrame, classes: DataFrame, by: Sequence[str], vec: str, keep: Sequence[str]) -> DataFrame:
    """The track's classes beside each window, ranked by the window's own probability.

    ``classes`` is the result of ``frequent_top_classes``: ``k`` rows per track, so the list is short.
    """
    lists = classes.groupBy(*by).agg(F.array_sort(F.collect_set("index")).alias("_classes"))
    scored = F.transform(
        "_classes",
        lambda c: F.struct(
            (-V.sigmoid(F.get(F.col(vec), c.cast("int")))).alias("key"), c.alias("index")
        ),
    )
    ranked = join_back(df, lists, by).select(*keep, F.posexplode(F.array_sort(scored)).alias("rank", "_p"))
    return ranked.select(*keep, F.col("rank").cast("bigint").alias("rank"), F.col("_p.index").alias("index"), (-F.col("_p.key")).alias("probability"))


def active_windows(df: DataFrame, vec: str, threshold: float, start: str, hop: float = 1.0) -> DataFrame:
    """Windows whose best probability exceeds a threshold, with their time offset (I8)."""
    peak = V.sigmoid(F.array_max(vec))
    return df.withColumn("peak", peak).where(F.col("peak") > threshold).withColumn("offset", F.col(start) * float(hop))


def class_series(
    df: DataFrame, by: Sequence[str], time: str, vec: str, k: int, largest: bool = True
) -> DataFrame:
    """Score of a track's most (or least) frequent classes at every window, long form."""
    classes = frequent_top_classes(df, by, vec, k, largest)
    lists = classes.groupBy(*by).agg(F.array_sort(F.collect_set("index")).alias("_classes"))
    rows = join_back(df.select(*by, time, vec), lists, by).withColumn("index", F.explode("_classes"))
    return rows.select(*by, time, "index", F.get(F.col(vec), F.col("index").cast("int")).cast("double").alias("score"))


def frame_vectors(
    df: DataFrame, by: Sequence[str], start: str, vec: str, score_vec: str | None = None, probability: str | None = None
) -> DataFrame:
    """Both windows of each complete 5 s frame as one vector.

    A frame holds two windows, so each is one short list in a hash aggregate, sorted in its row; frames of another
    number of windows do not count. Optionally the mean of a score vector and the best probability.

    The frame key gets an exchange of its own: a join by track before this step may then be split by
    adaptive execution when one track is hot, which it could not if the aggregate reused its partitioning.
    """
    aligned = align_frames(df, start).repartition(*by, "seq_id")
    window = F.struct(F.col(start).alias("at"), F.col(vec).alias("v"), *([F.col(score_vec).alias("s")] if score_vec else []))
    aggs = [F.array_sort(F.collect_list(window)).alias("_w")]
    if probability:
        aggs.append(F.max(probability).alias("probability"))
    frames = aligned.groupBy(*by, "seq_id").agg(*aggs).where(F.size("_w") == 2)
    first, second = F.get("_w", F.lit(0)), F.get("_w", F.lit(1))
    columns = [
        *by, "seq_id", first["at"].alias("start_time"), *(["probability"] if probability else []),
        V.concat_vectors(first["v"], second["v"]).alias("embedding"),
    ]
    if score_vec:
        columns.append(V.mean_of_vectors(first["s"], second["s"]).alias("prediction_vec"))
    return frames.select(*columns)


def sequence_vectors(df: DataFrame, by: Sequence[str], start: str, vec: str) -> DataFrame:
    """Mean of the distinct window vectors of each (track, ``seq_id``), and its first second."""
    once = df.groupBy(*by, "seq_id", vec).agg(F.min(start).alias("_start"))
    return once.groupBy(*by, "seq_id").agg(mean_of(vec).alias("embedding"), F.min("_start").alias("start_time"))


def context_vectors(frames: DataFrame, by: Sequence[str], vec: str = "embedding") -> DataFrame:
    """Adds the next frame's vector and the mean over the whole track.

    The frames are read three times (rows, block heads, means), so they are written once.
    """
    frames = materialize(frames)
    following = lead_or_self(frames, by, "seq_id", vec, "next_embedding")
    whole = mean_vector(frames, by, vec, "track_embedding", distinct=True)
    return join_back(following, whole, by)
