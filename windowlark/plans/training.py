"""Training tables assembled from window tables.

The variants differ in which windows they align, which labels they trust and which vectors they keep.
Where a later step reads a table several times (``base``), the table is written first, as a user of
separate steps would do. Column names: ``stem`` (recording), ``track_type`` (channel), ``start_time``, ``embedding``,
``prediction``, ``probability``; metadata has ``primary_label``, ``metadata_species`` and ``xc_id``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.functions import text as tx
from windowlark.functions import vector as V
from windowlark.operators import frames as fr
from windowlark.operators.aggregates import collect_distinct, collect_ordered, cooccurrence, mean_vector
from windowlark.operators.joins import pair_with_slots, random_partner
from windowlark.operators.labels import class_threshold, noise_negatives, representative_source
from windowlark.operators.ordered import assign_row_id, join_classes
from windowlark.operators.rows import align_frames, vector_to_columns
from windowlark.operators.sampling import sample_strata, shuffle_rows
from windowlark.operators.sets import union_aligned
from windowlark.operators.windows import sample_per_group, top_per_group, with_group_size
from windowlark.session import materialize

NO_CALL = "no_call"


@dataclass(frozen=True)
class Augment:
    """How many rows to sample per class, how many noise rows to mix in, how many to keep, at what weight."""

    per_class: int = 20
    noise_rows: int = 20
    keep: int = 20
    weight: float = 0.75
    scale: float = 0.5
    seed: int = 0


def track_labels(metadata: DataFrame, secondary: str = "secondary_labels", file: str = "filename") -> DataFrame:
    """Primary label, all labels of a track and its number."""
    return metadata.select(
        "primary_label",
        F.array_union(F.array("primary_label"), tx.parse_list(secondary)).alias("metadata_species"),
        tx.track_number(file).alias("xc_id"),
    )


def with_track_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Metadata by track number; rows without a number have no metadata and drop out."""
    numbered = df.withColumn("xc_id", tx.track_number("stem")).where("xc_id <> ''")
    return numbered.join(labels, "xc_id").drop("xc_id")


def training_v2(windows: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Sequence, next and track vectors with the labels predicted for the sequence, best first."""
    aligned = align_frames(windows, "start_time", frame=10, offsets=(0,))
    original = aligned.where("track_type = 'original'")
    context = fr.context_vectors(fr.sequence_vectors(original, ["stem"], "start_time", "embedding"), ["stem"])
    # one window a channel and sequence, so the lists are as short as the channels are few
    trusted = aligned.where((F.col("prediction") != NO_CALL) & (F.col("probability") > threshold))
    called = collect_ordered(trusted, ["stem", "seq_id"], ["probability", "prediction"], ["prediction", "probability"], desc=True)
    joined = context.join(called, ["stem", "seq_id"])
    return with_track_labels(joined, labels).select(
        "stem",
        "start_time",
        "metadata_species",
        F.col("prediction").alias("predicted_species"),
        F.col("probability").alias("predicted_species_prob"),
        "embedding",
        "next_embedding",
        "track_embedding",
    )


def training_v5_base(windows: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """As v2 on two windows a frame, with label sets and ``no_call`` where nothing was predicted."""
    aligned = align_frames(windows, "start_time")
    original = aligned.where("track_type = 'original'")
    context = fr.context_vectors(fr.sequence_vectors(original, ["stem"], "start_time", "embedding"), ["stem"])
    trusted = aligned.where((F.col("prediction") != NO_CALL) & (F.col("probability") > threshold))
    called = collect_distinct(trusted, ["stem", "seq_id"], "prediction", "predicted_species")
    joined = context.join(called, ["stem", "seq_id"], "full")
    return with_track_labels(joined, labels).select(
        "stem",
        "seq_id",
        "start_time",
        "primary_label",
        "metadata_species",
        F.coalesce("predicted_species", F.array(F.lit(NO_CALL))).alias("predicted_species"),
        "embedding",
        "next_embedding",
        "track_embedding",
    )


def restrict_labels(df: DataFrame, known: DataFrame) -> DataFrame:
    """Keep only labels that are known to occur with the primary one, else the primary; drop ``no_call``.

    ``known`` is the table whose metadata label sets define what occurs together.
    """
    together = cooccurrence(known, "primary_label", "metadata_species", "together")
    allowed = F.array_union("together", F.array(F.lit(NO_CALL)))
    kept = F.array_intersect("predicted_species", allowed)
    filled = F.when(F.size(kept) == 0, F.array("primary_label")).otherwise(kept)
    return join_classes(df, together, ["primary_label"]).withColumn("predicted_species", F.array_remove(filled, NO_CALL)).drop("together")


def quiet_windows(windows: DataFrame, key: Sequence[str], limit: float = 0.01, pool: int | None = None) -> DataFrame:
    """Quietest window of each track; ``pool`` keeps only the least likely calls of all tracks first."""
    low = windows.where((F.pmod("start_time", F.lit(3)) == 0) & (F.col("probability") < limit))
    if pool is not None:
        low = low.orderBy("probability", *key).limit(pool)
    return top_per_group(low, [key[0]], [F.asc("probability"), *[F.asc(k) for k in key]])


def augment_with_noise(
    df: DataFrame, by: Column, key: Sequence[str], noise: DataFrame, noise_order: Sequence[str], vectors: Sequence[str],
    how: Augment = Augment(),
) -> DataFrame:
    """Blends of sampled rows with noise vectors, same columns as ``df``.

    ``noise`` has ``noise_embedding`` and the order columns. Each sampled row meets every noise row by slot
    number; the final sample per class is drawn by hash of row and noise keys.
    """
    classed = df.withColumn("_class", by)
    picked = sample_per_group(classed, ["_class"], key, how.per_class, how.seed)
    quiet = noise.select("noise_embedding", *[F.col(c).alias(f"_noise_{c}") for c in noise_order])
    noise_key = [f"_noise_{c}" for c in noise_order]
    mixed = pair_with_slots(picked, quiet, how.noise_rows, noise_key)
    chosen = sample_per_group(mixed, ["_class"], [*key, *noise_key], how.keep, how.seed + 1)
    blends = {v: V.blend_vectors(v, "noise_embedding", how.weight, how.scale) for v in vectors}
    return chosen.withColumns(blends).select(*df.columns)


def training_v3(windows: DataFrame, labels: DataFrame, window_key: Sequence[str], how: Augment = Augment()) -> DataFrame:
    """v2 plus noise-blended copies."""
    base = materialize(training_v2(windows, labels))
    noise = quiet_windows(windows, window_key).select(F.col("embedding").alias("noise_embedding"), "probability", *window_key)
    extra = augment_with_noise(
        base, F.get("metadata_species", F.lit(0)), ["stem", "start_time"], noise, ["probability", *window_key],
        ["embedding", "next_embedding", "track_embedding"], how,
    )
    return extra.unionByName(base)


def training_v5(
    windows: DataFrame, labels: DataFrame, window_key: Sequence[str], how: Augment = Augment(weight=0.9)
) -> DataFrame:
    """v5: label sets, augmentation of called rows, labels restricted to co-occurring ones."""
    base = materialize(training_v5_base(windows, labels))
    called = base.where((F.get("predicted_species", F.lit(0)) != NO_CALL) & F.col("embedding").isNotNull())
    noise = quiet_windows(windows, window_key).select(F.col("embedding").alias("noise_embedding"), "probability", *window_key)
    extra = augment_with_noise(
        called, F.get("metadata_species", F.lit(0)), ["stem", "seq_id"], noise, ["probability", *window_key],
        ["embedding", "next_embedding", "track_embedding"], how,
    )
    return restrict_labels(extra.unionByName(base), base)


def usable_channels(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """(stem, track_type) of the original channel and of the representative separated one.

    Channels are chosen before the frames are built: next and track vectors never look across channels, so
    this only drops wide rows early.
    """
    labelled = with_track_labels(windows.select("stem", "track_type", "prediction"), labels.select("xc_id", "primary_label"))
    best = representative_source(labelled, "stem", "track_type", "primary_label", "prediction").select("stem", "track_type")
    return best.union(windows.select("stem", F.lit("original").alias("track_type")).distinct())


def training_v6(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """Complete frames of usable channels with next and track vectors."""
    by = ["stem", "track_type"]
    kept = join_classes(windows, usable_channels(align_frames(windows, "start_time"), labels), by, "left_semi")
    frames = fr.frame_vectors(kept, by, "start_time", "embedding", probability="probability")
    context = fr.context_vectors(frames, by)
    return with_track_labels(context, labels).select(
        *by, "start_time", "primary_label", "metadata_species", "probability", "embedding", "next_embedding", "track_embedding"
    )


def augment_v6(base: DataFrame, how: Augment = Augment(weight=0.9)) -> DataFrame:
    """v6 plus blends with its own 20 least likely frames."""
    key = ["stem", "track_type", "start_time"]
    noise = base.select(F.col("embedding").alias("noise_embedding"), "probability", *key)
    # the three vectors of a v6 row have the noise vector's length
    extra = augment_with_noise(
        base, F.col("primary_label"), key, noise, ["probability", *key],
        ["embedding", "next_embedding", "track_embedding"], how,
    )
    return extra.unionByName(base)


def training_v7_base(windows: DataFrame, labels: DataFrame, score_vec: str = "prediction_vec") -> DataFrame:
    """Complete frames of usable channels with the mean score vector."""
    by = ["stem", "track_type"]
    kept = join_classes(windows, usable_channels(align_frames(windows, "start_time"), labels), by, "left_semi")
    frames = fr.frame_vectors(kept, by, "start_time", "embedding", score_vec, "probability")
    return with_track_labels(frames, labels).select(
        *by, "start_time", "primary_label", "metadata_species", "probability", "embedding", "prediction_vec"
    )


def call_labels(base: DataFrame, min_count: int = 11, common: float = 0.5, rare: float = 0.1) -> DataFrame:
    """Species or ``no_call`` for separated channels, by a threshold that depends on the class size.

    A class is common when at least ``min_count`` of its rows score above ``common``.
    """
    ruled = class_threshold(base, "primary_label", common, rare, min_count, F.col("probability") > common)
    label = F.when(F.col("probability") > F.col("threshold"), F.col("primary_label")).otherwise(F.lit(NO_CALL))
    return ruled.where("track_type <> 'original'").withColumn("species", label).drop("threshold")


def training_v7(base: DataFrame) -> DataFrame:
    """Labels of the separated channel carried to all rows of the same recording and second."""
    labels = call_labels(base).select("stem", "start_time", "species")
    return base.join(labels, ["stem", "start_time"]).select(
        "stem", "track_type", "start_time", "species", "embedding", "prediction_vec"
    )


def relabel_v6(base: DataFrame) -> DataFrame:
    """Separated rows with their call label, original rows with the same labels, classes of one row removed."""
    called = call_labels(base, min_count=1).select("stem", "start_time", "species", "embedding")
    original = base.where("track_type = 'original'").select("stem", "start_time", "embedding")
    carried = original.join(called.select("stem", "start_time", "species"), ["stem", "start_time"])
    both = union_aligned(called, carried)
    return with_group_size(both, ["species"], "species_count").where("species_count > 1")


def build_binary(
    windows: DataFrame, noise: DataFrame, background: DataFrame, key: Sequence[str], min_count: int = 100,
    sure: float = 0.5, unsure: float = 0.1, fraction: float = 0.6, seed: int = 42,
) -> DataFrame:
    """Call / no-call rows.

    Calls are rows above ``sure`` of classes that are not rare; no-calls are the noise rows, a sample of
    the rows below ``unsure`` and the background table.
    """
    ruled = class_threshold(windows, "species", sure, 2.0, min_count)
    calls = ruled.where(F.col("probability") > F.col("threshold")).select(F.lit("call").alias("species"), "embedding")
    low = sample_strata(windows.where(F.col("probability") < unsure), key, fraction, seed)
    quiet = [t.select(F.lit(NO_CALL).alias("species"), "embedding") for t in (noise, low, background)]
    return quiet[0].unionByName(quiet[1]).unionByName(quiet[2]).unionByName(calls)


def wide_matrix(predictions: DataFrame, key: Sequence[str], n: int, threshold: float = 0.5, seed: int = 0) -> DataFrame:
    """Confident windows, one row per window, one column per vector entry, shuffled."""
    from windowlark.operators.aggregates import dedupe

    sure = predictions.where(F.col("probability") > threshold)
    named = sure.withColumn("track_id", tx.track_id(*key))
    one = dedupe(named, ["track_id"], ["probability", "species"])
    wide = vector_to_columns(one, "embedding", n, ["track_id", "species"])
    return shuffle_rows(wide, ["track_id"], seed)


def background_table(scores: DataFrame, stem: str, time: str, probs: str, classes: Sequence[str]) -> DataFrame:
    """One score column per class under a row id ``stem_time``."""
    columns = [F.round(F.get(probs, F.lit(i)), 6).alias(c) for i, c in enumerate(classes)]
    return scores.select(tx.track_id(stem, time).alias("row_id"), "embedding", *columns)


def training_v1(
    windows: DataFrame, labels: DataFrame, vec: str, noise_classes: Sequence[int], soft_noise: Sequence[int],
    track_key: Sequence[str], singles: int = 250, pairs: int = 100, triples: int = 30, seed: int = 0,
) -> DataFrame:
    """(labels, vector) rows: track averages, representative windows, negatives, and blended singles, pairs, triples.

    ``windows`` has ``species`` and ``prediction``; ``track_key`` identifies a window.
    """
    key = list(track_key)
    multi = labels.where(F.size("metadata_species") > 1)
    averages = mean_vector(
        with_track_labels(windows.where("track_type = 'original'").select("stem", "embedding"), multi),
        ["metadata_species"],
        "embedding",
    ).select(F.col("metadata_species").alias("species"), "embedding")

    best = representative_source(windows, "stem", "track_type", "species", "prediction").select("stem", "track_type")
    shown = windows.where("species = prediction").join(best, ["stem", "track_type"], "left_semi")
    negatives = noise_negatives(windows, vec, noise_classes, [*key, "embedding"], 250)
    noise = noise_negatives(windows, vec, soft_noise, [*key, "embedding"], 50)

    first = top_per_group(shown, ["stem", "track_type"], [F.desc("probability"), *[F.asc(k) for k in key]])
    # no more than 50 noise rows a soft class
    mixed = augment_with_noise(
        first.select("species", "embedding", *key), F.col("species"), key,
        noise.select(F.col("embedding").alias("noise_embedding"), "index", *key), ["index", *key], ["embedding"],
        Augment(per_class=100, noise_rows=50 * len(soft_noise), keep=1000, weight=0.5, scale=1.0, seed=seed),
    )
    dense = _numbered(mixed, key)
    def others(suffix: str) -> DataFrame:
        return dense.select(F.col("species").alias(f"species_{suffix}"), F.col("embedding").alias(f"embedding_{suffix}"), F.col("index"))

    row = ["index", "species"]
    one = sample_per_group(dense, ["species"], row, singles, seed + 2)
    two = sample_per_group(dense, ["species"], row, pairs, seed + 3).withColumnRenamed("index", "own")
    two = random_partner(two, others("1"), ["own"], seed=seed + 4)
    three = sample_per_group(dense, ["species"], row, triples, seed + 5).withColumnRenamed("index", "own")
    three = random_partner(three, others("1"), ["own"], seed=seed + 6)
    three = random_partner(three, others("2"), ["own"], seed=seed + 7)

    parts = [
        _single(shown), _single(negatives), _single(one),
        two.select(F.array_distinct(F.array("species", "species_1")).alias("species"), V.mean_of_vectors("embedding", "embedding_1").alias("embedding")),
        three.select(
            F.array_distinct(F.array("species", "species_1", "species_2")).alias("species"),
            V.mean_of_vectors("embedding", "embedding_1", "embedding_2").alias("embedding"),
        ),
    ]
    out = averages
    for part in parts:
        out = out.unionByName(part)
    return out


def _single(df: DataFrame) -> DataFrame:
    return df.select(F.array("species").alias("species"), F.col("embedding").cast("array<double>").alias("embedding"))


def _numbered(mixed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Dense index in hash order, so that a drawn index hits a random blend."""
    order = [F.xxhash64(*key, "embedding"), *[F.col(k) for k in key], F.col("embedding")]
    return assign_row_id(mixed, order, "index", start=0).select("index", "species", "embedding")
