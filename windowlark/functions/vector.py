"""Expressions over numbers and array columns; all run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(vec: Column | str) -> Column:
    return _c(vec).cast("array<double>")


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x).cast("double")))


def sigmoid_vec(vec: Column | str) -> Column:
    return F.transform(doubles(vec), sigmoid)


def log_gap(a: Column | str, b: Column | str) -> Column:
    """``log(|a - b| + 1)``."""
    return F.log1p(F.abs(_c(a) - _c(b)).cast("double"))


def clip01(x: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(x).cast("double")))


def energy(vec: Column | str) -> Column:
    """Sum of squares."""
    return F.aggregate(doubles(vec), F.lit(0.0), lambda acc, x: acc + x * x)


def mean_of_vectors(*vecs: Column | str) -> Column:
    total = reduce(
        lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [doubles(v) for v in vecs]
    )
    return F.transform(total, lambda x: x / len(vecs))


def blend_vectors(
    a: Column | str, b: Column | str, weight: float = 0.5, scale: float = 1.0
) -> Column:
    """``scale * (weight * a + (1 - weight) * b)``. Scale 0.5 gives the halved blend of the v3 to v6 sets."""
    return F.zip_with(
        doubles(a), doubles(b), lambda x, y: (x * weight + y * (1 - weight)) * scale
    )


def concat_vectors(*vecs: Column | str) -> Column:
    return F.concat(*[doubles(v) for v in vecs])


def unit_hash(*keys: Column | str, seed: int = 0) -> Column:
    """Deterministic uniform number in [0, 1) from key columns; stands in for an unseeded random."""
    # all 53 bits that a double can hold
    return F.shiftrightunsigned(F.xxhash64(*[_c(k) for k in keys], F.lit(seed)), 11) / F.lit(float(1 << 53))


def mask_vectors(vec: Column | str, key: Column | str, p: float = 0.15, seed: int = 0) -> tuple[Column, Column]:
    """(masked vector, boolean mask): each entry is masked with probability ``p`` and set to 0."""
    mask = F.transform(doubles(vec), lambda x, i: unit_hash(_c(key), i, seed=seed) < p)
    masked = F.zip_with(doubles(vec), mask, lambda x, m: F.when(m, F.lit(0.0)).otherwise(x))
    return masked, mask


def masked_mse(truth: Column | str, guess: Column | str, mask: Column | str) -> Column:
    """Mean squared error over the masked entries; null when none is masked."""
    gap = F.zip_with(doubles(truth), doubles(guess), lambda x, y: (x - y) * (x - y))
    kept = F.zip_with(gap, _c(mask), lambda g, m: F.when(m, g).otherwise(F.lit(0.0)))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return total / F.nullif(F.size(F.filter(_c(mask), lambda m: m)), F.lit(0))


def argmax(vec: Column | str) -> Column:
    """0-based position of the largest entry, the first one when tied."""
    return F.array_position(_c(vec), F.array_max(_c(vec))) - 1


def argmax_hit(a: Column | str, b: Column | str) -> Column:
    return (argmax(a) == argmax(b)).cast("int")


def top_indices(vec: Column | str, k: int, largest: bool = True) -> Column:
    """0-based positions of the ``k`` largest (or smallest) entries, ties by position."""
    sign = -1.0 if largest else 1.0
    ranked = F.array_sort(
        F.transform(
            doubles(vec), lambda x, i: F.struct((x * sign).alias("rank_key"), i.cast("bigint").alias("index"))
        )
    )
    return F.transform(F.slice(ranked, 1, k), lambda s: s["index"])


def pick(vec: Column | str, indices: Sequence[int]) -> Column:
    """(index, value) entries for a few fixed positions; the rest of the vector is never exploded."""
    return F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("index"), F.get(_c(vec), F.lit(i)).cast("double").alias("value"))
            for i in indices
        ]
    )


def prob_of_label(probs: Column | str, classes: Sequence, label: Column | str) -> Column:
    """Entry of ``probs`` at the position of ``label`` in the class list; null for an unknown label."""
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), _c(label)).cast("int")
    return F.get(_c(probs), F.nullif(position, F.lit(0)) - 1)


def binarize(labels: Column | str, classes: Sequence) -> Column:
    """0/1 vector over a class list; labels outside the list are ignored."""
    return F.transform(
        F.array(*[F.lit(c) for c in classes]), lambda c: F.array_contains(_c(labels), c).cast("int")
    )


def duration_parts(duration: Column | str, longest: float) -> Column:
    """Number of equal parts after halving until a part is at most ``longest``; 2**62 if that is not enough."""
    d = _c(duration)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(62)),
        F.lit(1).cast("bigint"),
        lambda parts, _: F.when(d / parts > longest, parts * 2).otherwise(parts),
    )


def split_duration(duration: Column | str, longest: float) -> Column:
    return _c(duration) / duration_parts(duration, longest)
