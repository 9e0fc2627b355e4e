"""Boosted trees of many labels over shared bins, by second-order histograms.

Features are cut once into quantile bins that all labels share; a row is then a few bytes. One level of the trees
of all labels takes one pass: every task adds up gradients and curvatures by (label, node, feature, bin), the sums of tasks are
added in a tree of two groupings, and the best split of a node is found where its histogram lies. On the driver are
the splits, a handful of numbers per node. Margins of the rows are written once a round, so no round
walks through the trees of earlier ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.session import discard, materialize

#: Bytes of histograms that a task holds in one pass; more labels take further passes.
HISTOGRAM_BYTES = 128 << 20
#: Partial histograms that one task of the first grouping adds up.
FAN_IN = 64

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BINNED = "bins binary, y array<int>, w double, margin array<double>"


@dataclass
class BoostedLabels:
    """Trees by (round, class, node): node i has the children 2i+1 (bin <= cut) and 2i+2; feature -1 is a leaf."""

    classes: list[str]
    edges: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = to_bins(x, self.edges)
        out = np.zeros((len(x), len(self.classes)))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            out += np.take_along_axis(value.T, _reach(bins, feature, cut), axis=0)
        return out

    def scores(self, vec: Column | str) -> Column:
        """Probabilities of all classes as one vector, in the order of ``classes``; null for a null vector."""
        model = self

        @F.pandas_udf("array<double>")
        def score(vectors: pd.Series) -> pd.Series:
            known = vectors.notna().to_numpy()
            out = [None] * len(vectors)
            if known.any():
                p = 1 / (1 + np.exp(-model.margins(np.stack(vectors[known].to_numpy()).astype(float))))
                for i, row in zip(np.flatnonzero(known), p, strict=True):
                    out[i] = row
            return pd.Series(out, dtype=object)

        return score((F.col(vec) if isinstance(vec, str) else vec).cast("array<double>"))


def to_bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of every entry: how many edges of its feature lie below it. NaN goes to the first bin."""
    out = np.zeros(x.shape, dtype=np.uint8)
    for j, cuts in enumerate(edges):
        out[:, j] = np.searchsorted(cuts, np.where(np.isnan(x[:, j]), -np.inf, x[:, j]), side="left")
    return out


def _reach(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node where each row ends, for every class."""
    rows, own = np.arange(len(bins))[:, None], np.arange(len(feature))[None, :]
    at = np.zeros((len(bins), len(feature)), dtype=np.int64)
    for _ in range(int(np.log2(feature.shape[1] + 1)) - 1):
        f = feature[own, at]
        below = bins[rows, np.maximum(f, 0)] <= cut[own, at]
        at = np.where(f >= 0, 2 * at + np.where(below, 1, 2), at)
    return at


def quantile_edges(df: DataFrame, vec: str, bins: int, accuracy: int = 10_000) -> np.ndarray:
    """(feature, bins - 1) cut points at equal shares of the rows, by mergeable quantile sketches over all rows."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cells = df.where(F.col(vec).isNotNull()).select(F.posexplode(F.col(vec).cast("array<double>")).alias("j", "x"))
    rows = cells.groupBy("j").agg(F.percentile_approx("x", shares, accuracy).alias("cuts")).orderBy("j").collect()
    return np.array([r["cuts"] for r in rows], dtype=float).reshape(len(rows), bins - 1)


def best_split(g: np.ndarray, h: np.ndarray, lam: float, gamma: float, least: float) -> tuple:
    """(feature, cut, gain, G left, H left, G, H) from (feature, bin) histograms; feature -1 if no split gains. Ties: first."""
    total_g, total_h = g[0].sum(), h[0].sum()
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left_g**2 / (left_h + lam) + right_g**2 / (right_h + lam) - total_g**2 / (total_h + lam)) / 2 - gamma
    gain = np.where((left_h >= least) & (right_h >= least) & np.isfinite(gain), gain, -np.inf)
    # equal up to rounding is equal: the first feature and bin win
    best = gain.max(initial=-np.inf)
    if not best > 1e-12:
        return -1, 0, 0.0, 0.0, 0.0, float(total_g), float(total_h)
    j, b = np.unravel_index(int(np.argmax(gain >= best - 1e-9 * max(1.0, abs(best)))), gain.shape)
    return int(j), int(b), float(gain[j, b]), float(left_g[j, b]), float(left_h[j, b]), float(total_g), float(total_h)


def _arrays(batch: pa.RecordBatch, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(n, -1)
    y = np.zeros((n, classes))
    places = batch.column(1)
    y[np.repeat(np.arange(n), np.diff(places.offsets.to_numpy())), places.flatten().to_numpy(zero_copy_only=False)] = 1.0
    return bins, y, batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, classes)


def _splits(rows: DataFrame, classes: int, own: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int, bins: int, rules: tuple) -> list:
    """(class, node, *best_split) of every node of a level that has rows, for the classes ``own``."""
    first, count = 2**level - 1, 2**level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = seen = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w, margin = _arrays(batch, classes)
            at = _reach(x, feature[own], cut[own])
            p = 1 / (1 + np.exp(-margin[:, own]))
            g, h = w[:, None] * (p - y[:, own]), w[:, None] * p * (1 - p)
            wide = x.shape[1] * bins
            if sums is None:
                sums, seen = np.zeros((2, len(own), count, wide)), np.zeros((len(own), count), dtype=bool)
            cells = np.arange(x.shape[1]) * bins + x
            for c in range(len(own)):
                here = np.flatnonzero(at[:, c] >= first)
                node = at[here, c] - first
                seen[c, np.unique(node)] = True
                index = (node[:, None] * wide + cells[here]).ravel()
                for s, v in ((sums[0], g), (sums[1], h)):
                    s[c] += np.bincount(index, weights=np.repeat(v[here, c], x.shape[1]), minlength=count * wide).reshape(count, wide)
        if sums is None:
            return
        part = TaskContext.get().partitionId() // FAN_IN
        for c, k in np.argwhere(seen).tolist():
            values = np.concatenate([sums[0, c, k], sums[1, c, k]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(own[c])], pa.int32()), pa.array([first + k], pa.int32()), pa.array([part], pa.int32()), pa.array([values], pa.list_(pa.float64()))],
                ["class", "node", "part", "values"],
            )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, node, values in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                g, h = np.array(values).reshape(2, -1, bins)
                found = [c, node, *best_split(g, h, *rules)]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in found], ["class", "node", "feature", "cut", "gain", "gl", "hl", "g", "h"])

    added = Summarizer.metrics("sum").summary(F.col("values")).getField("sum").alias("values")
    parts = rows.mapInArrow(run, "class int, node int, part int, values array<double>").withColumn("values", array_to_vector("values"))
    whole = parts.groupBy("class", "node", "part").agg(added).groupBy("class", "node").agg(added)
    return (
        whole.select("class", "node", vector_to_array("values").alias("values"))
        .mapInArrow(choose, "class long, node long, feature long, cut long, gain double, gl double, hl double, g double, h double")
        .collect()
    )


def fit_boosted(
    df: DataFrame, vec: str, labels: str, classes: Sequence[str], rounds: int = 10, depth: int = 3, bins: int = 32, eta: float = 0.3,
    lam: float = 1.0, gamma: float = 0.0, min_child_weight: float = 1.0, weight: str | None = None, edges: np.ndarray | None = None,
) -> BoostedLabels:
    """Boosted trees for every class of a fitted list, over rows with an array of labels.

    Log loss from a margin of 0, Newton leaves ``-G / (H + lam) * eta``, splits by gain less ``gamma`` with at least ``min_child_weight``
    of curvature on both sides. A null label array is empty, unseen labels are none, rows without a vector take no part; ``weight`` scales
    a row's gradient and curvature. A round takes ``depth`` passes for all classes whose histograms fit the bound together.
    """
    if not 2 <= bins <= 256:
        raise ValueError("a bin is one byte")
    known = F.array(*[F.lit(c) for c in classes])
    place = F.transform(F.coalesce(F.col(labels).cast("array<string>"), F.array().cast("array<string>")), lambda c: F.array_position(known, c).cast("int") - 1)
    plain = df.where(F.col(vec).isNotNull()).select(
        F.col(vec).cast("array<double>").alias("x"), F.array_distinct(F.filter(place, lambda i: i >= 0)).alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )
    if not classes or plain.isEmpty():
        raise ValueError("nothing to fit")
    if edges is None:
        edges = quantile_edges(plain, "x", bins)
    count, nodes = len(classes), 2 ** (depth + 1) - 1

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = to_bins(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), edges)
                columns = [pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1), batch.column(2), pa.array(list(np.zeros((len(x), count))), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["bins", "y", "w", "margin"])

    rows = materialize(plain.mapInArrow(start, _BINNED))
    trees = []
    for _ in range(rounds):
        feature, cut, value = np.full((count, nodes), -1), np.zeros((count, nodes), dtype=np.int64), np.zeros((count, nodes))
        for level in range(depth):
            at_once = max(1, HISTOGRAM_BYTES // (16 * 2**level * edges.shape[0] * bins))
            for a in range(0, count, at_once):
                for c, k, j, b, _gain, gl, hl, g, h in _splits(rows, count, np.arange(a, min(count, a + at_once)), feature.copy(), cut.copy(), level, bins, (lam, gamma, min_child_weight)):
                    value[c, k] = -g / (h + lam) * eta
                    if j >= 0:
                        cut[c, k], feature[c, k] = b, j
                        value[c, 2 * k + 1], value[c, 2 * k + 2] = -gl / (hl + lam) * eta, -(g - gl) / (h - hl + lam) * eta
        trees.append((feature, cut, value))

        def grow(batches: Iterator[pa.RecordBatch], tree=(feature, cut, value)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, _, _, margin = _arrays(batch, count)
                    margin = margin + np.take_along_axis(tree[2].T, _reach(x, *tree[:2]), axis=0)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(margin), pa.list_(pa.float64()))], ["bins", "y", "w", "margin"])

        after = materialize(rows.mapInArrow(grow, _BINNED))
        discard(rows)
        rows = after
    discard(rows)
    return BoostedLabels(list(classes), edges, *[np.array([t[i] for t in trees]) for i in range(3)])
