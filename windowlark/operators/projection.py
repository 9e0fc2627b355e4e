"""Principal components by block power iteration (K8).

A pass multiplies the covariance with a block of directions: a task forms ``Xᵀ (X Q)`` of its centred rows batch by batch, and the sums of
tasks, as many numbers as the block has, are added in a tree of two groupings. The covariance itself is built only where the
block is as wide as the vectors, as it is from the start for narrow ones. For a share of the variance the block grows until the directions found explain it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directions of the first block, and how many more than asked for are carried so that the last ones converge.
BLOCK, EXTRA = 32, 8
#: Vectors up to this width take one pass with a block of their whole width: the covariance is then 2 MB.
DIRECT = 512
#: A block that does not explain the share grows once a pass adds less than so much of the total variance.
SLOW = 1e-3
#: Partial sums that one task of the first grouping adds up.
FAN_IN = 64

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Components:
    """Orthonormal directions (a row each), largest variance first, the mean, and the total variance of the vectors."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float
    passes: int

    @property
    def shares(self) -> np.ndarray:
        return self.variances / self.total if self.total else np.zeros(len(self.variances))

    def apply(self, vec: Column | str) -> Column:
        """Centred coordinates along the directions; null for a null vector."""
        mean, turn = self.mean, self.directions.T
        return _mapped(vec, "array<double>", lambda x: list((x - mean) @ turn))

    def left_over(self, vec: Column | str) -> Column:
        """Squared length of what the directions do not account for: the error of a reconstruction."""
        mean, rows = self.mean, self.directions
        return _mapped(vec, "double", lambda x: (((x - mean) - (x - mean) @ rows.T @ rows) ** 2).sum(axis=1))


def _mapped(vec: Column | str, kind: str, of) -> Column:
    @F.pandas_udf(kind)
    def run(vectors: pd.Series) -> pd.Series:
        known = vectors.notna().to_numpy()
        out = [None] * len(vectors)
        if known.any():
            for i, value in zip(np.flatnonzero(known), of(np.stack(vectors[known].to_numpy()).astype(float)), strict=True):
                out[i] = value
        return pd.Series(out, dtype=object if kind != "double" else float)

    return run((F.col(vec) if isinstance(vec, str) else vec).cast("array<double>"))


def _times(rows: DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum over rows of the centred vector times its products with the directions ``q`` (a column each)."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, q = shared.value
        total = np.zeros(q.shape)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - mean
                total += x.T @ (x @ q)
        part = TaskContext.get().partitionId() // FAN_IN
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64()))], ["part", "values"])

    added = Summarizer.metrics("sum").summary(F.col("values")).getField("sum").alias("values")
    parts = rows.mapInArrow(run, "part int, values array<double>").withColumn("values", array_to_vector("values"))
    return parts.groupBy("part").agg(added).agg(added).first()["values"].toArray().reshape(q.shape)


def fit_components(
    df: DataFrame, vec: str, k: int | None = None, variance: float | None = None, tol: float = 1e-8, max_passes: int = 200, seed: int = 0
) -> Components:
    """The first ``k`` principal components, or the fewest that explain a share ``variance`` of the total variance.

    Variances are those of a sample (n - 1). Each direction's largest entry is positive. Rows without a vector take no part; with fewer
    than two rows there is no variance and nothing to fit. The sum of the variances found settles within ``tol`` of itself.
    """
    if (k is None) == (variance is None):
        raise ValueError("give either k or variance")
    rows = df.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("x"))
    if rows.isEmpty():
        raise ValueError("nothing to fit")
    s = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("x")).alias("s")).first()["s"]
    if s["count"] < 2:
        raise ValueError("nothing to fit")
    mean, spread, n = s["mean"].toArray(), s["variance"].toArray(), s["count"]
    width, total = len(mean), float(spread.sum())
    if k is not None and k > width:
        raise ValueError("more components than entries")
    rng = np.random.default_rng(seed)
    wide = width if width <= DIRECT else min(width, (k or BLOCK) + EXTRA)
    q = np.linalg.qr(rng.normal(size=(width, wide)))[0] if wide < width else np.eye(width)
    passes, before = 0, None
    while True:
        product = _times(rows, mean, q) / (n - 1)
        passes += 1
        # the best directions inside the block, and what they explain
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        found = np.maximum(values[: k or wide], 0.0)
        enough = variance is not None and np.searchsorted(np.cumsum(found), variance * total * (1 - 1e-12)) < len(found)
        step = np.inf if before is None else abs(found.sum() - before) / max(total, 1e-300)
        level, slow = step <= tol, variance is not None and not enough and step <= SLOW
        before = found.sum()
        if q.shape[1] == width or passes >= max_passes or (level and (k is not None or enough)):
            break
        if slow:
            # settles without explaining the share: twice the block, the old directions kept
            more = min(width, 2 * q.shape[1])
            q = np.eye(width) if more == width else np.linalg.qr(np.concatenate([product @ turn, rng.normal(size=(width, more - q.shape[1]))], axis=1))[0]
            wide, before = more, None
        else:
            q = np.linalg.qr(product @ turn)[0]
    kept = k if k is not None else min(len(found), int(np.searchsorted(np.cumsum(found), variance * total * (1 - 1e-12))) + 1)
    directions = (q @ turn[:, :kept]).T
    signs = np.sign(directions[np.arange(kept), np.abs(directions).argmax(axis=1)])
    return Components(mean, directions * np.where(signs == 0, 1, signs)[:, None], found[:kept], total, passes)
