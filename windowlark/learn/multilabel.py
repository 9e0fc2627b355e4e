"""Logistic models of many labels at once.

A pass over the rows gives loss and gradient of every model: a task multiplies each Arrow batch with the coefficients of a block of
models, keeps one running sum per block, and the sums of tasks are added in a tree of two groupings. On the driver are coefficients
and gradients only, as many as the models have. There every model takes its own L-BFGS step or shortens its last one, so the number of passes
is that of the slowest model and does not depend on how many there are. A model is a column: a label, a penalty, and a fold it
must not see, so a search over penalties and folds shares the same passes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.learn.metrics import macro_average_precision
from windowlark.session import discard, materialize

#: Models in one matrix product.
BLOCK = 64
#: Partial sums that one task of the first grouping adds up.
FAN_IN = 64
#: Intercept of a class without a choice: its probability is within 10^-15 of 0 or 1.
CERTAIN = 35.0
#: Pairs of steps that L-BFGS remembers.
MEMORY = 10

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class LabelModels:
    """Coefficients (a row per class), intercepts, and the passes over the data that the fit took."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    passes: int = 0
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, vec: Column | str) -> Column:
        """Probabilities of all classes as one vector, in the order of ``classes``; null for a null vector."""
        weights, bias = self.weights, self.bias

        @F.pandas_udf("array<double>")
        def score(vectors):
            import pandas as pd

            known = vectors.notna().to_numpy()
            out = [None] * len(vectors)
            if known.any():
                z = np.stack(vectors[known].to_numpy()).astype(float) @ weights.T + bias
                for i, p in zip(np.flatnonzero(known), 1 / (1 + np.exp(-z)), strict=True):
                    out[i] = p
            return pd.Series(out, dtype=object)

        return score((F.col(vec) if isinstance(vec, str) else vec).cast("array<double>"))


def _prepared(df: DataFrame, vec: str, labels: str, classes: Sequence[str], weight: str | None, fold: str | None) -> DataFrame:
    """(x, y, w, fold): y are positions in the class list; unseen labels have none."""
    known = F.array(*[F.lit(c) for c in classes])
    place = F.transform(F.coalesce(F.col(labels).cast("array<string>"), F.array().cast("array<string>")), lambda c: F.array_position(known, c).cast("int") - 1)
    return df.where(F.col(vec).isNotNull()).select(
        F.col(vec).cast("array<double>").alias("x"), F.array_distinct(F.filter(place, lambda i: i >= 0)).alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
    )


def _dense(batch: pa.RecordBatch, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    y = np.zeros((n, classes))
    places = batch.column(1)
    y[np.repeat(np.arange(n), np.diff(places.offsets.to_numpy())), places.flatten().to_numpy(zero_copy_only=False)] = 1.0
    return np.concatenate([x, np.ones((n, 1))], axis=1), y, batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)


def _tree_sum(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of (block, part, values) by block, in two groupings; a row per block reaches the driver."""
    added = Summarizer.metrics("sum").summary(F.col("values")).getField("sum").alias("values")
    first = parts.withColumn("values", array_to_vector("values")).groupBy("block", "part").agg(added)
    return {r["block"]: r["values"].toArray() for r in first.groupBy("block").agg(added).collect()}


def _evaluate(rows: DataFrame, classes: int, weights: np.ndarray, label: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted loss, gradient and total weight of every model, in one pass over the rows."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, label, skip))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, label, skip = shared.value
        sums = np.zeros((len(weights), weights.shape[1] + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, w, fold = _dense(batch, classes)
            for a in range(0, len(weights), BLOCK):
                own = slice(a, a + BLOCK)
                z, target = x @ weights[own].T, y[:, label[own]]
                seen = w[:, None] * (fold[:, None] != skip[own])
                sums[own, 0] += (seen * (np.logaddexp(0.0, z) - target * z)).sum(axis=0)
                sums[own, 1] += seen.sum(axis=0)
                sums[own, 2:] += (seen * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - target)).T @ x
        part = TaskContext.get().partitionId() // FAN_IN
        blocks = range(0, len(weights), BLOCK)
        values = [sums[a : a + BLOCK].ravel() for a in blocks]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), pa.int32()), pa.array([part] * len(values), pa.int32()), pa.array(values, pa.list_(pa.float64()))], ["block", "part", "values"]
        )

    found = _tree_sum(rows.mapInArrow(run, "block int, part int, values array<double>"))
    shared.unpersist()
    sums = np.concatenate([found[a].reshape(-1, weights.shape[1] + 2) for a in sorted(found)])
    return sums[:, 0], sums[:, 2:], sums[:, 1]


def _direction(gradient: np.ndarray, steps: np.ndarray, changes: np.ndarray, used: np.ndarray) -> np.ndarray:
    """L-BFGS directions of all models; ``steps`` and ``changes`` are (memory, model, coefficient), newest first."""
    q = gradient.copy()
    rho = np.einsum("mcd,mcd->mc", steps, changes)
    rho = np.divide(1.0, rho, out=np.zeros_like(rho), where=rho > 0)
    alpha = np.zeros_like(rho)
    for m in range(len(steps)):
        alpha[m] = rho[m] * np.einsum("cd,cd->c", steps[m], q)
        q -= alpha[m][:, None] * changes[m]
    newest = np.einsum("cd,cd->c", changes[0], changes[0]) * rho[0]
    scale = np.divide(1.0, newest, out=np.ones_like(newest), where=newest > 0)
    q *= np.where(used > 0, scale, 1.0)[:, None]
    for m in range(len(steps) - 1, -1, -1):
        beta = rho[m] * np.einsum("cd,cd->c", changes[m], q)
        q += (alpha[m] - beta)[:, None] * steps[m]
    return -q


def _fit_columns(rows: DataFrame, classes: int, label: np.ndarray, skip: np.ndarray, reg: np.ndarray, tol: float, max_passes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients (intercept last) and largest slope of every model, and the passes used."""
    spread = rows.agg(Summarizer.metrics("std").summary(array_to_vector("x"))["std"].alias("s")).first()["s"]
    spread = spread.toArray()
    # steps are taken in units of each feature's deviation, the penalty is on the coefficients themselves
    unit = np.concatenate([np.where(spread > 0, spread, 1.0), [1.0]])
    penal = reg[:, None] * np.concatenate([np.ones(len(unit) - 1), [0.0]])
    count, width = len(label), len(unit)
    at = np.zeros((count, width))

    def measure(point: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = point / unit
        loss, slope, total = _evaluate(rows, classes, w, label[own], skip[own])
        total = np.maximum(total, 1e-300)
        return loss / total + (penal[own] * w * w).sum(axis=1) / 2, (slope / total[:, None] + penal[own] * w) / unit

    value, slope = measure(at, np.arange(count))
    passes = 1
    steps, changes = np.zeros((2, MEMORY, count, width))
    used = np.zeros(count, dtype=int)
    length = 1 / np.maximum(np.linalg.norm(slope, axis=1), 1.0)
    direction = -slope
    # at zero coefficients the intercept's slope is a half minus the share of rows that have the class
    share = 0.5 - slope[:, -1]
    one_sided = (share < 1e-12) | (share > 1 - 1e-12)
    at[one_sided, -1] = np.where(share[one_sided] < 0.5, -CERTAIN, CERTAIN)
    slope[one_sided] = 0.0
    live = np.flatnonzero(np.abs(slope).max(axis=1) > tol)
    while len(live) and passes < max_passes:
        trial = at[live] + length[live][:, None] * direction[live]
        found, steep = measure(trial, live)
        passes += 1
        down = np.einsum("cd,cd->c", slope[live], direction[live])
        good = found <= value[live] + 1e-4 * length[live] * down
        # where losses agree to their rounding, a smaller slope decides
        level = np.abs(found - value[live]) <= 1e-10 * np.abs(value[live])
        good |= level & (np.linalg.norm(steep, axis=1) < np.linalg.norm(slope[live], axis=1))
        own = live[good]
        step, change = trial[good] - at[own], steep[good] - slope[own]
        at[own], value[own], slope[own] = trial[good], found[good], steep[good]
        curved = np.einsum("cd,cd->c", step, change) > 1e-14
        kept = own[curved]
        steps[1:, kept], changes[1:, kept] = steps[:-1, kept], changes[:-1, kept]
        steps[0, kept], changes[0, kept] = step[curved], change[curved]
        used[kept] += 1
        direction[own] = _direction(slope[own], steps[:, own], changes[:, own], used[own])
        # a fit that came to rest without curvature to learn from starts again downhill
        lost = own[np.einsum("cd,cd->c", slope[own], direction[own]) >= 0]
        direction[lost] = -slope[lost]
        length[own] = np.where(used[own] > 0, 1.0, 2 * length[own])
        length[live[~good]] /= 2
        # shortened several times without a change that can be told from rounding: as low as it gets
        resting = level & ~good & (length[live] < 0.05) | (length[live] < 1e-10)
        live = live[(np.abs(slope[live]).max(axis=1) > tol) & ~resting]
    return at / unit, np.abs(slope).max(axis=1), passes


def fit_labels(
    df: DataFrame, vec: str, labels: str, classes: Sequence[str], reg: float = 0.0, weight: str | None = None, tol: float = 1e-7, max_passes: int = 200
) -> LabelModels:
    """One binary logistic model per class of a fitted list, over rows with an array of labels.

    Each minimises the weighted mean of its log loss plus ``reg / 2`` times its squared coefficients (not the intercept).
    A null label array is an empty one, unseen labels are none, rows without a vector take no part. A class that every row has, or none,
    has no finite fit: it gets the intercept ``CERTAIN`` with that sign, and no coefficients. Of a class that is named twice only
    the first counts as seen. ``passes`` over the rows do not grow with the classes.
    """
    rows = materialize(_prepared(df, vec, labels, classes, weight, None))
    if not classes or rows.isEmpty():
        raise ValueError("nothing to fit")
    count = len(classes)
    found, slopes, passes = _fit_columns(rows, count, np.arange(count), np.full(count, -2), np.full(count, float(reg)), tol, max_passes)
    discard(rows)
    return LabelModels(list(classes), found[:, :-1], found[:, -1], passes, slopes)


def search_penalty(
    df: DataFrame, vec: str, labels: str, classes: Sequence[str], regs: Sequence[float], fold: str, tol: float = 1e-5, max_passes: int = 100
) -> tuple[LabelModels, DataFrame]:
    """Penalty with the best mean average precision on held-out folds, over all classes.

    All models, of every class, penalty and fold, are fitted in the same passes. Returns the models refitted on all rows at
    the best penalty, and (reg, fold, average_precision) rows.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    rows = materialize(_prepared(df, vec, labels, classes, None, fold))
    grid = [(r, f, c) for r in regs for f in folds for c in range(len(classes))]
    reg, skip, label = (np.array([g[i] for g in grid]) for i in range(3))
    found, _, passes = _fit_columns(rows, len(classes), label.astype(int), skip.astype(int), reg.astype(float), tol, max_passes)
    discard(rows)
    results = []
    for i, (r, f) in enumerate((r, f) for r in regs for f in folds):
        own = found[i * len(classes) : (i + 1) * len(classes)]
        model = LabelModels(list(classes), own[:, :-1], own[:, -1], passes)
        held = df.where(F.col(fold) == f).select(F.col(labels).alias("truth"), model.scores(vec).alias("scores"))
        results.append((float(r), int(f), float(macro_average_precision(held, "scores", "truth", list(classes)).first()[0] or 0.0)))
    best = max(regs, key=lambda r: np.mean([x[2] for x in results if x[0] == r]))
    table = df.sparkSession.createDataFrame(results, "reg double, fold int, average_precision double")
    return fit_labels(df, vec, labels, classes, best, tol=tol), table


def search_penalty_held(
    df: DataFrame, vec: str, labels: str, classes: Sequence[str], regs: Sequence[float], held: str, tol: float = 1e-5, max_passes: int = 100
) -> tuple[list[LabelModels], list[float]]:
    """Models of every penalty, fitted in the same passes on rows where ``held`` is not true, and their macro average precision on the others."""
    rows = materialize(_prepared(df.withColumn("_fold", F.coalesce(F.col(held), F.lit(False)).cast("int")), vec, labels, classes, None, "_fold"))
    grid = [(float(r), c) for r in regs for c in range(len(classes))]
    reg, label = np.array([g[0] for g in grid]), np.array([g[1] for g in grid])
    found, _, passes = _fit_columns(rows, len(classes), label, np.full(len(grid), 1), reg, tol, max_passes)
    discard(rows)
    models, scores = [], []
    for i in range(len(regs)):
        own = found[i * len(classes) : (i + 1) * len(classes)]
        models.append(LabelModels(list(classes), own[:, :-1], own[:, -1], passes))
        test = df.where(held).select(F.col(labels).alias("truth"), models[-1].scores(vec).alias("scores"))
        precision = macro_average_precision(test, "scores", "truth", list(classes)).first()[0]
        scores.append(float("nan") if precision is None else float(precision))
    return models, scores
