"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected on ``DIMS`` Gaussian directions. The projected distance of two vectors, squared and divided by
their squared distance, follows a chi-square law with DIMS degrees of freedom, so once the next projected
distance D satisfies  chi2_cdf((D / kth distance so far)**2) >= CONFIDENCE  a nearer vector among those
not yet seen is unlikely and the search stops.

Distributed: a kd-tree over a bounded sample of projections cuts the space into cells, and large cells into blocks
of bounded size. A query first searches one block of its own cell, which bounds its k-th distance; the stopping
test then is a radius in the projected space, and only the cells whose box it reaches are visited. In a block a
kd-tree of its projections feeds leaves in order of projected distance to exact verification until the test
holds. Equal vectors are folded first, so a very common vector is one point. No list of blocks, vectors or
results passes the driver; it sees the sample and one count per cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowlark.session import materialize

DIMS = 8
CONFIDENCE = 0.99
#: Distinct vectors the cell tree is fitted on, by hash order; every vector is indexed.
SAMPLE_ROWS = 50_000
BLOCK_ROWS = 8192
#: Queries that visit a block in one task; more of them get copies of the block.
VISIT_ROWS = 4096
LEAF_ROWS = 64
SEED = 17


def chi2_quantile(p: float, dims: int = DIMS) -> float:
    """Inverse of the chi-square distribution function for an even number of degrees of freedom."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projector(width: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, dims))


@dataclass
class CellTree:
    """Median splits of the sample, level by level: node i has children 2i+1 and 2i+2; leaves are the cells."""

    axis: np.ndarray
    cut: np.ndarray
    depth: int
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, cells: int) -> CellTree:
        dims = points.shape[1]
        depth = max(0, min(math.ceil(math.log2(max(1, cells))), int(math.log2(max(1, len(points) // 4)))))
        inner = (1 << depth) - 1
        axis, cut = np.zeros(inner, dtype=np.int64), np.zeros(inner)
        low, high = np.full((2 * inner + 1, dims), -np.inf), np.full((2 * inner + 1, dims), np.inf)
        members = {0: points}
        for node in range(inner):
            own = members.pop(node)
            axis[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
            cut[node] = np.median(own[:, axis[node]]) if len(own) else 0.0
            left = own[:, axis[node]] < cut[node]
            for child, part in ((2 * node + 1, own[left]), (2 * node + 2, own[~left])):
                members[child] = part
                low[child], high[child] = low[node], high[node]
            high[2 * node + 1, axis[node]] = low[2 * node + 2, axis[node]] = cut[node]
        return cls(axis, cut, depth, low[inner:], high[inner:])

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)

    def distance(self, point: np.ndarray) -> np.ndarray:
        """Squared projected distance of a point to the box of every cell."""
        return (np.maximum(np.maximum(self.low - point, point - self.high), 0.0) ** 2).sum(axis=1)


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree, split at the median of the widest axis."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF_ROWS:
            out.append(rows)
            continue
        own = points[rows]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(own[:, axis], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


class BlockIndex:
    """The kd-tree of one block and its incremental search."""

    def __init__(self, vectors: np.ndarray, first_id: np.ndarray, project: np.ndarray):
        self.vectors, self.first, self.project = vectors.astype(np.float64), first_id, project
        self.points = self.vectors @ project
        self.leaves = _leaves(self.points)
        self.low = np.array([self.points[r].min(axis=0) for r in self.leaves])
        self.high = np.array([self.points[r].max(axis=0) for r in self.leaves])

    def search(self, query: np.ndarray, k: int, bound: float, stretch: float) -> list[tuple[float, int]]:
        """At most ``k`` (squared distance, row) pairs, none beyond ``bound``; ``stretch`` is the chi-square quantile."""
        at = query @ self.project
        box = (np.maximum(np.maximum(self.low - at, at - self.high), 0.0) ** 2).sum(axis=1)
        best_d, best_r = np.empty(0), np.empty(0, dtype=np.int64)
        for leaf in np.argsort(box, kind="stable"):
            if box[leaf] > stretch * bound:
                break
            rows = self.leaves[leaf]
            near = ((self.points[rows] - at) ** 2).sum(axis=1) <= stretch * bound
            rows = rows[near]
            if not len(rows):
                continue
            exact = ((self.vectors[rows] - query) ** 2).sum(axis=1)
            best_d, best_r = np.concatenate([best_d, exact]), np.concatenate([best_r, rows])
            order = np.lexsort((self.first[best_r], best_d))[:k]
            best_d, best_r = best_d[order], best_r[order]
            if len(best_d) == k:
                bound = min(bound, best_d[-1])
        fits = best_d <= bound
        return list(zip(best_d[fits].tolist(), best_r[fits].tolist(), strict=True))


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _placed(df: DataFrame, tree, project: np.ndarray) -> DataFrame:
    """Adds the cell of column ``vec``."""
    at = df.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            cell = tree.value.cell_of(flat.reshape(batch.num_rows, -1) @ project) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"]
            )

    return df.mapInArrow(run, df.withColumn("cell", F.lit(0)).schema)


_FOUND = "q1 long, q2 long, dist double, ids array<long>"


def _search_blocks(points: DataFrame, visits: DataFrame, k: int, stretch: float, project: np.ndarray) -> DataFrame:
    """Search the blocks that ``visits`` (q1, q2, vec, bound, block) name; k candidates per query and block."""
    load = materialize(visits.groupBy("block").agg(F.ceil(F.count("*") / VISIT_ROWS).cast("int").alias("parts")))
    split = visits.join(load, "block").withColumn("part", F.pmod(F.xxhash64("q1", "q2"), F.col("parts")).cast("int"))
    copies = points.join(load, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def run(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block):
            return pd.DataFrame({"q1": [], "q2": [], "dist": [], "ids": []})
        ids = block["ids"].tolist()
        index = BlockIndex(np.stack(block["vec"].to_list()), np.array([i[0] for i in ids]), project)
        rows = []
        for q1, q2, vec, bound in zip(asked["q1"], asked["q2"], asked["vec"], asked["bound"], strict=True):
            for d, r in index.search(np.asarray(vec, dtype=np.float64), k, bound, stretch):
                rows.append((q1, q2, math.sqrt(d), ids[r]))
        return pd.DataFrame(rows, columns=["q1", "q2", "dist", "ids"])

    return (
        split.select("block", "part", "q1", "q2", "vec", "bound").groupBy("block", "part")
        .cogroup(copies.select("block", "part", "vec", "ids").groupBy("block", "part"))
        .applyInPandas(run, _FOUND)
    )


def nearest(
    df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", confidence: float = CONFIDENCE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query row, Euclidean, exact scores.

    Ties go to the smaller id; a row is never its own neighbour; fewer candidates than ``k`` are all returned. Rows
    with a null id, or with a null, empty, zero or non-finite vector, or one whose length differs from the most frequent
    length, take no part. Repeated (id, vector) rows count once. Other columns are not read.
    """
    v = F.col("vec").cast("array<double>")
    rows = df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    good = rows.where(F.col("id").isNotNull() & usable(F.col("vec"))).withColumns(
        {"k1": F.xxhash64(v), "k2": F.xxhash64(v, F.lit(7))}
    )
    width = good.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    spark = df.sparkSession
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.size("vec") == width[0])
    once = good.groupBy("k1", "k2", "id").agg(F.any_value("vec").alias("vec"), F.bool_or("asks").alias("asks"))
    settled = materialize(once)
    # of equal vectors only the k + 1 smallest ids can be among the nearest; cut before the shuffle
    by_vec = Window.partitionBy("k1", "k2").orderBy("id")
    few = settled.withColumn("n", F.row_number().over(by_vec)).where(F.col("n") <= k + 1)
    distinct = few.groupBy("k1", "k2").agg(F.any_value("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids"))
    points = materialize(distinct)

    total = points.count()
    sample = points.orderBy("k1", "k2").limit(SAMPLE_ROWS).select("vec").toPandas()["vec"]
    project = projector(width[0])
    tree = CellTree.fit(np.stack(sample.to_list()).astype(np.float64) @ project, -(-total // BLOCK_ROWS))
    shared = spark.sparkContext.broadcast(tree)
    placed = materialize(_placed(points, shared, project))
    # one row per cell, at most SAMPLE_ROWS / 4 of them
    cells = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    cells = F.broadcast(materialize(cells))
    block = F.struct("cell", F.pmod(F.xxhash64("k1", "k2", F.lit(3)), F.col("blocks")).cast("int").alias("n"))
    blocks = placed.join(cells, "cell").select(block.alias("block"), "vec", "ids")

    asked = settled.where("asks").select("id", F.col("k1").alias("q1"), F.col("k2").alias("q2"), "vec")
    wanted = asked.groupBy("q1", "q2").agg(F.any_value("vec").alias("vec"))
    home = materialize(_placed(wanted, shared, project))
    stretch = chi2_quantile(confidence)
    first_visit = home.join(cells, "cell").select(
        "q1", "q2", "vec", F.lit(float("inf")).alias("bound"), F.struct("cell", F.lit(0).alias("n")).alias("block")
    )
    first = materialize(_search_blocks(blocks, first_visit, k + 1, stretch, project))
    bounds = first.groupBy("q1", "q2").agg(F.max("dist").alias("far"), F.count("*").alias("n"))
    bounded = home.join(bounds.withColumnsRenamed({"q1": "b1", "q2": "b2"}), (F.col("q1") == F.col("b1")) & (F.col("q2") == F.col("b2")), "left")
    # a bound a hair above the k-th distance, so that ties beyond it are still found
    reach = F.when(F.col("n") > k, F.col("far") * F.col("far") * (1 + 1e-9)).otherwise(float("inf"))
    bounded = bounded.select("q1", "q2", "vec", F.col("cell").alias("own"), reach.alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, near = [], []
            for i in range(batch.num_rows):
                at = np.asarray(batch.column(2)[i].values, dtype=np.float64) @ project
                found = np.flatnonzero(shared.value.distance(at) <= stretch * batch.column(4)[i].as_py())
                rows += [i] * len(found)
                near += found.tolist()
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near, pa.int32())], [*out.schema.names, "cell"])

    routed = bounded.mapInArrow(route, bounded.withColumn("cell", F.lit(0)).schema)
    visits = (
        routed.join(cells, "cell")
        .select("q1", "q2", "vec", "bound", "own", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("n"))
        .where("cell <> own OR n > 0")
        .select("q1", "q2", "vec", "bound", F.struct("cell", "n").alias("block"))
    )
    second = _search_blocks(blocks, materialize(visits), k + 1, stretch, project)

    place = F.row_number().over(Window.partitionBy("q1", "q2").orderBy("dist", F.col("ids")[0]))
    best = first.unionByName(second).withColumn("n", place).where(F.col("n") <= k + 1)
    pairs = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("dist").alias("score"), i.alias("vec_id")))))
    lists = materialize(best.groupBy("q1", "q2").agg(F.array_sort(pairs).alias("near")))
    own = F.slice(F.filter("near", lambda p: p["vec_id"] != F.col("id")), 1, k)
    return (
        asked.join(lists, ["q1", "q2"])
        .select(F.col("id").alias("query_id"), F.posexplode(own).alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
    )
