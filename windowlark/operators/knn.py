"""Nearest neighbours by routing queries to blocks, exact with pruning or bounded by probes (K1, K6).

Shape of the job:

1. Equal vectors are folded into one, keeping only the ids that can still be among the nearest
   (ties go to the smaller id), so copies of a vector cost nothing extra.
2. Every distinct vector is assigned to a pivot, found over two levels of pivots, and the table is
   range-partitioned by (pivot, distance to pivot). Each partition is cut into blocks of at most ``block`` rows that
   share a pivot and a ring of distances. A pivot that attracts a third of the data just gets more blocks.
3. Every query bounds its k-th distance twice: by the pivots whose cells together hold k vectors, then by searching
   the one block whose ring it falls in.
4. By the triangle inequality a cell, and in it a ring, can only hold a closer vector if its lower bound is within
   that distance. Queries that lie together form a tile; a block is sent once to every tile that has a query for it, and there
   meets only the queries that still need it, in matrix products. A bound shrinks as blocks are met, and a tile hands on
   the k nearest of each query only. With ``probes`` a query is sent to the few blocks that it chose instead; a block
   that many queries choose is copied once per ``VISITS`` of them.

So the exact search moves each vector at most once per tile, however little there is to prune: the number of tiles follows the cores,
until a tile is full at ``TILE`` queries. No cross join is planned and no pair of vectors is materialised. What is
broadcast are pivots, at most ``PIVOT_BYTES``, and four numbers per block (28 bytes for up to ``block`` vectors).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windowlark.session import materialize

# pivots are a sample of base vectors that every task holds
PIVOT_BYTES = 64 << 20
# queries that one copy of a block serves
VISITS = 4096
# queries that meet a block in one matrix product
TOGETHER = 512
# pivots for each block that the base rows fill: more give tighter rings but smaller blocks
PIVOTS_PER_BLOCK = 4
# entries of one distance matrix in a task (8 MB of doubles)
MATRIX_CELLS = 1_000_000
# queries of one tile of the exact search at most, and at least before there are more tiles than cores
TILE = 65_536
SMALL_TILE = 256
# base vectors that meet a tile in one matrix product
RUN = 2048
# vectors that are measured by differences at once
MEASURED = 16_384
# relative slack that covers rounding in the distance bounds and in the matrix product
SLACK = 1e-9

# the task helpers below travel with the job, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _matrix(flat: pa.ListScalar | np.ndarray, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=np.float64).reshape(n, -1)


def _lists(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """Zero-copy slices of a list column without nulls inside."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and a bound on their rounding error per row."""
    xx, yy = np.einsum("ij,ij->i", x, x)[:, None], np.einsum("ij,ij->i", y, y)
    return xx + yy - 2.0 * (x @ y.T), 1e-10 * (xx + yy.max() + 1.0)


def _pivot_range(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of rows to pivots."""
    square, error = _squares(x, pivots)
    return np.sqrt(np.maximum(square - error, 0.0)), np.sqrt(np.maximum(square + error, 0.0))


class _Best:
    """The k nearest base vectors so far for every query of a block."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray):
        self.ids, self.k = ids, k
        # a last entry of -1/2 meets the square of a base vector: one product then ranks and needs no further pass
        self.wide = np.hstack([q, np.full((len(q), 1), -0.5)])
        self.q = self.wide[:, :-1]
        self.square = np.einsum("ij,ij->i", self.q, self.q)
        self.bound = bound.copy()
        self.dist = np.full((len(ids), k), np.inf)
        self.near = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, b_ids: np.ndarray, x: np.ndarray, live: np.ndarray) -> None:
        """Search a base block for the queries in ``live``, a slice at a time."""
        square = np.einsum("ij,ij->i", x, x)
        wide = np.hstack([x, square[:, None]])
        step = max(1, MATRIX_CELLS // len(x))
        for a in range(0, len(live), step):
            self._meet(b_ids, x, wide, square.max(), live[a : a + step])

    def _meet(self, b_ids: np.ndarray, x: np.ndarray, wide: np.ndarray, largest: float, live: np.ndarray) -> None:
        # the matrix product only preselects; what is near the cut is measured again by differences
        together = live[-1] - live[0] + 1 == len(live)
        score = (self.wide[live[0] : live[-1] + 1] if together else self.wide[live]) @ wide.T
        own = self.square[live]
        room = 1e-10 * (own + largest + 1.0)
        hit = score >= ((own - np.square(self.bound[live]) - room) / 2)[:, None]
        if len(x) > self.k and np.count_nonzero(hit) > 4 * self.k * len(live):
            kth = np.partition(score, len(x) - self.k, axis=1)[:, len(x) - self.k]
            hit &= score >= (kth - room)[:, None]
        at = np.flatnonzero(hit)
        if not len(at):
            return
        rows, cols = at // len(x), at % len(x)
        dist = np.empty(len(at))
        for a in range(0, len(at), MEASURED):
            d = self.q[live[rows[a : a + MEASURED]]] - x[cols[a : a + MEASURED]]
            dist[a : a + MEASURED] = np.sqrt(np.einsum("ij,ij->i", d, d))
        keep = dist <= self.bound[live][rows]
        rows, cols, dist = rows[keep], cols[keep], dist[keep]
        touched, slot = np.unique(rows, return_inverse=True)
        if not len(touched):
            return
        own = live[touched]
        row = np.concatenate([slot, np.repeat(np.arange(len(own)), self.k)])
        dist = np.concatenate([dist, self.dist[own].ravel()])
        near = np.concatenate([b_ids[cols], self.near[own].ravel()])
        order = np.lexsort((near, dist, row))
        row, dist, near = row[order], dist[order], near[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        self.dist[own] = dist[first].reshape(len(own), self.k)
        self.near[own] = near[first].reshape(len(own), self.k)
        self.bound[own] = np.minimum(self.bound[own], self.dist[own, -1])

    def edges(self) -> pa.RecordBatch:
        found = np.isfinite(self.dist)
        reps = np.repeat(self.ids, found.sum(axis=1))
        columns = [pa.array(reps, pa.int64()), pa.array(self.near[found]), pa.array(self.dist[found])]
        return pa.RecordBatch.from_arrays(columns, ["rep", "base_rep", "distance"])


def fold_equal(df: DataFrame, id_col: str, vec: str, keep: int) -> DataFrame:
    """One row per distinct vector: ``rep`` (its smallest id), ``vec``, ``same`` (its ``keep`` smallest ids).

    More than ``keep`` equal vectors cannot all be among the nearest, so the rest is not needed as a
    base. The row limit is applied map-side, before the shuffle, so a vector that a third of the rows
    share sends ``keep`` rows per task.
    """
    place = F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))
    few = _keyed(df, id_col, vec).withColumn("place", place).where(F.col("place") <= keep)
    same = F.array_sort(F.collect_list("id"))
    return few.groupBy("h", "g").agg(same.alias("same"), F.any_value("vec").alias("vec")).select(
        F.array_min("same").alias("rep"), "vec", "same", "h", "g"
    )


def _keyed(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, vec, h, g): two differently seeded 64-bit hashes stand for the vector as a key, so that
    vectors are neither compared nor shuffled to find equal ones."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("vec"))
    return rows.where("vec is not null").withColumns({"h": F.xxhash64("vec"), "g": F.xxhash64(F.lit(1), "vec")})


def _choose_pivots(base: DataFrame, count: int, block: int, seed: int = 0) -> np.ndarray:
    """A hash-ordered sample, small enough for the driver and every task by ``PIVOT_BYTES``; other seeds, other samples."""
    width = max(1, base.select(F.size("vec")).first()[0]) if count else 1
    wanted = max(1, min(PIVOT_BYTES // (8 * width), math.ceil(PIVOTS_PER_BLOCK * count / block), 4 * math.isqrt(count) + 1))
    mixed = F.xxhash64("rep", F.lit(seed)) if seed else F.xxhash64("rep")
    rows = base.select("rep", "vec").orderBy(mixed, "rep").limit(wanted).collect()
    return np.array([r["vec"] for r in rows], dtype=np.float64)


def _groups(pivots: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Two levels: the first pivots lead groups, every pivot belongs to its nearest leader."""
    leaders = pivots[: math.isqrt(len(pivots)) + 1]
    nearest = np.concatenate([_squares(pivots[i : i + 4096], leaders)[0].argmin(axis=1) for i in range(0, len(pivots), 4096)])
    return leaders, [np.flatnonzero(nearest == g) for g in range(len(leaders))]


def _assign(x: np.ndarray, pivots: np.ndarray, groups: tuple[np.ndarray, list[np.ndarray]]) -> np.ndarray:
    """A near pivot of every row: the nearest in the group of the nearest leader. Any choice is correct."""
    leaders, members = groups
    lead = _squares(x, leaders)[0].argmin(axis=1)
    cell = np.empty(len(x), dtype=np.int64)
    for g in np.unique(lead):
        at = np.flatnonzero(lead == g)
        cell[at] = members[g][_squares(x[at], pivots[members[g]])[0].argmin(axis=1)]
    return cell


def _cut_blocks(df: DataFrame, pivots: Broadcast, block: int) -> DataFrame:
    """(rep, vec) rows to blocks of one pivot and one ring of distances; entries keep their type."""
    kind = dict(df.dtypes)["vec"]
    entry = pa.float32() if kind == "array<float>" else pa.float64()
    layout = pa.schema(
        [
            ("block", pa.int64()), ("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64()),
            ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("flat", pa.list_(entry)),
        ]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = None
        for batch in batches:
            groups = groups or _groups(pivots.value)
            if not batch.num_rows:
                continue
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            x = _matrix(flat, batch.num_rows)
            # a near tie may go to either pivot; the distance to the chosen one is exact
            cell = _assign(x, pivots.value, groups)
            d = x - pivots.value[cell]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rep"),
                    batch.column("vec"),
                    pa.array(cell.astype(np.int32)),
                    pa.array(np.sqrt(np.einsum("ij,ij->i", d, d))),
                ],
                ["rep", "vec", "cell", "r"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        made = 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, made
            ids, flat, r = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            row = {
                "block": [base + made], "cell": [held[0][0]], "low": [float(r.min())], "high": [float(r.max())],
                "n": [len(ids)], "ids": [ids], "flat": [flat],
            }
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_pydict(row, schema=layout)

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            ids = batch.column("rep").to_numpy(zero_copy_only=False)
            r = batch.column("r").to_numpy(zero_copy_only=False)
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            at = 0
            while at < len(ids):
                if held and held[0][0] != int(cells[at]):
                    yield flush()
                end = int(np.searchsorted(cells[at:], cells[at], side="right")) + at
                end = min(end, at + block - size)
                held.append((int(cells[at]), ids[at:end], x[at:end].ravel(), r[at:end]))
                size += end - at
                at = end
                if size >= block:
                    yield flush()
        if held:
            yield flush()

    placed = df.select("rep", "vec").mapInArrow(assign, f"rep bigint, vec {kind}, cell int, r double")
    ranged = placed.repartitionByRange("cell", "r", "rep").sortWithinPartitions("cell", "r", "rep")
    return materialize(
        ranged.mapInArrow(
            pack, f"block bigint, cell int, low double, high double, n int, ids array<bigint>, flat {kind}"
        )
    )


@dataclass
class _Cells:
    """The pivots that have vectors, with the count and the distances of those, and the rings of each in order of distance."""

    cell: np.ndarray
    pivots: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    # one entry per ring (a block): its place in the arrays above; rings of cell i start at first[i]
    first: np.ndarray
    place: np.ndarray
    block: np.ndarray
    ring_low: np.ndarray
    ring_high: np.ndarray

    def upper(self, far: np.ndarray, k: int) -> np.ndarray:
        """For each query a distance within which cells hold k vectors; infinite if there are fewer."""
        reach = far + self.high
        order = np.argsort(reach, axis=1)
        enough = np.take_along_axis(np.broadcast_to(self.n, reach.shape), order, axis=1).cumsum(axis=1) >= k
        at = np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1)
        return np.where(enough[:, -1], np.take_along_axis(reach, at, axis=1)[:, 0], np.inf)

    def home(self, own: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The ring of cell ``own`` that holds the distance ``r``: the last that starts at or below it, else the first."""
        out = np.empty(len(own), dtype=np.int64)
        for c in np.unique(own):
            at = np.flatnonzero(own == c)
            starts = self.ring_low[self.first[c] : self.first[c + 1]]
            out[at] = self.first[c] + np.maximum(np.searchsorted(starts, r[at], side="right") - 1, 0)
        return out

    def gap(self, q: np.ndarray, rings: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of queries to the vectors of some rings."""
        cells, at = np.unique(self.place[rings], return_inverse=True)
        near, far = _pivot_range(q, self.pivots[cells])
        return np.maximum(near[:, at] - self.ring_high[rings], self.ring_low[rings] - far[:, at])


def _cells(blocks: DataFrame, pivots: np.ndarray) -> _Cells:
    """One row per block, without its vectors, reaches the driver."""
    rows = blocks.select("block", "cell", "low", "high", "n").toPandas().sort_values(["cell", "low", "block"])
    block, every, low, high, n = (rows[c].to_numpy() for c in ("block", "cell", "low", "high", "n"))
    cell, first, place = np.unique(every.astype(np.int64), return_index=True, return_inverse=True)
    return _Cells(
        cell, pivots[cell], np.add.reduceat(n.astype(np.int64), first), np.fmin.reduceat(low, first), np.maximum.reduceat(high, first),
        np.append(first, len(block)), place.astype(np.int32), block, low, high,
    )


def _width(queries: DataFrame) -> int:
    return 3 * queries.sparkSession.sparkContext.defaultParallelism


def _visit(base: DataFrame, queries: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """(rep, base_rep, distance): per query and block in ``visits`` (rep, bound, block), at most k within the bound."""
    load = materialize(visits.groupBy("block").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("parts")).cast("int")
    asked = visits.join(load, "block").select("block", part.alias("part"), "rep", "bound").join(queries.select("rep", "vec"), "rep")
    asked = asked.select("block", "part", F.lit(1).alias("kind"), F.array("rep").alias("ids"), F.col("vec").alias("flat"), "bound")
    copies = base.join(load, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "ids", "flat",
        F.lit(0.0).alias("bound"),
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block, then the queries that visit it, a few hundred at once."""
        b_ids = x = None
        held: list[tuple] = []

        def search() -> pa.RecordBatch:
            best = _Best(np.concatenate([h[0] for h in held]), np.array([h[1] for h in held], dtype=np.float64), k, np.array([h[2] for h in held]))
            best.meet(b_ids, x, np.arange(len(held)))
            held.clear()
            return best.edges()

        for batch in batches:
            ids, flat = _lists(batch.column("ids")), _lists(batch.column("flat"))
            kinds, bounds = batch.column("kind").to_pylist(), batch.column("bound").to_pylist()
            for i, kind in enumerate(kinds):
                if kind == 0:
                    if held:
                        yield search()
                    b_ids, x = ids[i], _matrix(flat[i], len(ids[i]))
                else:
                    held.append((ids[i], flat[i], bounds[i]))
                    if len(held) >= TOGETHER:
                        yield search()
        if held:
            yield search()

    ordered = asked.unionByName(copies).repartition("block", "part").sortWithinPartitions("block", "part", "kind")
    return ordered.mapInArrow(stream, "rep bigint, base_rep bigint, distance double")


def _sweep(base: DataFrame, bounded: DataFrame, shared: Broadcast, count: int, k: int) -> DataFrame:
    """(rep, base_rep, distance): the k nearest within the bound of every query in ``bounded`` (rep, vec, ring, bound).

    Queries are cut into tiles along the rings; a tile gets, once, each block that one of its queries may need.
    """
    tiles = max(1, -(-count // TILE), min(_width(bounded), -(-count // SMALL_TILE)))
    tiled = bounded.repartitionByRange(tiles, "ring", "rep").select(F.spark_partition_id().alias("tile"), "rep", "vec", "bound")
    tiled = materialize(tiled)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The (tile, block) pairs in which a ring may hold a vector within the bound of a query."""
        cells = None
        needed: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = cells or _Cells(*shared.value)
            tile, bound = batch.column("tile").to_numpy(), batch.column("bound").to_numpy()
            vectors = _lists(batch.column("vec"))
            for t in np.unique(tile).tolist():
                at = np.flatnonzero(tile == t)
                known = needed.setdefault(t, np.zeros(len(cells.block), dtype=bool))
                while len(at) and not known.all():
                    todo = np.flatnonzero(~known)
                    # without structure a few queries need everything
                    some, at = np.split(at, [min(512, max(1, MATRIX_CELLS // len(todo)))])
                    gap = cells.gap(np.array([vectors[i] for i in some], dtype=np.float64), todo)
                    known[todo] = (gap <= bound[some, None]).any(axis=0)
        for t, known in needed.items():
            found = cells.block[known]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), t, dtype=np.int32))], ["block", "tile"])

    wanted = tiled.mapInArrow(reach, "block bigint, tile int").groupBy("block").agg(F.collect_set("tile").alias("tiles"))
    asked = tiled.select(
        "tile", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("block"), F.lit(-1).alias("cell"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"),
        F.array("rep").alias("ids"), F.col("vec").alias("flat"), "bound",
    )
    copies = base.join(wanted, "block").select(
        F.explode("tiles").alias("tile"), F.lit(1).alias("kind"), "block", "cell", "low", "high", "ids", "flat", F.lit(0.0).alias("bound")
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of a tile, then the blocks sent to it."""
        cells = tile = best = seen = near = far = None
        held: list[tuple] = []
        run: list[tuple] = []

        def meet() -> None:
            if run:
                best.meet(np.concatenate([r[0] for r in run]), np.concatenate([r[1] for r in run]), np.arange(len(best.ids)))
                run.clear()

        def edges() -> Iterator[pa.RecordBatch]:
            meet()
            table = best.edges()
            for a in range(0, table.num_rows, 100_000):
                yield table.slice(a, 100_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = cells or _Cells(*shared.value)
            tiles, kinds, bounds = batch.column("tile").to_pylist(), batch.column("kind").to_pylist(), batch.column("bound").to_pylist()
            owner, low, high = batch.column("cell").to_numpy(), batch.column("low").to_numpy(), batch.column("high").to_numpy()
            ids, flat = _lists(batch.column("ids")), _lists(batch.column("flat"))
            for i, kind in enumerate(kinds):
                if tiles[i] != tile:
                    if best:
                        yield from edges()
                    tile, best, seen = tiles[i], None, None
                    held.clear()
                if kind == 0:
                    held.append((ids[i], np.array(flat[i]), bounds[i]))
                    continue
                if best is None:
                    vectors = np.array([h[1] for h in held], dtype=np.float64)
                    best = _Best(np.concatenate([h[0] for h in held]), vectors, k, np.array([h[2] for h in held]))
                    del vectors
                    held.clear()
                if seen != owner[i]:
                    seen = owner[i]
                    pivot = cells.pivots[np.searchsorted(cells.cell, seen)][None]
                    near, far = (x[:, 0] for x in _pivot_range(best.q, pivot))
                live = np.flatnonzero(np.maximum(near - high[i], low[i] - far) <= best.bound)
                if 2 * len(live) > len(best.ids):
                    # most queries need it: it meets all of them, with its neighbours
                    run.append((ids[i].copy(), _matrix(flat[i], len(ids[i]))))
                    if sum(len(r[0]) for r in run) >= RUN:
                        meet()
                elif len(live):
                    best.meet(ids[i], _matrix(flat[i], len(ids[i])), live)
        if best:
            yield from edges()

    ordered = asked.unionByName(copies).repartition(2 * tiles, "tile").sortWithinPartitions("tile", "kind", "block")
    return ordered.mapInArrow(stream, "rep bigint, base_rep bigint, distance double")


def _search(queries: DataFrame, base: DataFrame, pivots: np.ndarray, k: int, probes: int | None) -> DataFrame:
    """(rep, base_rep, distance): at least the k nearest distinct base vectors of every query vector.

    With ``probes`` a query visits its home block and so many more, nearest ring first (approximate).
    """
    known = _cells(base, pivots)
    if probes is not None and probes >= len(known.block):
        probes = None
    # as plain arrays, so that executors need no installed package
    shared = queries.sparkSession.sparkContext.broadcast(tuple(getattr(known, f.name) for f in fields(known)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ring of the nearest cell that a query falls in, and the first bound."""
        cells = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = cells or _Cells(*shared.value)
            q = np.array(_lists(batch.column("vec")), dtype=np.float64)
            step = max(1, MATRIX_CELLS // len(cells.cell))
            for a in range(0, len(q), step):
                near, far = _pivot_range(q[a : a + step], cells.pivots)
                own = near.argmin(axis=1)
                r = near[np.arange(len(own)), own]
                # a vector that is not a number lies in no ring
                there = np.flatnonzero(~np.isnan(r))
                bound = cells.upper(far, k)[there] * (1 + SLACK) + SLACK
                ring = cells.home(own[there], r[there])
                columns = batch.select(["rep", "vec"]).take(pa.array(there + a)).columns
                names = ["rep", "vec", "ring", "block", "bound"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ring), pa.array(cells.block[ring]), pa.array(bound)], names)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``probes`` nearest rings within the bound, apart from the home ring; equally near ones by block."""
        cells = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = cells or _Cells(*shared.value)
            q = np.array(_lists(batch.column("vec")), dtype=np.float64)
            bound, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bound", "ring"))
            every = np.arange(len(cells.block))
            step = max(1, MATRIX_CELLS // len(every))
            for a in range(0, len(q), step):
                gap = cells.gap(q[a : a + step], every)
                gap[~(gap <= bound[a : a + step, None])] = np.inf
                gap[np.arange(len(gap)), home[a : a + step]] = np.inf
                cut = np.partition(gap, probes - 1, axis=1)[:, probes - 1 : probes] if probes else np.full((len(gap), 1), -np.inf)
                row, ring = np.nonzero((gap <= cut) & (gap < np.inf))
                order = np.lexsort((cells.block[ring], gap[row, ring], row))
                row, ring = row[order], ring[order]
                few = np.arange(len(row)) - np.searchsorted(row, row) < probes
                row, ring = row[few], ring[few]
                columns = batch.select(["rep", "bound"]).take(pa.array(row + a)).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cells.block[ring])], ["rep", "bound", "block"])

    kind = dict(queries.dtypes)["vec"]
    spread = queries.select("rep", "vec").repartition(_width(queries))
    home = materialize(spread.mapInArrow(place, f"rep bigint, vec {kind}, ring bigint, block bigint, bound double"))
    first = materialize(_visit(base, home, home.select("rep", "bound", "block"), k))
    # k found: the k-th distance bounds the rest
    kth = first.groupBy("rep").agg(F.count("*").alias("found"), F.max("distance").alias("kth"))
    tighter = F.when(F.col("found") >= k, F.least("bound", F.col("kth") * (1 + SLACK) + SLACK)).otherwise(F.col("bound"))
    bounded = home.join(kth, "rep", "left").select("rep", "vec", "ring", tighter.alias("bound"))
    if probes is None:
        return _sweep(base, bounded, shared, home.count(), k)
    more = materialize(bounded.mapInArrow(route, "rep bigint, bound double, block bigint"))
    return first.unionByName(_visit(base, home, more, k))


def _neighbors(
    queries: DataFrame,
    base: DataFrame | None,
    id_col: str,
    vec: str,
    k: int,
    include_self: bool,
    block: int,
    probes: int | None,
) -> DataFrame:
    spark = queries.sparkSession
    alone = base is None
    want = k if include_self or not alone else k + 1
    folded_base = materialize(fold_equal(queries if alone else base, id_col, vec, want))
    count = folded_base.count()
    if not count:
        return spark.createDataFrame([], "id bigint, neighbors array<bigint>, distances array<double>")
    pivots = _choose_pivots(folded_base, count, block)
    shared = spark.sparkContext.broadcast(pivots)
    base_blocks = _cut_blocks(folded_base, shared, block)
    folded = folded_base if alone else materialize(fold_equal(queries, id_col, vec, 1))
    pairs = _search(folded, base_blocks, pivots, want, probes)

    return _open(pairs, queries, folded, folded_base, id_col, vec, want, k, drop_self=alone and not include_self)


def _open(
    pairs: DataFrame, queries: DataFrame, folded: DataFrame, folded_base: DataFrame, id_col: str, vec: str, want: int, k: int, drop_self: bool
) -> DataFrame:
    """Neighbour lists of rows from (rep, base_rep, distance) pairs of distinct vectors."""
    nearest = Window.partitionBy("rep").orderBy("distance", "base_rep")
    few = pairs.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= want)
    ids = folded_base.select(F.col("rep").alias("base_rep"), "same")
    opened = few.join(ids, "base_rep").select("rep", "distance", F.explode("same").alias("neighbor_id"))
    # at most want * want rows per vector reach this step
    best = Window.partitionBy("rep").orderBy("distance", "neighbor_id")
    edges = opened.withColumn("place", F.row_number().over(best)).where(F.col("place") <= want)
    lists = edges.groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near")
    )
    # back from distinct vectors to rows, by key only
    owned = folded.select("rep", "h", "g").join(lists, "rep")
    rows = _keyed(queries, id_col, vec).drop("vec").join(owned, ["h", "g"]).select("id", "near")
    if drop_self:
        rows = rows.withColumn("near", F.filter("near", lambda e: e["neighbor_id"] != F.col("id")))
    # a graph is read several times (votes, distances, gaps) but must be searched once
    return materialize(
        rows.select(
            "id",
            F.slice(F.col("near.neighbor_id"), 1, k).alias("neighbors"),
            F.slice(F.col("near.distance"), 1, k).alias("distances"),
        )
    )


def knn_exact(
    df: DataFrame, id_col: str, vec: str, k: int, include_self: bool = True, block: int = 2048
) -> DataFrame:
    """(id, neighbors, distances): the k nearest rows by (distance, id), Euclidean, ids unique, as a written table.

    ``include_self`` lets a row be its own neighbour, as when an index is queried with its own points.
    """
    return _neighbors(df, None, id_col, vec, k, include_self, block, None)


def knn_probe(
    df: DataFrame, id_col: str, vec: str, k: int, probes: int = 8, include_self: bool = True, block: int = 2048
) -> DataFrame:
    """Approximate variant for large tables: each vector visits its home block and at most ``probes`` more, the
    nearest rings first. With as many probes as there are blocks the result is exact."""
    return _neighbors(df, None, id_col, vec, k, include_self, block, probes)


def knn_between(
    queries: DataFrame, base: DataFrame, id_col: str, vec: str, k: int, block: int = 2048
) -> DataFrame:
    """Nearest rows of ``base`` for each row of ``queries``."""
    return _neighbors(queries, base, id_col, vec, k, True, block, None)


def edges_long(graph: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, pos, neighbor_id, distance) rows, ``pos`` 0-based (K2)."""
    return graph.select(id_col, F.posexplode(F.arrays_zip("neighbors", "distances")).alias("pos", "_e")).select(
        id_col, "pos", F.col("_e.neighbors").alias("neighbor_id"), F.col("_e.distances").alias("distance")
    )


def edges_nested(edges: DataFrame) -> DataFrame:
    """Adjacency arrays from long edges; k bounds the arrays (K2)."""
    item = F.array_sort(F.collect_list(F.struct("pos", "neighbor_id", "distance")))
    return edges.groupBy("id").agg(item.alias("_e")).select(
        "id", F.col("_e.neighbor_id").alias("neighbors"), F.col("_e.distance").alias("distances")
    )
