"""Frequent item sets and rules over vertical bitmaps.

Baskets are cut into segments of a fixed number of rows. In a segment every frequent item is a bitmap of its rows, so a basket
adds one bit per item however many items it has, and no pairs are ever made of a basket. Sets grow level by level: frequent sets that share all
but their last item are joined, candidates with an infrequent part go, and a candidate's rows in a segment are the
bits left of its items' bitmaps. A task counts all its segments and sends one number per candidate.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowlark.operators.ordered import assign_row_id
from windowlark.session import discard, materialize

#: Rows of a segment: a bitmap has an eighth of that in bytes.
SEGMENT = 1 << 15
#: Candidates counted in one pass over the bitmaps; they are broadcast, further ones take further passes.
CANDIDATES = 200_000
#: Candidates whose bitmaps are cut at once in a task.
TOGETHER = 512

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _bitmaps(entries: DataFrame) -> DataFrame:
    """(segment, ix, bits) from (segment, place, ix) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def packed() -> pa.RecordBatch:
            ix, place = (np.concatenate([h[i] for h in held]) for i in range(2))
            held.clear()
            items, row = np.unique(ix, return_inverse=True)
            bits = np.zeros((len(items), SEGMENT // 8), dtype=np.uint8)
            np.bitwise_or.at(bits, (row, place >> 3), (1 << (place & 7)).astype(np.uint8))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(items), key)), pa.array(items), pa.array([b.tobytes() for b in bits], pa.binary())], ["segment", "ix", "bits"]
            )

        for batch in batches:
            segment, place, ix = (c.to_numpy() for c in batch.columns)
            cuts = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), len(segment)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and segment[a] != key:
                    yield packed()
                key = int(segment[a])
                held.append((ix[a:b], place[a:b]))
        if held:
            yield packed()

    return entries.select("segment", "place", "ix").mapInArrow(run, "segment long, ix int, bits binary")


def _counted(bitmaps: DataFrame, candidates: np.ndarray, numbers: np.ndarray) -> DataFrame:
    """(at, n): rows that hold all items of the candidate with number ``at``."""
    shared = bitmaps.sparkSession.sparkContext.broadcast((candidates, numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, numbers = shared.value
        totals = np.zeros(len(wanted), dtype=np.int64)
        key, items, bits = None, [], []

        def count() -> None:
            own = np.concatenate(items)
            table = np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(len(own), -1)
            slot = np.full(max(int(wanted.max()), int(own.max())) + 1, -1)
            slot[own] = np.arange(len(own))
            rows = slot[wanted]
            here = np.flatnonzero((rows >= 0).all(axis=1))
            for a in range(0, len(here), TOGETHER):
                some = here[a : a + TOGETHER]
                left = table[rows[some, 0]]
                for j in range(1, wanted.shape[1]):
                    left = left & table[rows[some, j]]
                totals[some] += np.bitwise_count(left).sum(axis=1, dtype=np.int64)

        for batch in batches:
            segment = batch.column(0).to_numpy()
            ix, raw = batch.column(1).to_numpy(), batch.column(2)
            cuts = [0, *(np.flatnonzero(segment[1:] != segment[:-1]) + 1).tolist(), len(segment)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if items and segment[a] != key:
                    count()
                    items.clear()
                    bits.clear()
                key = segment[a]
                items.append(ix[a:b])
                bits += raw.slice(a, b - a).to_pylist()
        if items:
            count()
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[found]), pa.array(totals[found])], ["at", "n"])

    return bitmaps.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


def _grown(sets: DataFrame, size: int) -> DataFrame:
    """Candidates of ``size`` items all of whose smaller sets are frequent: an equi-join on all but the last item."""
    parts = sets.select(F.slice("ixs", 1, size - 2).alias("lead"), F.element_at("ixs", -1).alias("end"))
    other = parts.select("lead", F.col("end").alias("end2"))
    joined = parts.join(other, "lead").where("end < end2").select(F.concat("lead", F.array("end", "end2")).alias("ixs"))
    if size == 2:
        return joined
    without = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.concat(F.slice("ixs", 1, i - 1), F.slice(F.col("ixs"), i + 1, F.lit(size))))
    smaller = joined.select("ixs", F.explode(without).alias("part")).join(sets.select(F.col("ixs").alias("part")), "part", "left_semi")
    return smaller.groupBy("ixs").agg(F.count("*").alias("_n")).where(F.col("_n") == size).select("ixs")


def frequent_sets(df: DataFrame, items: str, support: float, min_size: int = 1, max_size: int = 4) -> DataFrame:
    """(items, freq): item sets in at least ``support`` of all rows, sorted inside, as a written table.

    An item counts once per row; null items are none, and a null basket is an empty one that still counts as a row. An empty table has no sets.
    Candidates are broadcast in bounded blocks; what reaches the driver is a block of candidates and never the sets or rows.
    """
    spark = df.sparkSession
    name = F.filter(F.array_distinct(F.col(items).cast("array<string>")), lambda i: i.isNotNull())
    rows = materialize(df.select(F.monotonically_increasing_id().alias("row"), name.alias("items")))
    count = rows.count()
    empty = "items array<string>, freq bigint"
    if not count:
        return spark.createDataFrame([], empty)
    # the smallest whole number that is not below the share, safe from the rounding of its product
    least = max(1, int(np.ceil(round(count * support, 9))))
    flat = rows.select("row", F.explode("items").alias("item"))
    single = materialize(flat.groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") >= least))
    # positions follow the order of names, so sets are sorted by name too
    named = materialize(assign_row_id(single, ["item"], "ix", start=0).withColumn("ix", F.col("ix").cast("int")))
    found = [named.select(F.array("item").alias("items"), "freq")]
    if max_size > 1:
        entries = flat.join(named.select("item", "ix"), "item").select(
            F.expr(f"row div {SEGMENT}").alias("segment"), (F.col("row") % SEGMENT).cast("int").alias("place"), "ix"
        )
        bitmaps = materialize(_bitmaps(entries.repartition("segment").sortWithinPartitions("segment")))
        sets = named.select(F.array("ix").alias("ixs"))
        for size in range(2, max_size + 1):
            candidates = materialize(_grown(sets, size).withColumn("at", F.monotonically_increasing_id()))
            total = candidates.count()
            if not total:
                break
            blocks = -(-total // CANDIDATES)
            kept = []
            for b in range(blocks):
                block = candidates.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == b).toPandas()
                if not len(block):
                    continue
                numbers = _counted(bitmaps, np.array(block["ixs"].tolist(), dtype=np.int64), block["at"].to_numpy())
                kept.append(numbers.where(F.col("n") >= least).withColumnRenamed("n", "freq"))
            frequent = kept[0]
            for more in kept[1:]:
                frequent = frequent.unionByName(more)
            sets = materialize(frequent.join(candidates, "at").select("ixs", "freq"))
            discard(candidates)
            spelled = sets.select("ixs", "freq", F.posexplode("ixs").alias("pos", "ix")).join(named.select("item", "ix"), "ix")
            spelled = spelled.groupBy("ixs", "freq").agg(F.array_sort(F.collect_list("item")).alias("items"))
            found.append(spelled.select("items", "freq"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialize(out.where(F.size("items") >= min_size))


def association_rules(sets: DataFrame, rows: int, confidence: float = 0.0) -> DataFrame:
    """(antecedent, consequent, freq, confidence, lift, support) with one item as consequent, from all frequent sets down to single items."""
    whole = sets.where(F.size("items") > 1).select("items", "freq", F.explode("items").alias("consequent"))
    parts = whole.withColumn("antecedent", F.array_except("items", F.array("consequent")))
    of = sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("_n"))
    alone = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("freq").alias("_m"))
    sure = F.col("freq") / F.col("_n")
    rules = parts.join(of, "antecedent").join(alone, "consequent").where(sure >= confidence)
    return rules.select(
        "antecedent", "consequent", "freq", sure.alias("confidence"), (sure / (F.col("_m") / F.lit(rows))).alias("lift"), (F.col("freq") / F.lit(rows)).alias("support")
    )
