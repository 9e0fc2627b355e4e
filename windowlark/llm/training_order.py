"""Token ids in training order: a keyed permutation gives every sequence a slot, shards hold slots in order.

Documents in id order, each followed by the end id, make one stream of token ids, cut into sequences of fixed
length. A Feistel network over the smallest even number of bits that holds the count, walked along its cycles
until it lands below the count, maps sequence numbers to slots: a permutation that needs no table, is known
from key and count alone, and can be inverted. Slots are range-partitioned into shards, and each task streams
its shard to a file of fixed-stride records, so slot s lies at byte (s - first slot) * stride of its shard and reading
can resume anywhere.

Texts are encoded twice, first for their lengths, then for their ids: that costs time but keeps no second copy
of the corpus, and positions in the stream do not depend on how the input is split. Only lengths are put
in order; the ids are shuffled once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowlark.llm.support import small_enough, whole
from windowlark.operators.ordered import running_totals
from windowlark.session import materialize, work_folder

LENGTH = 2048
#: Sequences in a shard, at most.
SHARD_SEQUENCES = 8192
KEY = 20_240_229
ROUNDS = 6
START_ROW_BYTES = 32

MANIFEST = "shard int, file string, first_slot long, sequences long"


class Feistel:
    """A keyed permutation of 0 .. count-1 on numpy arrays."""

    def __init__(self, count: int, key: int = KEY):
        self.count = count
        self.half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
        self.keys = np.random.default_rng(key).integers(1, 1 << 63, ROUNDS, dtype=np.uint64)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _pass(self, x: np.ndarray, keys) -> np.ndarray:
        shift, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> shift, x & mask
        for key in keys:
            left, right = right, left ^ self._mixed(right, key)
        # halves swapped at the end, so that the same network with its keys reversed is the inverse
        return (right << shift) | left

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._pass(np.asarray(x, dtype=np.uint64), keys)
            while (outside := out >= np.uint64(self.count)).any():
                out[outside] = self._pass(out[outside], keys)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, self.keys)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


_held: list = [None, None]


def _encoding(shared) -> tiktoken.Encoding:
    """The encoding of a broadcast vocabulary, kept by a Python worker between tasks."""
    if _held[0] is not shared:
        ranks, pattern = shared.value
        _held[:] = shared, tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _held[1]


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), whole(text_col))


def stream_starts(docs: DataFrame, id_col: str, text_col: str, shared, copies: bool = False) -> DataFrame:
    """(rk, start, tokens, copies): where in the stream each distinct (id, text) begins; null ids come last.

    With ``copies`` it takes the room of all rows that repeat it, which follow each other; else that of one.
    """
    rows = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("rk"), whole(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) + 1 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64())], ["id", "rk", "tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    lengths = materialize(rows.mapInArrow(run, f"id {kind}, rk long, tokens long"))
    many = F.count("*") if copies else F.lit(1).cast("long")
    once = lengths.groupBy("rk").agg(F.min("id").alias("id"), F.any_value("tokens").alias("tokens"), many.alias("copies"))
    once = once.withColumn("late", F.col("id").isNull())
    room = F.col("tokens") * F.col("copies")
    total = running_totals(once, [], ["late", "id", "rk"], {"upto": room})
    return materialize(total.select("rk", (F.col("upto") - room).alias("start"), "tokens", "copies"))


class _Shard:
    """A shard file under way; sequences come by slot, their fragments by place."""

    def __init__(self, folder: str, shard: int, first: int):
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        self.shard, self.first, self.count = shard, first, 0
        self.file = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.ids"
        self.out = where.open_output_stream(f"{path}/{self.file.rsplit('/', 1)[1]}", compression=None)

    def listed(self) -> pa.RecordBatch:
        self.out.close()
        values = [self.shard, self.file, self.first, self.count]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["shard", "file", "first_slot", "sequences"]
        )


def materialise_order(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    key: int = KEY,
    copies: bool = False,
) -> tuple[DataFrame, dict]:
    """Write all sequences in training order; returns the manifest of shards and the facts a reader needs.

    The end id is the first id the vocabulary leaves free; it also fills the last sequence up. Ids take two bytes if
    they fit, else four. Null texts are empty documents (one end id). Rows that repeat id and text are written once,
    or with ``copies`` as often as they are there, one after the other. Other columns are not read. An empty table gives an empty manifest. Shards have equal numbers of sequences, except
    the last: SHARD_SEQUENCES, or fewer if that would leave shuffle partitions idle. A lost task writes its shard
    anew under another name; the manifest lists what Spark committed.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, pattern))
    starts = stream_starts(docs, id_col, text_col, shared, copies)
    total, most = starts.agg(F.max(F.col("start") + F.col("tokens") * F.col("copies")), F.max("copies")).first()
    total = total or 0
    count = -(-total // length)
    end = max(ranks.values(), default=-1) + 1
    kind = "<u2" if end < 1 << 16 else "<u4"
    width = int(kind[-1])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_shard = max(1, min(SHARD_SEQUENCES, -(-count // partitions)))
    facts = {"count": count, "tokens": total, "length": length, "key": key, "end": end, "kind": kind, "per_shard": per_shard}
    order = Feistel(count, key)

    sent = F.broadcast(starts) if small_enough(starts, START_ROW_BYTES) else starts
    keyed = docs.select(_row_key(id_col, text_col).alias("rk"), whole(text_col).alias("text"))
    rows = keyed.join(sent.where("copies = 1"), "rk").select("start", "text")
    if most and most > 1:
        # each repeated text once, then one row per copy
        repeated = keyed.join(sent.where("copies > 1"), "rk").groupBy("rk", "start", "tokens", "copies").agg(F.any_value("text").alias("text"))
        number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("number")
        every = repeated.select("start", "tokens", "text", number)
        rows = rows.unionAll(every.select((F.col("start") + F.col("tokens") * F.col("number")).alias("start"), "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared).encode_ordinary
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
            size = 0
            for i in range(batch.num_rows):
                start = batch.column(0)[i].as_py()
                ids = np.array([*encode(batch.column(1)[i].as_py()), end], dtype=kind)
                numbers = np.arange(start // length, (start + len(ids) - 1) // length + 1)
                edges = np.clip(np.append(numbers, numbers[-1] + 1) * length - start, 0, len(ids))
                raw = ids.tobytes()
                parts = [raw[a * width : b * width] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                held.append((numbers, (edges[:-1] + start) % length, parts))
                size += len(raw)
                if size >= 4 << 20 or i == batch.num_rows - 1:
                    slots = order.slot(np.concatenate([h[0] for h in held]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots // per_shard, pa.int32()), pa.array(slots), pa.array(np.concatenate([h[1] for h in held]), pa.int32()),
                         pa.array([p for h in held for p in h[2]], pa.binary())],
                        ["shard", "slot", "place", "ids"],
                    )
                    held, size = [], 0

    folder = work_folder(spark).rstrip("/")
    folder = folder if folder.startswith("file:") or "://" in folder else f"file://{folder}"
    folder = f"{folder}/windowlark-shards/{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last, filled = None, None, 0
        for batch in batches:
            shards, slots, places = (batch.column(i).to_pylist() for i in range(3))
            for shard, slot, place, ids in zip(shards, slots, places, batch.column(3), strict=True):
                if last == (slot, place):
                    continue  # a row that repeats id and text
                if out is not None and shard != out.shard:
                    yield out.listed()
                    out = None
                if out is None:
                    out = _Shard(folder, shard, slot)
                raw = ids.as_py()
                if place == 0:
                    if slot != out.first + out.count:
                        raise ValueError(f"slot {slot} is out of turn")
                    out.count += 1
                    filled = 0
                if place != filled:
                    raise ValueError(f"sequence at slot {slot} has a gap")
                out.out.write(raw)
                filled += len(raw) // width
                last = (slot, place)
                if slot == last_slot and filled == tail:
                    out.out.write(np.full(length - tail, end, dtype=kind).tobytes())
        if out is not None:
            yield out.listed()

    tail = total - (count - 1) * length
    last_slot = int(order.slot(np.array([count - 1]))[0]) if count else -1
    fragments = rows.mapInArrow(cut, "shard int, slot long, place int, ids binary")
    placed = fragments.repartitionById(max(1, -(-count // per_shard)), F.col("shard")).sortWithinPartitions("slot", "place")
    return materialize(placed.mapInArrow(write, MANIFEST)), facts


def read_slots(manifest: DataFrame, facts: dict, start: int = 0, with_ids: bool = True) -> DataFrame:
    """(slot, sequence, shard, offset, ids, sha256) from slot ``start`` on, one task per shard, read in order.

    ``sha256`` is that of the stored bytes; without ``with_ids`` the ids stay null but are read and digested.
    """
    length, stride = facts["length"], facts["length"] * int(facts["kind"][-1])
    order = Feistel(facts["count"], facts["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                where, path = fs.FileSystem.from_uri(shard["file"])
                at = max(0, start - shard["first_slot"])
                with where.open_input_file(path) as source:
                    if source.size() != shard["sequences"] * stride:
                        raise ValueError(f"{shard['file']} has not the size the manifest says")
                    while at < shard["sequences"]:
                        many = min(256, shard["sequences"] - at)
                        source.seek(at * stride)
                        raw = source.read(many * stride)
                        digests = [hashlib.sha256(raw[i : i + stride]).hexdigest() for i in range(0, len(raw), stride)]
                        slots = shard["first_slot"] + np.arange(at, at + many)
                        if with_ids:
                            ids = np.frombuffer(raw, dtype=facts["kind"]).astype(np.int32)
                            lists = pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * length), pa.array(ids))
                        else:
                            lists = pa.nulls(many, pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(slots), pa.array(order.sequence(slots)), pa.array([shard["shard"]] * many, pa.int32()),
                             pa.array(np.arange(at, at + many) * stride), lists, pa.array(digests)],
                            ["slot", "sequence", "shard", "offset", "ids", "sha256"],
                        )
                        at += many

    wanted = manifest.where(F.col("first_slot") + F.col("sequences") > start)
    spread = wanted.repartitionById(max(1, -(-facts["count"] // facts["per_shard"])), F.col("shard"))
    return spread.mapInArrow(run, "slot long, sequence long, shard int, offset long, ids array<int>, sha256 string")
