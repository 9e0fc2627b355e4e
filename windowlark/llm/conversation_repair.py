"""Repair of conversation structure: cheapest edits per conversation, streamed in turn order.

Rows are hashed by conversation, faults are found by window functions on that partitioning, and the rows of a
partition reach a streaming task sorted by (conversation, turn). The task carries the state of a dynamic programme
over a four-state automaton from batch to batch: for each state the cost of the cheapest edits so far and where their
audit string stands among those of the other states. Few such carried states exist, so a row is one lookup. Per row
four bytes of back-pointers are kept; past a bound rows and pointers of a conversation are spilled to
the shared folder and traced back segment by segment, so a conversation of any size needs bounded memory.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windowlark.session import session_folder

#: Rows, and characters, of one conversation that a task holds before it spills them.
SEGMENT_ROWS, SEGMENT_CHARS = 100_000, 16 << 20
#: Rows, and characters, of one output batch.
BATCH_ROWS, BATCH_CHARS = 10_000, 4 << 20

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. A conversation may end in 0 or 3.
_BY_INITIAL = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_FILLED = (2, 2, 3, 2)
_ENDS = (0, 3)
_FINE, _TRUNCATED, _GONE = 0, 1, 2
_START = ((0, 0), None, None, None)
_LETTERS = DELETE + KEEP + REROLE

REPAIRED = "conv_id {conv}, turn {turn}, role_was string, role string, text string, fault string, edit string"


def _role_of(state: int) -> str:
    return "assistant" if state == 3 else "user"


@cache
def _step(carried: tuple, kind: tuple[str, int]) -> tuple[tuple, int]:
    """The carried states after one more row, and its packed pointers.

    A carried state is (cost above the least, rank of its audit string). Two audit strings after the same row end in that row's
    letter and hold equally many such letters, so neither begins the other: they are ordered by the
    ranks of the states they came from, then by what was added.
    """
    initial, fault = kind
    best: dict[int, tuple] = {}
    for origin, state in enumerate(carried):
        if state is None:
            continue
        cost, rank = state
        at = origin
        for inserts in range(3):
            extra = fault == _TRUNCATED
            moves = [(DELETE, at, DELETE_COST)]
            if fault != _GONE:
                if (to := _BY_INITIAL.get(initial, {}).get(at)) is not None:
                    moves.append((KEEP, to, extra * TRUNCATED_COST))
                moves.append((REROLE, _FILLED[at], REROLE_COST + extra * TRUNCATED_COST))
            for letter, to, more in moves:
                found = cost + inserts * INSERT_COST + more, rank, INSERT * inserts + letter, origin, inserts
                if to not in best or found < best[to]:
                    best[to] = found
            at = _FILLED[at]
    least = min(b[0] for b in best.values())
    order = sorted(best, key=lambda q: best[q][1:3])
    packed = 0
    for q, (_, _, added, origin, inserts) in best.items():
        packed |= (origin | inserts << 2 | _LETTERS.index(added[-1]) << 4) << 8 * q
    return tuple((best[q][0] - least, order.index(q)) if q in best else None for q in range(4)), packed


def _last(carried: tuple) -> tuple[int, int]:
    """Best final state and how many inserts follow it."""
    found = []
    for origin, state in enumerate(carried):
        at = origin
        for inserts in range(3):
            if state is not None and at in _ENDS:
                found.append((state[0] + inserts * INSERT_COST, state[1], INSERT * inserts, origin, inserts))
            at = _FILLED[at]
    return min(found)[3:]


class _Conversation:
    """Rows and pointers of the conversation at hand; spilled in segments past the bound."""

    def __init__(self, folder: str, key, bounds: tuple[int, int], turn_type: pa.DataType):
        self.folder, self.key, self.bounds, self.turn_type = folder, key, bounds, turn_type
        self.carried, self.rows, self.pointers = _START, [], array("I")
        self.chars = self.spilled = 0
        self.store = self.base = None

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        kind = role[:1], _GONE if fault in ("blank", "duplicate") else _TRUNCATED if fault else _FINE
        self.carried, pointers = _step(self.carried, kind)
        self.pointers.append(pointers)
        self.rows.append((turn, role, text, fault))
        self.chars += len(role) + len(text)
        if len(self.rows) >= self.bounds[0] or self.chars >= self.bounds[1]:
            self._spill()

    def _spill(self) -> None:
        if self.store is None:
            self.store, root = fs.FileSystem.from_uri(self.folder)
            self.base = f"{root}/{uuid.uuid4().hex}"
            self.store.create_dir(self.base)
        columns = list(zip(*self.rows, strict=True))
        batch = pa.RecordBatch.from_arrays(
            [pa.array(columns[0], self.turn_type), *[pa.array(c, pa.string()) for c in columns[1:]]], ["turn", "role", "text", "fault"]
        )
        with self.store.open_output_stream(f"{self.base}/{self.spilled}.rows") as out, pa.ipc.new_stream(out, batch.schema) as writer:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                writer.write_batch(batch.slice(start, BATCH_ROWS))
        with self.store.open_output_stream(f"{self.base}/{self.spilled}.pointers") as out:
            out.write(self.pointers.tobytes())
        self.spilled, self.rows, self.pointers, self.chars = self.spilled + 1, [], array("I"), 0

    def _traced(self, pointers: array, state: int) -> tuple[bytes, int]:
        """Edits of a segment (inserts before a row and its letter, in one byte each) and the state before it."""
        edits = bytearray(len(pointers))
        for i in range(len(pointers) - 1, -1, -1):
            byte = pointers[i] >> 8 * state & 255
            edits[i], state = byte >> 2, byte & 3
        return bytes(edits), state

    def repaired(self) -> Iterator[tuple]:
        """Edited rows in order: (key, turn, role before, role, text, fault, edit)."""
        state, trailing = _last(self.carried)
        edits, state = self._traced(self.pointers, state)
        for part in range(self.spilled - 1, -1, -1):
            with self.store.open_input_stream(f"{self.base}/{part}.pointers") as file:
                pointers = array("I", file.read())
            earlier, state = self._traced(pointers, state)
            with self.store.open_output_stream(f"{self.base}/{part}.edits") as out:
                out.write(earlier)
        at = 0
        for part in range(self.spilled):
            with self.store.open_input_stream(f"{self.base}/{part}.edits") as file:
                earlier = file.read()
            with self.store.open_input_stream(f"{self.base}/{part}.rows") as file, pa.ipc.open_stream(file) as batches:
                rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
                at = yield from self._edited(rows, earlier, at)
        at = yield from self._edited(self.rows, edits, at)
        for _ in range(trailing):
            at = _FILLED[at]
            yield self.key, None, None, _role_of(at), "", None, INSERT
        if self.store is not None:
            self.store.delete_dir(self.base)

    def _edited(self, rows, edits: bytes, at: int):
        for (turn, role, text, fault), edit in zip(rows, edits, strict=True):
            for _ in range(edit & 3):
                at = _FILLED[at]
                yield self.key, None, None, _role_of(at), "", None, INSERT
            letter = _LETTERS[edit >> 2]
            if letter == DELETE:
                yield self.key, turn, role, None, None, fault, DELETE
                continue
            at = _BY_INITIAL[role[:1]][at] if letter == KEEP else _FILLED[at]
            yield self.key, turn, role, role if letter == KEEP else _role_of(at), text, fault, letter
        return at


def faulty_rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows (conv_id, turn, role, text, fault), hashed by conversation and sorted by turn in it.

    fault, the first that applies: blank, duplicate (role and text seen earlier in the conversation), truncated, or null.
    The window by text needs no shuffle of its own, and what it sorts may spill.
    """
    rows = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"),
    ).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(nth > 1, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    # equal rows of one turn: the one that is no duplicate comes first
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", (F.col("fault") == "duplicate").asc_nulls_first()]
    return rows.withColumn("fault", fault).sortWithinPartitions(*order)


def repair_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    segment: tuple[int, int] = (SEGMENT_ROWS, SEGMENT_CHARS),
) -> DataFrame:
    """Cheapest edits that make each conversation's role initials match ``(s?(ua)+)?``.

    Rows are taken by turn, nulls first; rows of one turn by role and text. Null roles and texts read as one space; a null
    conversation id is a conversation. Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or
    assistant turn) 2; a truncated row that stays adds 1; blank and duplicate rows must go. Of the cheapest repairs, the
    one whose edit initials come first in ASCII order.

    Returns the edited rows, each conversation's in order and in one stretch of one partition: conv_id, turn, role_was (null
    for inserts), role and text (null for deletes), fault, edit (K, R, D or I). Other columns of ``df`` take no part, so their
    names cannot clash. An empty table gives an empty one; repeated rows are duplicates. ``segment`` bounds the rows and
    characters of a conversation held in memory.
    """
    spill = f"{session_folder(df.sparkSession)}/spill"
    rows = faulty_rows(df, conv_col, turn_col, role_col, text_col)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = schema = None
        out, chars = [], 0

        def packed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return batch

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal chars
            for row in current.repaired():
                out.append(row)
                chars += len(row[4] or "")
                if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    chars = 0
                    yield packed()

        for batch in batches:
            if schema is None:
                kinds = batch.schema
                names = ["role_was", "role", "text", "fault", "edit"]
                schema = pa.schema([("conv_id", kinds.field(0).type), ("turn", kinds.field(1).type), *[(n, pa.string()) for n in names]])
            for conv, turn, role, text, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if current is None or current.key != conv:
                    if current is not None:
                        yield from done()
                    current = _Conversation(spill, conv, segment, schema.field(1).type)
                current.add(turn, role, text, fault)
        if current is not None:
            yield from done()
        if out:
            yield packed()

    return rows.mapInArrow(run, REPAIRED.format(conv=kinds["conv_id"], turn=kinds["turn"]))


AUDIT = (
    "conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def audit_conversations(repaired: DataFrame) -> DataFrame:
    """One row per conversation from the output of ``repair_conversations``, folded in the same tasks without a shuffle.

    gaps counts turn numbers missing between the least and the greatest (null turns ignored), illegal the adjacent rows whose role
    initials are not su, ua or au, both before the repair; repaired_sha256 is of ``role:text`` lines joined by newlines.
    """
    cost = {KEEP: 0, REROLE: REROLE_COST, DELETE: DELETE_COST, INSERT: INSERT_COST}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = key = state = None
        out: list[tuple] = []

        def fresh() -> dict:
            return {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                    "edits": bytearray(), "sha": hashlib.sha256(), "before": None, "some": False}

        def close() -> tuple:
            gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
            counts = [state[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
            return key, gaps, *counts, state["edits"].decode(), state["sha"].hexdigest()

        def packed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            if schema is None:
                longs = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                schema = pa.schema([("conv_id", batch.schema.field(0).type), *longs, ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for conv, turn, was, role, text, fault, edit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or conv != key:
                    if state is not None:
                        out.append(close())
                    key, state = conv, fresh()
                state["edits"].append(ord(edit))
                state["cost"] += cost[edit] + (TRUNCATED_COST if fault == "truncated" and edit != DELETE else 0)
                if edit != INSERT:
                    if fault:
                        state[fault] += 1
                    if turn is not None and turn != state["high"]:
                        state["low"] = turn if state["low"] is None else state["low"]
                        state["high"], state["turns"] = turn, state["turns"] + 1
                    if state["before"] is not None and state["before"] + was[:1] not in ("su", "ua", "au"):
                        state["illegal"] += 1
                    state["before"] = was[:1]
                if edit != DELETE:
                    state["sha"].update(f"{chr(10) if state['some'] else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    state["some"] = True
            if len(out) >= BATCH_ROWS:
                yield packed()
        if state is not None:
            out.append(close())
        if out:
            yield packed()

    return repaired.mapInArrow(run, AUDIT.format(conv=repaired.schema["conv_id"].dataType.simpleString()))


def damaged(conversations: DataFrame) -> DataFrame:
    """Repeatable damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its sentence ends,
    3 repeats it, 4 makes its role user. Nulls read as one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("_copy"),
    )
    return rows.drop("_copy")


def audit_all(conversations: DataFrame, audit: DataFrame) -> DataFrame:
    """``audit`` with a row for every conversation of the first table: those without rows have zeros and empty texts."""
    ids = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    joined = ids.join(audit, ids["_conv"].eqNullSafe(audit["conv_id"]), "left").drop("conv_id")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    columns = [c for c in audit.columns if c != "conv_id"]
    return joined.select(F.col("_conv").alias("conv_id"), *[F.coalesce(c, F.lit(empty.get(c, 0))).alias(c) for c in columns])
