"""Byte-level BPE with a two-tier lookup: a minimal perfect hash for whole pre-tokens, heap merges for the rest.

Tier 1 is a minimal perfect hash over the vocabulary (hash and displace: one displacement per bucket of
keys, singletons stored by slot), so a pre-token that is a token costs one hash, one slot and one comparison.
Tier 2 merges a miss over a linked list of its bytes; a heap keeps the adjacent pairs by rank, leftmost
first, and drops entries whose nodes have changed since. Short misses need no heap: a list of their pairs is searched.
Pair ranks come from a plain merge table.
Both run inside Arrow batches; each Python worker remembers the ids of pieces it has met, within a bound.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces in one generation of a worker's memory, of which there are up to six (about 200 bytes a piece).
MEMO_PIECES = 90_000
#: Longer pieces (in characters) are not remembered.
LONG_PIECE = 64
#: Pieces of at most so many bytes are merged without a heap.
SHORT_BYTES = 14
#: Rows of an Arrow batch are cut so that one holds at most about so many ids, or bytes of text, before it is handed on.
BATCH_IDS = 1 << 20
BATCH_BYTES = 4 << 20

_MASK = (1 << 64) - 1
_NO_RANK = 1 << 64
_ODD = 0x9E3779B97F4A7C15
#: A white-space character before a space: only then do cuts at single spaces need the slower rule.
_RUN = regex.compile(r"\s ")
_CUT = regex.compile(r"(?<=\S)(?= )")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class PerfectHash:
    """Minimal perfect hash from token bytes to rank; unknown keys give None.

    ``shift[b]`` is the displacement of bucket b, or -slot-1 if the bucket has one key.
    """

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        shift = [0] * self.buckets
        self.key: list[bytes] = [b""] * n
        self.rank = [0] * n
        taken = np.zeros(n, dtype=bool)
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            members = order[starts[b] : starts[b + 1]]
            if len(members) < 2:
                if len(members):
                    singles.append((int(b), int(members[0])))
                continue
            first = 1
            while True:
                tries = np.arange(first, first + 64, dtype=np.uint64)
                slots = self._slots(hashes[members][None, :], tries[:, None])
                free = ~taken[slots].any(axis=1)
                ordered = np.sort(slots, axis=1)
                free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if free.any():
                    at = int(np.argmax(free))
                    shift[b] = first + at
                    for k, slot in zip(members, slots[at], strict=True):
                        self._put(keys[k], ranks, int(slot), taken)
                    break
                first += 64
        for (b, k), slot in zip(singles, np.flatnonzero(~taken), strict=True):
            shift[b] = -int(slot) - 1
            self._put(keys[k], ranks, int(slot), taken)
        self.shift = shift

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((h ^ (d * np.uint64(_ODD))) >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)

    def _put(self, key: bytes, ranks: dict[bytes, int], slot: int, taken: np.ndarray) -> None:
        self.key[slot], self.rank[slot], taken[slot] = key, ranks[key], True

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else ((h ^ (d * _ODD & _MASK)) >> 20) % self.n
        return self.rank[slot] if self.key[slot] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that is not itself a token: lowest rank first, leftmost among equals.

    Node i starts at byte i; ``stop[i]`` is where it ends, which is also its right neighbour, and ``left[i]`` its
    left neighbour, ``held[i]`` its token. A heap entry packs (rank, i, end of the pair) into one integer. It still stands
    if the right neighbour of i ends at that end; nodes merged away point at n, whose stop is never an end.
    """
    n = len(piece)
    bits = n.bit_length()
    low, up = (1 << bits) - 1, 2 * bits
    stop = [*range(1, n + 1), 0]
    left = list(range(-1, n))
    rank_of = ranks.get
    held = [None] * n
    heap = [
        rank << up | i << bits | i + 2
        for i in range(n - 1)
        if (rank := rank_of(piece[i : i + 2])) is not None
    ]
    heapify(heap)
    while heap:
        entry = heappop(heap)
        end = entry & low
        i = entry >> bits & low
        mid = stop[i]
        if stop[mid] != end:
            continue
        stop[i], stop[mid], held[i] = end, n, entry >> up
        if end < n:
            left[end] = i
            rank = rank_of(piece[i : stop[end]])
            if rank is not None:
                heappush(heap, rank << up | i << bits | stop[end])
        if i:
            i = left[i]
            rank = rank_of(piece[i:end])
            if rank is not None:
                heappush(heap, rank << up | i << bits | end)
    ids, at = [], 0
    while at < n:
        rank = held[at]
        ids.append(ranks[piece[at : at + 1]] if rank is None else rank)
        at = stop[at]
    return ids


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids as ``merge_bytes``, in fewer steps for a piece of a few bytes.

    ``cuts`` are the ends of the tokens so far, ``pairs`` the rank of each with its right neighbour.
    """
    rank_of, none = ranks.get, _NO_RANK
    cuts = list(range(len(piece) + 1))
    pairs = [rank_of(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = rank_of(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            pairs[i - 1] = rank_of(piece[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


class Encoder:
    """Encodes whole texts by a perfect hash and a pre-token pattern."""

    def __init__(self, table: PerfectHash, pattern: str):
        self.table, self.pattern, self.find = table, pattern, regex.compile(pattern).findall
        self.merges = dict(zip(table.key, table.rank, strict=True))
        self.words = _Memo(self._known)
        self.pieces = _Memo(self._piece)
        self.spaced = _Memo(lambda piece: self._piece(" " + piece))

    def _known(self, word: str) -> bytes:
        # a word met before with a mark at its end may have been met without one, as a piece
        ids = self.spaced.get(word[1:]) or self.spaced.old.get(word[1:]) if word[0] == " " else None
        return self._word(word) if ids is None else ids

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        rank = self.table.get(raw)
        if rank is not None:
            return array("i", [rank]).tobytes()
        merge = merge_short if len(raw) <= SHORT_BYTES else merge_bytes
        return array("i", merge(raw, self.merges)).tobytes()

    def _piece(self, piece: str) -> bytes:
        # a piece of one pre-token is remembered as a piece, not as a word too
        found = self.find(piece)
        return self._word(found[0]) if len(found) == 1 else b"".join(map(self.words.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32 bytes.

        A pre-token never spans a space that follows a non-space, so texts are cut there and each piece is
        matched by itself; pieces repeat, matches on them do not have to.
        """
        if _RUN.search(text):
            return b"".join(map(self.pieces.__getitem__, _CUT.split(text)))
        first, *rest = text.split(" ")
        out = self.pieces[first] if first else b""
        return out + b"".join(map(self.spaced.__getitem__, rest)) if rest else out


class _Memo(dict):
    """Computes what it does not hold. When full it becomes the old generation, from which hits come back."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONG_PIECE:
                return value
        if len(self) >= MEMO_PIECES:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_held: list = [None, None]


def encoder_of(shared, pattern: str) -> Encoder:
    """The encoder of a broadcast table, kept by a Python worker between tasks."""
    if _held[0] is not shared or _held[1].pattern != pattern:
        _held[:] = shared, Encoder(shared.value, pattern)
    return _held[1]


def _with_column(batch: pa.RecordBatch, carry: list[int], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*[batch.column(i) for i in carry], values], [*[batch.schema.names[i] for i in carry], name]
    )


def _carried(df: DataFrame, carry: list[str] | None, name: str) -> list[int]:
    kept = df.columns if carry is None else carry
    if name in kept:
        raise ValueError(f"column {name} exists")
    return [df.columns.index(c) for c in kept]


def bpe_encode(
    df: DataFrame, text_col: str, ranks: dict[bytes, int], pattern: str, name: str = "ids", carry: list[str] | None = None
) -> DataFrame:
    """Adds ``name``: the token ids of the whole text, each match of the pattern by itself, no special tokens.

    A null text is an empty text and has no ids. Special-token strings in a text are ordinary text. The columns
    in ``carry`` (all by default) are kept; ``name`` must not be one of them. The vocabulary, whose size is that of its file, is
    broadcast as a perfect hash. Every row is encoded alone, so there is no shuffle.
    """
    kept = _carried(df, carry, name)
    shared = df.sparkSession.sparkContext.broadcast(PerfectHash(ranks))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(shared, pattern).encode
        for batch in batches:
            start, parts, total, size = 0, [], 0, 0
            for i, text in enumerate(batch.column(at)):
                text = text.as_py() or ""
                ids = encode(text)
                parts.append(ids)
                total += len(ids) >> 2
                size += len(text)
                if total >= BATCH_IDS or size >= BATCH_BYTES or i == batch.num_rows - 1:
                    ends = np.cumsum([0, *[len(p) >> 2 for p in parts]]).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
                    lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                    yield _with_column(batch.slice(start, i + 1 - start), kept, name, lists)
                    start, parts, total, size = i + 1, [], 0, 0

    schema = T.StructType([*[df.schema.fields[i] for i in kept], T.StructField(name, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)


def bpe_decode(
    df: DataFrame, ids_col: str, ranks: dict[bytes, int], name: str = "decoded", carry: list[str] | None = None
) -> DataFrame:
    """Adds ``name``: the bytes of the ids. Null ids give empty bytes; an id outside the vocabulary fails.

    Bytes of tokens lie in one buffer; ids become ranges of it, gathered by batch without a loop over ids.
    """
    kept = _carried(df, carry, name)
    size = max(ranks.values(), default=-1) + 1
    by_rank = [b""] * size
    known = np.zeros(size, dtype=bool)
    for token, rank in ranks.items():
        by_rank[rank], known[rank] = token, True
    shared = df.sparkSession.sparkContext.broadcast((by_rank, known))
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = shared.value
        pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        width = np.array([len(t) for t in tokens], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(width)[:-1]]) if len(width) else width
        for batch in batches:
            lists = batch.column(at)
            start, out, held = 0, [], 0
            for row in range(batch.num_rows):
                ids = np.asarray(lists[row].values if lists[row].is_valid else [], dtype=np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= size or not known[ids].all()):
                    raise ValueError("an id is not in the vocabulary")
                wide = width[ids]
                total = int(wide.sum())
                # position in the pool = begin of the token + offset inside it
                step = np.repeat(begin[ids] - (np.cumsum(wide) - wide), wide) + np.arange(total)
                out.append(pool[step].tobytes())
                held += total
                if held >= BATCH_BYTES or row == batch.num_rows - 1:
                    yield _with_column(batch.slice(start, row + 1 - start), kept, name, pa.array(out, pa.binary()))
                    start, out, held = row + 1, [], 0

    schema = T.StructType([*[df.schema.fields[i] for i in kept], T.StructField(name, T.BinaryType())])
    return df.mapInArrow(run, schema)
