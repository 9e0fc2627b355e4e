"""Byte-level BPE that speculates and verifies: greedy tokens, vectorised pair checks, exact merges for the rest.

Greedy longest match proposes the tokens of a word. A proposal is the true encoding exactly if every adjacent pair
of it is compatible, that is, if merging the two tokens' bytes alone would never join anything across their border.
All pairs of a block of texts are tested at once in NumPy: the last merge on either side of the border is undone
again and again, and at each step a merge of the two border tokens must not have come first. Only words with a pair
that fails are merged exactly. This needs an orderly vocabulary (each token made by one merge, from tokens of
earlier merges); with another one every word is merged exactly.

Each Python worker remembers the ids of the pieces it has met, within a bound; a block's distinct new pieces are
encoded together.
"""

from __future__ import annotations

import gc
import json
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces that a worker remembers between blocks (about 250 bytes each); a block's own pieces are always held.
MEMO_PIECES = 250_000
#: Characters of text handled at once; longer texts are cut where no word spans the cut.
BLOCK_CHARS = 1 << 21

#: Rows of an Arrow batch that are taken out of it at once.
SLICE_ROWS = 1000

_NEVER = np.iinfo(np.int64).max // 4
#: White space before a space: elsewhere, cuts at single spaces are word borders.
_RUN = regex.compile(r"\s ")
_CUT = regex.compile(r"(?<=\S)(?= )")
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{ln}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it is printable and no space, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """A byte-level BPE vocabulary with its merges and added tokens, as arrays; shipped to workers as a broadcast."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], added: dict[str, int], letters: tuple[str, str] = ("", "")):
        self.added, self.odd_letters, self.odd_digits = added, *letters
        size = max([*vocab.values(), *added.values(), -1]) + 1
        self.token: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.token[i] = word
        for word, i in added.items():
            self.token[i] = word.encode()
        self.single = [vocab.get(bytes([b])) for b in range(256)]
        if None in self.single:
            raise ValueError("every byte must be a token")
        # born: rank of the merge that makes a token, -1 for bytes; left and right are its parts
        self.born = np.full(size, -1, dtype=np.int64)
        self.left = np.zeros(size, dtype=np.int64)
        self.right = np.zeros(size, dtype=np.int64)
        self.merges: dict[int, tuple[int, int]] = {}
        self.orderly, made = True, set()
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges[x << 32 | y] = rank, z
            self.orderly &= z not in made and len(a) > 0 and len(b) > 0
            made.add(z)
            self.born[z], self.left[z], self.right[z] = rank, x, y
        ranked = sorted((pair, rank) for pair, (rank, _) in self.merges.items())
        self.pair = np.array([p for p, _ in ranked], dtype=np.int64)
        self.rank = np.array([r for _, r in ranked], dtype=np.int64)
        parts = np.array(sorted(made), dtype=np.int64)
        self.orderly &= len(self.merges) == len(merges) and bool((np.maximum(self.born[self.left[parts]], self.born[self.right[parts]]) < self.born[parts]).all())
        # greedy match may use a token only if its own bytes merge to it
        sound = self.compatible(self.left[parts], self.right[parts], self.born[parts]) if self.orderly else np.zeros(len(parts), bool)
        reached = np.zeros(size, dtype=bool)
        reached[self.single] = True
        for z, fits in zip(parts[np.argsort(self.born[parts])].tolist(), sound[np.argsort(self.born[parts])].tolist(), strict=True):
            reached[z] = fits and reached[self.left[z]] and reached[self.right[z]]
        self.usable = {w: i for w, i in vocab.items() if reached[i]}
        self.product = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self._matcher = None

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pair):
            return np.full(len(left), _NEVER)
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, want), len(self.pair) - 1)
        return np.where(self.pair[at] == want, self.rank[at], _NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the border of each token pair is never merged over (before the merge of rank ``before``).

        Times are 2 * rank, plus 1 where the right token goes on to merge: among merges of one rank the leftmost
        comes first, so a merge over the border then still precedes it.
        """
        left, right = left.astype(np.int64), right.astype(np.int64)
        until = np.full(len(left), 2 * _NEVER) if before is None else 2 * before
        fits = np.ones(len(left), dtype=bool)
        at = np.arange(len(left))
        while len(at):
            joined = 2 * self._rank_of(left, right) < until
            fits[at[joined]] = False
            of_left, of_right = self.born[left], self.born[right]
            undo_left = of_left > of_right
            until = np.where(undo_left, 2 * of_left, 2 * of_right + 1)
            go = ~joined & (np.maximum(of_left, of_right) >= 0)
            left = np.where(undo_left, self.right[left], left)[go]
            right = np.where(undo_left, right, self.left[right])[go]
            at, until = at[go], until[go]
        return fits

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from the left over all words at once: ids, and the word that each belongs to."""
        if self._matcher is None:
            self._matcher = ahocorasick.Automaton()
            for word, i in self.usable.items():
                self._matcher.add_word(word.decode("latin-1"), i)
            self._matcher.make_automaton()
        # no token has the character 256, so no match spans two words
        found = self._matcher.iter_long("\u0100".join([w.decode("latin-1") for w in words]))
        hits = np.array(list(found), dtype=np.int64).reshape(-1, 2)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        return hits[:, 1], np.searchsorted(ends, hits[:, 0], side="right")

    def merged(self, word: bytes) -> list[int]:
        """The exact encoding: of all adjacent pairs the merge of least rank, leftmost first, until none is left."""
        n, ranks = len(word), self.merges
        ids = [self.single[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        queue = []
        for i in range(n - 1):
            hit = ranks.get(ids[i] << 32 | ids[i + 1])
            if hit:
                queue.append((hit[0], i, ids[i], ids[i + 1]))
        heapify(queue)
        while queue:
            _, i, x, y = heappop(queue)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = ranks[x << 32 | y][1], -1
            k = after[i] = after[j]
            before[k] = i
            if k < n and (hit := ranks.get(ids[i] << 32 | ids[k])):
                heappush(queue, (hit[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (hit := ranks.get(ids[h] << 32 | ids[i])):
                heappush(queue, (hit[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def merge_rows(self, words: list[bytes], width: int) -> list[bytes]:
        """``merged``, packed, for many words of at most ``width`` bytes: one merge of every word at a time."""
        n = len(words)
        raw = np.zeros((n, width), dtype=np.uint8)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        raw[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = np.where(np.arange(width) < sizes[:, None], np.array(self.single)[raw], -1)
        ids = np.concatenate([ids, np.full((n, 2), -1)], axis=1)
        rank = self._rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width + 1)
        rank[ids[:, 1:] < 0] = _NEVER
        out: list = [None] * n
        at, column = np.arange(n), np.arange(width + 2)
        while len(at):
            j = rank.argmin(axis=1)
            row = np.arange(len(at))
            best = rank[row, j]
            if (over := best == _NEVER).any():
                kept = ids[over]
                for i, packed in zip(at[over].tolist(), _slices(kept[kept >= 0], np.cumsum((kept >= 0).sum(axis=1))), strict=True):
                    out[i] = packed
                at, ids, rank, j, best = at[~over], ids[~over], rank[~over], j[~over], best[~over]
                row = np.arange(len(at))
                if not len(at):
                    break
            ids[row, j] = self.product[best]
            skip = np.minimum(column + (column > j[:, None]), width + 1)
            ids = np.take_along_axis(ids, skip, axis=1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(skip[:, :-1], width), axis=1)
            rank[:, -1] = _NEVER
            here, right, left = ids[row, j], ids[row, j + 1], ids[row, np.maximum(j - 1, 0)]
            rank[row, j] = np.where(right < 0, _NEVER, self._rank_of(here, right))
            inner = np.flatnonzero(j > 0)
            rank[inner, j[inner] - 1] = self._rank_of(left[inner], here[inner])
        return out

    def encode_words(self, words: list[bytes]) -> tuple[list[bytes], int]:
        """Packed ids of each word, and how many words had to be merged exactly."""
        if not words:
            return [], 0
        if self.orderly:
            flat, owner = self.greedy(words)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, which = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
            failed = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            redo = np.unique(owner[inner[failed[which]]]).tolist()
            out = _slices(flat, np.searchsorted(owner, np.arange(1, len(words) + 1)))
        else:
            redo, out = list(range(len(words))), [b""] * len(words)
        by_width: dict[int, list[int]] = {w: [] for w in (8, 16, 32)}
        for i in redo:
            width = next((w for w in by_width if len(words[i]) <= w), None)
            if width:
                by_width[width].append(i)
            else:
                out[i] = array("i", self.merged(words[i])).tobytes()
        for width, some in by_width.items():
            for i, ids in zip(some, self.merge_rows([words[i] for i in some], width), strict=True):
                out[i] = ids
        return out, len(redo)


def _slices(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Consecutive runs of ids, packed."""
    raw, cuts = ids.astype("<i4").tobytes(), [0, *(4 * ends).tolist()]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _odd_characters() -> tuple[str, str]:
    """Letters and digits of ``regex`` that the tokenizers library takes for neither: its Unicode tables are older.

    Found by asking the library once for all of them: a letter is glued to a letter before it, a digit to a digit.
    """
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    odd = []
    for kind, glue in (("L", "a"), ("N", "1")):
        chars = regex.findall(rf"\p{{{kind}}}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
        ends = {end for _, (_, end) in cut("".join(f"{glue}{c} " for c in chars))}
        odd.append("".join(c for i, c in enumerate(chars) if 3 * i + 1 in ends))
    return odd[0], odd[1]


_probed: list[tuple[str, str]] = []


def read_tokenizer(path: str) -> Tokenizer:
    """A byte-level BPE from a tokenizer file in JSON. Anything this encoder would not follow is refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if model.get("type", "BPE") != "BPE" or not plain or not level or spec.get("normalizer"):
        raise ValueError("only a plain byte-level BPE without normaliser is supported")
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that strip or match single words are not supported")
    letters = _byte_letters()

    def raw(word: str) -> bytes | None:
        return bytes(map(letters.__getitem__, word)) if all(c in letters for c in word) else None

    vocab = {b: i for w, i in model["vocab"].items() if (b := raw(w))}
    pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
    if not _probed:
        _probed.append(_odd_characters())
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["content"]}
    return Tokenizer(vocab, [(raw(a), raw(b)) for a, b in pairs], added, _probed[0])


class Encoder:
    """Encodes texts block by block, with a bounded memory of pieces."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.words = regex.compile(_WORDS.format(L=r"\p{L}", N=r"\p{N}", ln=r"\p{L}\p{N}")).findall
        odd_l, odd_n = tokenizer.odd_letters, tokenizer.odd_digits
        escaped = [f"[{regex.escape(x, special_only=False)}]" if x else r"[^\s\S]" for x in (odd_l, odd_n)]
        classes = rf"[\p{{L}}--{escaped[0]}]", rf"[\p{{N}}--{escaped[1]}]"
        inner = rf"[\p{{L}}--{escaped[0]}][\p{{N}}--{escaped[1]}]"
        self.odd = frozenset(odd_l + odd_n)
        self.strict = regex.compile("(?V1)" + _WORDS.format(L=classes[0], N=classes[1], ln=inner)).findall
        added = sorted(tokenizer.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        #: words met anew, and those of them merged exactly
        self.met = self.failed = 0

    def _find(self, piece: str) -> list[str]:
        return self.words(piece) if piece.isascii() or self.odd.isdisjoint(piece) else self.strict(piece)

    def _learn(self, memo: dict[str, bytes], need: set[str], lead: str) -> dict[str, bytes]:
        """Add the pieces of ``need`` that are new; past the bound only those of ``need`` are kept."""
        new = list(need - memo.keys())
        if len(memo) + len(new) > MEMO_PIECES:
            memo = {k: memo[k] for k in need if k in memo}
        found = [self._find(lead + piece) for piece in new]
        words = list({w for ws in found for w in ws})
        ids, failed = self.tokenizer.encode_words([w.encode("utf-8", "surrogatepass") for w in words])
        of = dict(zip(words, ids, strict=True))
        self.met, self.failed = self.met + len(words), self.failed + failed
        for piece, ws in zip(new, found, strict=True):
            memo[piece] = of[ws[0]] if len(ws) == 1 else b"".join(map(of.__getitem__, ws))
        return memo

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian int32 bytes. No word spans a space that follows a non-space."""
        # millions of small lists without cycles: walking them for garbage would take a third of the time
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(list(texts))
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts: list[tuple[int, str, list[str]]] = []
        first, rest = set(), set()
        marks = self.tokenizer.added
        for i, text in enumerate(texts):
            for stretch in self.special.split(text) if self.special and any(m in text for m in marks) else (text,):
                if stretch in marks:
                    parts.append((i, stretch, None))
                    continue
                if _RUN.search(stretch):
                    pieces = _CUT.split(stretch)
                    first.update(pieces)
                    parts += [(i, p, []) for p in pieces]
                    continue
                head, *tail = stretch.split(" ")
                first.add(head)
                rest.update(tail)
                parts.append((i, head, tail))
        self.plain = self._learn(self.plain, first, "")
        self.spaced = self._learn(self.spaced, rest, " ")
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        out: list[list[bytes]] = [[] for _ in texts]
        for i, head, tail in parts:
            if tail is None:
                out[i].append(array("i", [marks[head]]).tobytes())
            else:
                out[i] += (plain(head), *map(spaced, tail))
        return [b"".join(x) for x in out]


def _cut_long(text: str) -> Iterator[str]:
    """A text in stretches of about BLOCK_CHARS, cut only before a space that follows a non-space."""
    at = 0
    while len(text) - at > BLOCK_CHARS and (cut := _CUT.search(text, at + BLOCK_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _strings(column: pa.Array) -> list[str]:
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


_held: list = [None, None]


def _encoder_of(shared) -> Encoder:
    if _held[0] is not shared:
        _held[:] = shared, Encoder(shared.value)
    return _held[1]


def _carried(df: DataFrame, carry: list[str] | None, name: str) -> list[int]:
    kept = df.columns if carry is None else carry
    if name.lower() in (c.lower() for c in kept):
        raise ValueError(f"column {name} exists: choose another name, or leave it out of carry")
    return [df.columns.index(c) for c in kept]


def _plus(batch: pa.RecordBatch, kept: list[int], name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], values], [*[batch.schema.names[i] for i in kept], name])


def encode(df: DataFrame, text_col: str, tokenizer: Tokenizer, name: str = "ids", carry: list[str] | None = None, packed: bool = False) -> DataFrame:
    """Adds ``name``: token ids of the whole text as array<int>, or ``packed`` as little-endian 32-bit integers.

    Strings of added tokens in a text become those tokens, as the tokenizers library has it by default. A null text is
    an empty text and has no ids; bytes that are not UTF-8 read as U+FFFD. The columns in ``carry`` (all by default)
    are kept; ``name`` must not be one of them. Rows are encoded alone: no shuffle, equal rows give equal ids, an empty
    table gives an empty one. Broadcast is the vocabulary, which does not grow with the data.
    """
    kept = _carried(df, carry, name)
    at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def column(rows: list[list[bytes]]) -> pa.Array:
        ids = [b"".join(r) for r in rows]
        if packed:
            return pa.array(ids, pa.binary())
        ends = np.cumsum([0, *[len(x) >> 2 for x in ids]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder_of(shared)
        for batch in _slices_of(batches):
            start, size = 0, 0
            done: list[list[bytes]] = []
            block: list[tuple[int, str]] = []

            def flush(block=block, done=done):
                for (i, _), ids in zip(block, encoder.encode([t for _, t in block]), strict=True):
                    done[i].append(ids)
                block.clear()

            for row, text in enumerate(_strings(batch.column(at))):
                done.append([])
                for stretch in _cut_long(text) if len(text) > BLOCK_CHARS else (text,):
                    block.append((row - start, stretch))
                    size += len(stretch)
                    if size >= BLOCK_CHARS:
                        flush()
                        size = 0
                if not block and sum(len(x) for r in done for x in r) >= 4 * BLOCK_CHARS:
                    yield _plus(batch.slice(start, row + 1 - start), kept, name, column(done))
                    start = row + 1
                    done.clear()
            flush()
            if done:
                yield _plus(batch.slice(start), kept, name, column(done))

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    return df.mapInArrow(run, T.StructType([*[df.schema.fields[i] for i in kept], T.StructField(name, kind)]))


def decode(df: DataFrame, ids_col: str, tokenizer: Tokenizer, name: str = "decoded", carry: list[str] | None = None) -> DataFrame:
    """Adds ``name``: the text of the ids (an array, or packed), added tokens included.

    Unknown ids are left out and broken UTF-8 reads as U+FFFD, as in the tokenizers library; null ids give an empty text.
    """
    kept = _carried(df, carry, name)
    at = df.columns.index(ids_col)
    packed = isinstance(df.schema[ids_col].dataType, T.BinaryType)
    shared = df.sparkSession.sparkContext.broadcast(tokenizer.token)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        get, size = tokens.__getitem__, len(tokens)
        for batch in _slices_of(batches):
            column, out = batch.column(at), []
            for row in range(batch.num_rows):
                value = column[row]
                raw = (value.as_py() if packed else value.values) if value.is_valid else b""
                ids = np.frombuffer(raw, dtype="<i4") if packed or not value.is_valid else raw.drop_null().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= size):
                    ids = ids[(ids >= 0) & (ids < size)]
                out.append(b"".join(map(get, ids.tolist())).decode("utf-8", "replace"))
            yield _plus(batch, kept, name, pa.array(out, pa.string()))

    return df.mapInArrow(run, T.StructType([*[df.schema.fields[i] for i in kept], T.StructField(name, T.StringType())]))


def count_ids(packed: str) -> F.Column:
    """Number of ids in a packed column."""
    return F.expr(f"cast(octet_length({packed}) div 4 as bigint)")
