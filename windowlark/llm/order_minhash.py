"""Near duplicates by order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles (lower case, cut at white space), each with its occurrence number. A
sketch takes the PICKS smallest of them under a seeded hash and keeps their order in the text, so it agrees
only where the same shingles come in the same order. Texts that agree in any of SKETCHES sketches are candidates.

Similarity of two texts is the length of the longest common subsequence of their shingles over the shingles of either,
lcs / (n1 + n2 - lcs): a Jaccard index that asks for the order too. It is at least SIMILARITY, or there is no
link. Two bounds decide most candidates exactly (shared shingles from above, the longest ordered run of unique
shared shingles from below); the rest are aligned in the band that the similarity leaves.

Equal texts are one class from the start. Within a bucket of candidates not all pairs are made: each member meets
the bucket's first class; after the links found so far are closed into components, only buckets that still hold
several components go on. Members outside the largest one meet the members of all other components, which decides
every pair that could still matter; pairs whose 1,024-bit signatures lie too far apart are given up there. Where they are many, the bucket is first cut finer, by one further sketch a round, which only finds
links early: a member is in one part of its bucket, so rows do not multiply, and the bucket itself stays beside its parts. After REFINE cuts its members outside the largest component
take turns, CENTRES in the first round and twice as many in each next one, until all have met. No cap drops a candidate.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windowlark.llm.components import components
from windowlark.llm.support import small_enough, whole
from windowlark.session import discard, materialize

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES, PICKS = 20, 3
#: Members outside a bucket's largest component that meet all others in one round; a bucket with no more is finished.
CENTRES = 32
#: Cuts of a bucket with more, each by another sketch, to find links before it goes on round by round.
REFINE = 2
#: Bits of the signature that cross pairs are held against: one bit of the smallest shingle under each of so many
#: hashes. Texts of Jaccard index j agree in (1 + j) / 2 of them on average.
SIGN_BITS = 1024
#: Deviations below the expected agreement at which a pair is given up (a chance of about 3 in 10 million).
SIGN_SIGMAS = 5.0
KEY_ROW_BYTES = 32
#: Hashes of shingles held at once when a text is sketched (8 MB).
AT_ONCE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_SEEDS = np.random.default_rng(12).integers(1, 1 << 63, SKETCHES, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(name: str, size: int) -> np.ndarray:
    """Powers 0 to size of the hash base, or of its inverse modulo 2**64."""
    if len(_powers[name]) <= size:
        base = int(_BASE) if name == "up" else pow(int(_BASE), -1, 1 << 64)
        steps = np.full(max(size, 1 << 16) + 1, base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][: size + 1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def shingles(plain: bytes) -> np.ndarray:
    """64-bit hashes of the five-word shingles in order; a shorter text is one shingle, an empty one none."""
    if not plain:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(plain, dtype=np.uint8)
    spaces = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(raw)]])
    if len(starts) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * _power("up", len(raw))[: len(raw)], out=prefix[1:])
    return _mix((prefix[ends] - prefix[starts]) * _power("down", len(raw))[starts])


def labelled(h: np.ndarray) -> np.ndarray:
    """Each hash with the number of its earlier occurrences."""
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]]) if len(h) else np.empty(0, dtype=bool)
    if not same.any():
        return h
    index = np.arange(len(h))
    run_start = np.maximum.accumulate(np.where(same, 0, index))
    times = np.empty(len(h), dtype=np.uint64)
    times[order] = (index - run_start).astype(np.uint64)
    return np.where(times > 0, _mix(h + times * _BASE), h)


def sketches(h: np.ndarray) -> list[int]:
    """One signed 64-bit value per sketch: the smallest labelled shingles in text order."""
    if not len(h):
        return []
    h = labelled(h)
    value = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    if len(h) > PICKS:
        step = max(1, AT_ONCE // len(h))
        picked = [np.argpartition(_mix(h ^ _SEEDS[i : i + step, None]), PICKS - 1, axis=1)[:, :PICKS] for i in range(0, SKETCHES, step)]
        own = h[np.sort(np.concatenate(picked), axis=1)]
    else:
        own = np.broadcast_to(h, (SKETCHES, len(h)))
    for column in own.T:
        value = _mix(value * _BASE + column)
    return value.astype(np.int64).tolist()


_SIGN_ODDS = np.random.default_rng(13).integers(1, 1 << 63, SIGN_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(h: np.ndarray) -> list[int]:
    """SIGN_BITS bits in signed 64-bit words, from the labelled shingles."""
    h = labelled(h)
    step = max(1, AT_ONCE // max(1, len(h)))
    blocks = [(h * _SIGN_ODDS[i : i + step, None]).min(axis=1) for i in range(0, SIGN_BITS, step)] if len(h) else [np.zeros(SIGN_BITS, dtype=np.uint64)]
    smallest = np.concatenate(blocks)
    bits = (_mix(smallest) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view("<i8").tolist()


def most_differing(similarity: float) -> int:
    """Bits in which texts of that similarity may differ."""
    p = (1 + similarity) / 2
    return int(SIGN_BITS * (1 - p) + SIGN_SIGMAS * np.sqrt(SIGN_BITS * p * (1 - p))) + 1


def signed_texts(texts: DataFrame) -> DataFrame:
    """(key, sign) of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                signs = [signature(shingles(normal(t.as_py()))) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.list_(pa.int64()))], ["key", "sign"])

    return texts.select("key", "text").mapInArrow(run, "key binary, sign array<long>")


def _increasing(values: np.ndarray) -> int:
    """Length of the longest strictly increasing subsequence."""
    tails: list[int] = []
    for v in values.tolist():
        at = bisect_left(tails, v)
        if at == len(tails):
            tails.append(v)
        else:
            tails[at] = v
    return len(tails)


def _banded_lcs(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence whose alignment leaves the diagonal by at most ``band``."""
    best = np.zeros(len(b) + 1, dtype=np.int32)
    for i in range(len(a)):
        low, high = max(0, i - band), min(len(b), i + band + 1)
        if low >= high:
            break
        row = np.maximum(best[low + 1 : high + 1], best[low:high] + (b[low:high] == a[i]))
        np.maximum.accumulate(row, out=row)
        np.maximum(row, best[low], out=row)
        best[low + 1 : high + 1] = row
        best[high + 1 :] = best[high]
    return int(best[-1])


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether lcs / (n1 + n2 - lcs) reaches the similarity."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    need = similarity * (len(a) + len(b)) / (1 + similarity) - 1e-9
    if min(len(a), len(b)) < need:
        return False
    la, lb = labelled(a), labelled(b)
    shared, in_a, in_b = np.intersect1d(la, lb, assume_unique=True, return_indices=True)
    if len(shared) < need:
        return False
    if _increasing(in_b[np.argsort(in_a)]) >= need:
        return True
    # an alignment with at least `need` matches strays from the diagonal by the shingles it leaves out at most
    return _banded_lcs(a, b, int(max(len(a), len(b)) - need) + 1) >= need


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), whole(text_col))


def sketch_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rk, key, n, sk): row key, class of equal normalised text, shingles and sketches of every row."""
    rows = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                keys, sizes, lists = [], [], []
                for text in batch.column(2):
                    plain = normal(text.as_py())
                    h = shingles(plain)
                    keys.append(xxhash.xxh3_128_digest(plain))
                    sizes.append(len(h))
                    lists.append(sketches(h))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    ["id", "rk", "key", "n", "sk"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, rk long, key binary, n long, sk array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are alike."""
    left, right = texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                held: dict[bytes, np.ndarray] = {}
                good = []
                for a, b, ta, tb in zip(*[batch.column(i) for i in range(4)], strict=True):
                    ka, kb = a.as_py(), b.as_py()
                    if ka not in held:
                        held[ka] = shingles(normal(ta.as_py()))
                    good.append(alike(held[ka], shingles(normal(tb.as_py())), similarity))
                    if len(held) > 100:
                        held.clear()
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a binary, b binary")


def _stars(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): the first class of every bucket with each other member not yet linked to it; and the written first classes."""
    first = F.min(F.struct("ord", "key", "n", "comp"))
    most, least = F.max("comp"), F.min("comp")
    centres = materialize(
        buckets.groupBy("bucket").agg(first.alias("c"), most.alias("most"), least.alias("least")).where("least <> most").select("bucket", "c.key", "c.n", "c.comp")
    ).withColumnsRenamed({"bucket": "cb", "key": "a", "n": "an", "comp": "ac"})
    met = buckets.join(centres, F.col("bucket") == F.col("cb")).where("comp <> ac")
    return met.select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b"), "an", "n"), centres


def _possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """Drops pairs whose lengths rule the similarity out, and repeats."""
    return pairs.where(F.least("an", "n") >= F.greatest("an", "n") * similarity - 1e-9).select("a", "b").distinct()


def links(classes: DataFrame, texts: DataFrame, similarity: float, shared: DataFrame | None = None) -> DataFrame | None:
    """(node, comp) of all classes that have a link, or None if there is none. ``shared``: the buckets of several classes, if known."""
    spread = classes.select("key", "n", "ord", F.posexplode("sk").alias("last", "v"))
    buckets = spread.select(F.xxhash64("last", "v").alias("bucket"), "key", "n", "ord", "last")
    if shared is not None:
        buckets = buckets.join(F.broadcast(shared) if small_enough(shared, KEY_ROW_BYTES) else shared, "bucket", "left_semi")
    buckets = materialize(buckets)
    sk = classes.select(F.col("key").alias("k"), "sk")
    edges = tested = signs = labels = None
    depth = 0
    stars, centres = _stars(buckets.withColumn("comp", F.col("key")))
    pairs = _possible(stars, similarity)
    spent = [centres]
    while True:
        pairs = materialize(pairs)
        # the pairs are written: what they were made from is not read again
        discard(*spent)
        found = materialize(_verify(pairs, texts, similarity))
        tested = pairs if tested is None else tested.unionAll(pairs)
        edges = found if edges is None else edges.unionAll(found)
        if found.head(1):
            if labels is not None:
                discard(labels)
            labels = components(edges)
        state = buckets
        if labels is not None:
            state = buckets.join(labels.withColumnRenamed("node", "k"), F.col("key") == F.col("k"), "left").drop("k")
            state = state.withColumn("comp", F.coalesce("comp", "key"))
        else:
            state = state.withColumn("comp", F.col("key"))
        # per bucket: its size, its largest component, and how many members lie outside of it
        parts = state.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
        sizes = parts.groupBy("bucket").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"))
        # one component, or two members that have met: nothing is left to decide
        sizes = sizes.where("m > top.c AND m > 2").select(
            F.col("bucket").alias("sb"), "m", F.col("top.comp").alias("main"), (F.col("m") - F.col("top.c")).alias("out")
        )
        sizes = materialize(sizes)
        if not sizes.head(1):
            discard(sizes, buckets, edges, tested, *([] if signs is None else [signs]))
            return labels
        if signs is None:
            signs = materialize(signed_texts(texts)).withColumnRenamed("key", "k")
        state = state.join(sizes, F.col("bucket") == F.col("sb")).drop("sb")
        state = materialize(state.join(signs, F.col("key") == F.col("k")).drop("k"))
        discard(sizes, buckets)
        cut_more = depth < REFINE
        # members outside the largest component meet all members of other components: then every cross pair is decided
        place = F.row_number().over(Window.partitionBy("bucket").orderBy("ord", "key"))
        outside = state.where(F.col("comp") != F.col("main"))
        few = F.col("out") <= CENTRES
        outside = outside.where(few if cut_more else few | (F.col("last") < SKETCHES))
        served = outside.withColumn("place", place).where(F.col("place") <= CENTRES << max(0, depth - REFINE))
        served = materialize(served.select(F.col("bucket").alias("ob"), F.col("key").alias("a"), F.col("n").alias("an"), F.col("comp").alias("oc"), F.col("sign").alias("osign")))
        differ = sum(F.bit_count(F.get("sign", F.lit(i)).bitwiseXOR(F.get("osign", F.lit(i)))) for i in range(SIGN_BITS // 64))
        cross = state.join(served, (F.col("bucket") == F.col("ob")) & (F.col("comp") != F.col("oc")) & (differ <= most_differing(similarity)))
        pairs = cross.select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b"), "an", "n")
        spent = [state, served]
        # the members of large buckets; a part of an earlier cut (past the last sketch) has been searched, its bucket is there itself
        big = state.where((F.col("out") > CENTRES) & (F.col("last") < SKETCHES)).select("bucket", "key", "n", "ord", "last", "comp")
        if cut_more:
            by = (F.col("last") + (depth + 1)) % SKETCHES
            cut = big.join(sk, F.col("key") == F.col("k"))
            cut = materialize(cut.select(F.xxhash64("bucket", by, F.get("sk", by)).alias("bucket"), "key", "n", "ord", F.lit(SKETCHES).alias("last"), "comp"))
            stars, centres = _stars(cut)
            pairs = pairs.unionAll(stars)
            spent += [cut, centres]
            buckets = materialize(cut.unionAll(big).drop("comp"))
        else:
            # who has been served has met every other component and leaves the bucket
            gone = served.select(F.col("ob").alias("gb"), F.col("a").alias("ga"))
            rest = big.join(gone, (F.col("bucket") == F.col("gb")) & (F.col("key") == F.col("ga")), "left_anti")
            buckets = materialize(rest.select("bucket", "key", "n", "ord", "last"))
        depth += 1
        ordered = _possible(pairs, similarity)
        done = tested.select(F.col("a").alias("x"), F.col("b").alias("y"))
        pairs = ordered.join(done, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept and the row key rk.

    A group is a set of texts connected by links; the row with the smallest id (null ids last) stays and names it.
    Null, empty and blank texts are one group. Texts of fewer than five words are near only if their words are the same.
    Rows that repeat id and text are alike in everything but ``kept``, which one of them has. Other columns are
    not read; an empty table gives an empty result.
    """
    rows = materialize(sketch_rows(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    place = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("rk").alias("rk"), F.col("row").alias("row"))
    classes = materialize(
        rows.groupBy("key").agg(F.min(place).alias("ord"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("sk").alias("sk"))
    )
    # texts of the classes that share a bucket with another
    spread = classes.select("key", F.col("ord.rk").alias("rk"), F.posexplode("sk").alias("last", "v")).select("key", "rk", F.xxhash64("last", "v").alias("bucket"))
    shared = materialize(spread.groupBy("bucket").count().where("count > 1").select("bucket"))
    wanted = materialize(spread.join(shared, "bucket", "left_semi").select("key", "rk").distinct())
    sent = F.broadcast(wanted) if small_enough(wanted, KEY_ROW_BYTES) else wanted
    keyed = docs.select(_row_key(id_col, text_col).alias("rk"), whole(text_col).alias("text"))
    texts = materialize(keyed.join(sent, "rk").groupBy("key").agg(F.any_value("text").alias("text")))
    labels = links(classes.select("key", "n", "ord", "sk"), texts, similarity, shared)
    discard(shared, wanted, texts)
    grouped = classes.select("key", "ord", "copies")
    if labels is None:
        grouped = grouped.withColumn("comp", F.col("key"))
    else:
        grouped = grouped.join(labels.withColumnRenamed("node", "k"), F.col("key") == F.col("k"), "left").drop("k")
        grouped = grouped.withColumn("comp", F.coalesce("comp", "key"))
    heads = materialize(grouped.groupBy("comp").agg(F.min("ord").alias("head"), F.sum("copies").alias("group_size")))
    named = materialize(grouped.select("key", "comp").join(heads, "comp").select(F.col("key").alias("k"), "head", "group_size"))
    discard(classes, heads)
    return rows.join(named, F.col("key") == F.col("k")).select(
        F.col("id").alias(id_col), F.col("head.id").alias("keep_id"), "group_size", (F.col("head.row") == F.col("row")).alias("kept"), "rk"
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; columns and the rows that stay are unchanged."""
    judged = near_duplicates(docs, id_col, text_col, similarity)
    # rows that repeat id and text share a row key: of those that stay, all but one go
    tally = materialize(judged.groupBy("rk").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"))
    sent = F.broadcast(tally) if small_enough(tally, KEY_ROW_BYTES) else tally
    marked = docs.withColumn("_rk", _row_key(id_col, text_col)).join(sent.withColumnsRenamed({"rk": "_k", "kept": "_kept", "n": "_n"}), F.col("_rk") == F.col("_k"), "left")
    once = marked.where("_k IS NULL").select(*docs.columns)
    repeated = marked.where("_kept").dropDuplicates(["_rk"]).select(*docs.columns)
    return once.unionAll(repeated)
