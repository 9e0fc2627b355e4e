"""Divergence of sources within a language, exact, by a frequent-pattern tree of term rows.

A term row lists, in a fixed order of the language's sources, the scaled frequencies of a term in the sources that have it
at all. For a pair of sources the sum over all terms is the sum as if no term occurred in either, plus what
each source's own nonzero entries change alone, plus a correction for terms that both have. The corrections come from a prefix
tree of the rows, inserted with multiplicities: a node is a (source, frequency) after all nonzero entries
before it, and each (node, ancestor) combination is computed once, times the number of terms below the node.

Rows with equal paths are counted before the shuffle. Ranges of sorted paths go to tasks, so that common prefixes meet;
a task walks its part of the tree depth first as the paths arrive and holds only a block of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowlark.session import materialize

#: A kept term is in at least so many documents of its language.
MIN_DOCS = 3
#: Frequencies are scaled to so many parts.
PARTS = 1_000_000_000
#: Ranks of terms that are returned.
TOP_TERMS = 200
#: Distinct terms that a task counts before it hands them on.
COUNTED_TERMS = 400_000
#: (node, ancestor) combinations computed at once.
BLOCK_COMBINATIONS = 1 << 20

#: A-Z to lower case; bytes outside letters and UTF-8 sequences to spaces. No byte of a longer UTF-8 sequence is below 0x80.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Corrections are summed in two parts so that no sum of 64 bits overflows.
_LOW_BITS = 31


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial counts (lang, source, term, uses, docs): occurrences, and documents with the term, per task block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (uses, within) in held.items():
                terms = list(uses)
                for start in range(0, len(terms), 50_000):
                    part = terms[start : start + 50_000]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * n), pa.array([source] * n), pa.array(part, pa.binary()).cast(pa.string()),
                         pa.array([uses[t] for t in part], pa.int64()), pa.array([within[t] for t in part], pa.int64())],
                        ["lang", "source", "term", "uses", "docs"],
                    )
            held.clear()

        distinct = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").translate(_FOLD).split()
                uses, within = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                distinct -= len(uses)
                uses.update(words)
                within.update(set(words))
                distinct += len(uses)
                if distinct >= COUNTED_TERMS:
                    yield from flush()
                    distinct = 0
        yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, uses long, docs long")


def _scaled(uses: str, total: str, terms: str) -> Column:
    """1 + floor(PARTS * (uses + 1) / (total + terms)), exact; null if nothing is there to divide by."""
    below = f"nullif(cast({total} + {terms} as decimal(20,0)), cast(0 as decimal(20,0)))"
    return F.expr(f"1L + cast(cast({PARTS} as decimal(10,0)) * cast({uses} + 1 as decimal(20,0)) div {below} as bigint)")


def _p_of(e: Column) -> Column:
    """``_scaled`` of an entry with uses and total, among the terms of its row."""
    above = F.lit(PARTS).cast("decimal(10,0)") * (e["uses"] + 1).cast("decimal(20,0)")
    return F.call_function("div", above, (e["total"] + F.col("terms")).cast("decimal(20,0)")).cast("bigint") + 1


def _gain(p: str, q: str) -> str:
    """floor((p - q)^2 / q); frequencies are at most PARTS + 1, so the square has 60 bits."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _gains(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def tree_corrections(lang: np.ndarray, ends: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Corrections of ordered source pairs from the prefix tree of sorted paths.

    ``lang`` and ``times`` are per path, ``ends`` their ends in the flat entries ``source``, ``p`` and ``p0`` (the source's frequency of
    an absent term). Yields (lang, group, item, high, low) with the sum in two parts, for a block of combinations at a time.
    """
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1]]) if n else ends
    sizes = ends - starts
    row = np.repeat(np.arange(n), sizes)
    depth = np.arange(len(row)) - starts[row]
    # the first path through a node stands for it; the paths below a node are consecutive
    is_node = np.zeros(len(row), dtype=bool)
    below = np.zeros(len(row), dtype=np.int64)
    same = np.concatenate([[False], lang[1:] == lang[:-1]])
    for level in range(int(sizes.max(initial=0))):
        here = np.flatnonzero(sizes > level)
        at, prior = starts[here] + level, starts[np.maximum(here - 1, 0)] + level
        same = same[:n] & np.concatenate([[False], (sizes[1:] > level) & (sizes[:-1] > level)])
        prior = np.where(same[here], prior, at)
        joined = np.zeros(n, dtype=bool)
        joined[here] = same[here] & (source[at] == source[prior]) & (p[at] == p[prior])
        same = joined
        new = np.flatnonzero(~joined[here])
        is_node[at[new]] = True
        below[at[new]] = np.add.reduceat(times[here], new)
    nodes = np.flatnonzero(is_node & (depth > 0))
    wide = int(source.max(initial=0)) + 1
    cuts = np.cumsum(depth[nodes])
    begin = 0
    while begin < len(nodes):
        done = cuts[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(cuts, done + BLOCK_COMBINATIONS, side="right")))
        some = nodes[begin:end]
        node = np.repeat(some, depth[some])
        first = np.cumsum(depth[some]) - depth[some]
        above = starts[row[node]] + np.arange(len(node)) - np.repeat(first, depth[some])
        count, base = below[node], lang[row[node]].astype(np.int64) * wide
        totals = []
        for a, b in ((above, node), (node, above)):
            change = _gains(p[a], p[b]) - _gains(p[a], p0[b]) - _gains(p0[a], p[b]) + _gains(p0[a], p0[b])
            totals.append(((base + source[a]) * wide + source[b], count * (change >> _LOW_BITS), count * (change & ((1 << _LOW_BITS) - 1))))
        key, high, low = (np.concatenate(x) for x in zip(*totals, strict=True))
        keys, where = np.unique(key, return_inverse=True)
        sums = np.zeros((2, len(keys)), dtype=np.int64)
        np.add.at(sums[0], where, high)
        np.add.at(sums[1], where, low)
        yield keys // wide // wide, keys // wide % wide, keys % wide, sums[0], sums[1]
        begin = end


def _corrections(paths: DataFrame) -> DataFrame:
    """(lang, ix, other, change) from paths (lang, path, times), sorted by path in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            lists = batch.column(1)
            entries = lists.flatten()
            ends = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
            source, p, p0 = (np.asarray(c).astype(np.int64) for c in entries.flatten())
            for lang, group, item, high, low in tree_corrections(np.asarray(names.indices), ends.astype(np.int64), source, p, p0, np.asarray(batch.column(2))):
                yield pa.RecordBatch.from_arrays(
                    [names.dictionary.take(pa.array(lang)), *[pa.array(x) for x in (group.astype(np.int32), item.astype(np.int32), high, low)]],
                    ["lang", "ix", "other", "high", "low"],
                )

    parts = paths.mapInArrow(run, "lang string, ix int, other int, high long, low long")
    change = F.expr(f"sum(cast(high as decimal(20,0)) * {1 << _LOW_BITS} + low)").cast("decimal(38,0)")
    return parts.groupBy("lang", "ix", "other").agg(change.alias("change"))


def source_divergence(docs: DataFrame, top: int = TOP_TERMS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Divergence of each source from each other source of its language, and the terms that mark it.

    Null text, lang and source read as ''. Terms are runs of letters A-Z (lower-cased) and non-ASCII characters; a language
    keeps those in at least ``min_docs`` of its documents, and V is their number. A group (lang, source) or a language gives
    a kept term p = 1 + floor(10^9 * (count + 1) / (N + V)), N being the sum of its counts; f = floor((p - q)^2 / q).
    Part ``pair``: value is the sum of f over all kept terms, q the other source's p, for every other source; 0 if V is 0. Part
    ``term``: f of terms the group has with p above the language's q, the best ``top``. Returns lang, source, part, item,
    value, rank. All integers are exact; a sum beyond 64 bits fails instead of wrapping. Repeated rows count as often as they are
    there, an empty table gives an empty result, other columns of ``docs`` take no part.

    A language's sources are control data: their numbers and totals make one row per language.
    """
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "text")
    # sources with more documents first, so that common entries head the paths
    place = (F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source")) - 1).cast("int")
    groups = materialize(named.groupBy("lang", "source").agg(F.count("*").alias("n")).select("lang", "source", place.alias("ix")))

    # one exchange: a task sends a term at most once per source and block; both groupings then agree with it
    parts = term_counts(named).join(groups, ["lang", "source"]).select("lang", "ix", "term", "uses", "docs").repartition("lang", "term")
    by_source = parts.groupBy("lang", "term", "ix").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
    kept = materialize(
        by_source.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"), F.array_sort(F.collect_list(F.struct("ix", "uses"))).alias("entries"))
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )

    used = kept.select("lang", F.inline("entries")).groupBy("lang", "ix").agg(F.sum("uses").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("uses").alias("lang_total"))
    filled = groups.join(used, ["lang", "ix"], "left").join(sizes, "lang", "left")
    group = materialize(
        filled.select("lang", "source", "ix", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "terms", "lang_total")])
        .withColumn("p0", _scaled("0", "total", "terms"))
    )
    langs = materialize(
        group.where("terms > 0").groupBy("lang", "terms", "lang_total")
        .agg(F.array_sort(F.collect_list(F.struct("ix", "total", "p0"))).alias("sources"))
    )

    scaled = kept.join(langs, "lang")
    entry = F.transform(
        "entries",
        lambda e: F.struct(e["ix"].alias("ix"), e["uses"].alias("uses"), F.get("sources", e["ix"])["total"].alias("total"), F.get("sources", e["ix"])["p0"].alias("p0")),
    )
    flat = scaled.select("lang", "term", "terms", "lang_total", F.col("uses").alias("lang_uses"), entry.alias("entries"))

    p = F.transform("entries", lambda e: F.struct(e["ix"].alias("ix"), _p_of(e).alias("p"), e["p0"].alias("p0")))
    paths = materialize(flat.select("lang", p.alias("path")).groupBy("lang", "path").agg(F.count("*").alias("times")))
    long_paths = paths.where(F.size("path") > 1).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    both = _corrections(long_paths)

    alone = paths.select("lang", "times", F.inline("path")).groupBy("lang", "ix", "p", "p0").agg(F.sum("times").alias("times"))
    others = group.select("lang", F.col("ix").alias("other"), F.col("p0").alias("q0"))
    met = alone.join(others, "lang").where("ix != other")
    change = {True: f"{_gain('p', 'q0')} - {_gain('p0', 'q0')}", False: f"{_gain('q0', 'p')} - {_gain('q0', 'p0')}"}
    sides = met.groupBy("lang", "ix", "other").agg(
        *[F.expr(f"sum(cast(times as decimal(20,0)) * cast({c} as decimal(20,0)))").cast("decimal(38,0)").alias(f"side_{own}".lower()) for own, c in change.items()]
    )
    one = sides.select("lang", "ix", "other", F.col("side_true").alias("change"))
    two = sides.select("lang", F.col("other").alias("ix"), F.col("ix").alias("other"), F.col("side_false").alias("change"))
    changes = both.unionByName(one).unionByName(two).groupBy("lang", "ix", "other").agg(F.sum("change").alias("change"))

    named_others = group.select("lang", F.col("ix").alias("other"), F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = group.join(named_others, "lang").where("ix != other").join(changes, ["lang", "ix", "other"], "left")
    base = F.expr(f"coalesce(cast(terms as decimal(20,0)) * cast({_gain('p0', 'q0')} as decimal(20,0)), 0)")
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce("change", F.lit(0))).cast("bigint").alias("value"))

    own = flat.select("lang", "term", _scaled("lang_uses", "lang_total", "terms").alias("q"), "terms", F.inline("entries"))
    marked = own.withColumn("p", _scaled("uses", "total", "terms")).where("p > q").select("lang", "ix", "term", F.expr(_gain("p", "q")).alias("value"))
    best = Window.partitionBy("lang", "ix").orderBy(F.desc("value"), "term")
    leading = marked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    term = leading.join(groups, ["lang", "ix"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(term)
