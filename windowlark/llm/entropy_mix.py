"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate: how often the mix repeats it. Of all rates that meet the token target of each source
and stay between 0 and ``most`` (3), take those of least relative entropy to "every document once". Their dual is
convex with one unknown per source, and a document of ``size`` tokens has the rate

    rate(z) = most / (1 + (most - 1) * exp(-z)),  z = lambda[source] * size / mean size of the source

an exponential tilt that saturates at the bound (rate(0) = 1). Newton steps on all lambdas run together as Spark
jobs over (source, size, count), a sufficient summary made map-side; a step that leaves the bracket of the
root is replaced by bisection. Rates become whole copies by a hashed offset per document; a three-level radix
selection then finds, per source, which documents to round the other way to come closest to the target.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowlark.llm.support import small_enough, whole
from windowlark.session import materialize

MOST = 3
WEIGHTS = (5.0, 2.0, 1.0)
#: Radix digits of the shift: three passes of 2**10 bins each.
DIGIT_BITS, DIGITS = 10, 3
#: After the shift, so many rounds fill what one more document would overshoot.
FILL_ROUNDS = 3

SOURCE_ROW_BYTES = 256

_WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column | str) -> Column:
    return F.regexp_count(whole(text), F.lit(_WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares by weight of all tokens, none above ``most`` times its size.

    Sources in code-point order, null last, take the weights in turn. The excess of a full source is shared
    among the others by weight until none is above: a source is full when its own limit per weight is
    under the final level, so one pass in order of limit per weight finds the level. One row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", weight)
    limit = F.col("source_size") * F.lit(float(most))
    ranked = totals.withColumn("ratio", limit / F.col("w"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(0, Window.unboundedFollowing)
    # level if exactly the sources before this one are full
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("w").over(after)
    tried = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))
    final = F.min(fits).over(everything)["level"]
    target = F.when(F.col("ratio") <= F.coalesce(final, F.lit(float("inf"))), limit).otherwise(F.col("w") * final)
    return tried.select("source", "source_size", target.alias("target"))


def _rate(z: Column, most: int) -> Column:
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(-z))


def solve_dual(sizes: DataFrame, targets: DataFrame, most: int = MOST, steps: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """(source, lambda, mean) by safeguarded Newton steps, all sources in each job.

    Stops when every source meets its target within ``tolerance``. Sources at their limit, or without tokens,
    have no finite root and keep lambda null.
    """
    summary = materialize(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    means = summary.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    open_ended = targets.where((F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * most * (1 - 1e-12)))
    state = materialize(
        open_ended.join(means.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "target", "mean", F.lit(0.0).alias("lam"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"))
    )
    for _ in range(steps):
        at = state.withColumnsRenamed({"source": "s"})
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("lam") * x, most)
        got = F.sum(F.col("n") * F.col("size") * rate)
        slope = F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / most))
        sums = (
            summary.join(at, F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source", "target", "mean", "lam", "low", "high")
            .agg(got.alias("got"), slope.alias("slope"))
        )
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - (F.col("got") - F.col("target")) / F.greatest("slope", F.lit(1e-300))
        inside = (newton > F.col("low2")) & (newton < F.col("high2"))
        moved = F.when(F.abs(F.col("got") / F.col("target") - 1) <= tolerance, F.col("lam")).when(inside, newton)
        state = materialize(
            sums.withColumns({"low2": low, "high2": high}).select(
                "source", "target", "mean", moved.otherwise((F.col("low2") + F.col("high2")) / 2).alias("lam"),
                F.col("low2").alias("low"), F.col("high2").alias("high"),
                F.abs(F.col("got") / F.col("target") - 1).alias("gap"),
            )
        )
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= tolerance:
            break
    # sums of doubles depend on the order of tasks in their last digits; a rounded root does not
    return state.select("source", F.round("lam", 9).alias("lam"), "mean")


def _largest_cut(rows: DataFrame, sources: DataFrame, nearest: bool, send: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(source, gap, cut): leading documents, in order of ``flip``, whose sizes add up to at most ``gap``.

    ``rows`` has source, size and flip (0 to 2**30); ``sources`` has source and gap. Documents with flip below the
    cut are taken and the gap returned is what they leave. Each pass bins one digit of flip, so documents are
    never put in order. ``nearest`` takes one bin more if that ends closer to the gap.
    """
    state = sources.select("source", F.col("gap").cast("double").alias("gap"), F.lit(0).cast("bigint").alias("cut"))
    for digit in range(DIGITS):
        width = 1 << DIGIT_BITS * (DIGITS - 1 - digit)
        at = state.withColumnsRenamed({"source": "s"})
        inside = (F.col("flip") >= F.col("cut")) & (F.col("flip") < F.col("cut") + width * (1 << DIGIT_BITS))
        bins = (
            rows.join(send(at), F.col("source").eqNullSafe(F.col("s")))
            .where(inside)
            .groupBy("source", F.floor((F.col("flip") - F.col("cut")) / width).alias("bin"))
            .agg(F.sum("size").alias("tokens"))
        )
        run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("tokens").over(run)).withColumnRenamed("source", "s")
        joined = state.join(bins, F.col("source").eqNullSafe(F.col("s")), "left")
        fits = F.col("upto") <= F.col("gap")
        if nearest and digit == DIGITS - 1:
            fits = fits | (2 * F.col("upto") - F.col("tokens") <= 2 * F.col("gap"))
        taken = F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))
        # stand at the first bin that does not fit; if all do, at the end of this digit's range
        stands = F.coalesce(F.min(F.when(~fits, F.col("bin"))), F.lit(1 << DIGIT_BITS))
        state = materialize(
            joined.groupBy("source", "gap", "cut")
            .agg(taken.alias("taken"), stands.alias("stands"))
            .select("source", (F.col("gap") - F.col("taken")).alias("gap"), (F.col("cut") + F.col("stands") * width).alias("cut"))
        )
    return state


_S, _ID, _SIZE = "_m_source", "_m_id", "_m_size"
_SPAN = 1 << DIGIT_BITS * DIGITS


def _by_source(df: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
    """Join a per-source table (its key named s) to rows that carry the source."""
    return df.join(table, F.col(_S).eqNullSafe(F.col("s")), how).drop("s")


def _start(df: DataFrame, per_source: DataFrame, most: int) -> DataFrame:
    """Adds the rate, the copies below it after a hashed offset, and how far the next copy is."""
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    tilted = _rate(F.col("lam") * F.col(_SIZE) / F.col("mean"), most)
    rate = F.when(F.col(_SIZE) == 0, F.lit(1.0)).when(full, F.lit(float(most))).otherwise(tilted)
    # a uniform offset per document: rounding down after it takes `rate` copies on average
    lifted = F.col("rate") + F.pmod(F.xxhash64(_ID, F.lit(9)), F.lit(_SPAN)) / F.lit(float(_SPAN))
    up = F.least(F.floor((1 - (lifted - F.floor(lifted))) * _SPAN), F.lit(_SPAN - 1))
    return (
        _by_source(df, per_source)
        .withColumn("rate", rate)
        .withColumns({"_m_base": F.least(F.floor(lifted), F.lit(most)).cast("bigint"), "_m_up": up.cast("bigint")})
    )


def _turn(df: DataFrame, ways: DataFrame, most: int) -> DataFrame:
    """Adds the way a source has to move (1, 0, -1), which documents can follow, and in which order."""
    can = F.when(F.col("way") > 0, F.col("_m_base") < most).otherwise((F.col("way") < 0) & (F.col("_m_base") > 0))
    flip = F.when(F.col("way") > 0, F.col("_m_up")).otherwise(_SPAN - 1 - F.col("_m_up"))
    return _by_source(df, ways).withColumns({"_m_flip": flip, "_m_can": can & (F.col(_SIZE) > 0), "_m_moved": F.lit(False)})


def _fill(df: DataFrame, step: DataFrame, fitting: Column) -> DataFrame:
    """Marks the documents that one fill round moves; ``step`` has s, room and cut."""
    now = F.col("_m_can") & fitting & (F.col("_m_flip") < F.col("cut"))
    return _by_source(df, step).withColumn("_m_moved", F.col("_m_moved") | F.coalesce(now, F.lit(False))).drop("room", "cut")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
    carry: bool = False,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies, taken; all columns with ``carry``.

    ``taken`` is copies times size. A null text has size 0 and is taken with rate 1; a null source is a source of its own,
    last in order. Rows that repeat an id get the same copies if their size and source agree. Choices are hashes
    of the id, so reruns agree. Without ``carry`` other columns are not read; with it, columns of ``docs`` named
    like a result are replaced. An empty table gives an empty result. Every job but the first reads a written table of
    (id, source, size); documents meet per-source tables only, so texts are not shuffled while these are small.
    """
    keys = {_ID: F.col(id_col), _S: F.col(source_col), _SIZE: words_in(text_col)}
    narrow = materialize(docs.select(*[c.alias(n) for n, c in keys.items()]))
    sizes = narrow.select(F.col(_S).alias("source"), F.col(_SIZE).alias("size"))
    targets = materialize(source_targets(sizes, weights, most))
    dual = solve_dual(sizes, targets, most).withColumnRenamed("source", "s")
    per_source = materialize(
        targets.join(dual, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "s")
    )
    few = small_enough(per_source, SOURCE_ROW_BYTES)

    def send(table: DataFrame) -> DataFrame:
        """Per-source tables go to every executor if the sources, by their count, stay under the bound."""
        return F.broadcast(table) if few else table

    rated = materialize(_start(narrow, send(per_source), most).select(_ID, _S, _SIZE, "target", "_m_base", "_m_up"))
    sums = rated.groupBy(_S, "target").agg(F.sum(F.col("_m_base") * F.col(_SIZE)).alias("now"))
    wanted = materialize(sums.select(F.col(_S).alias("source"), (F.col("target") - F.col("now")).alias("gap")))
    # a source that is short gives one more copy to documents with the least way up; one that is over takes one
    # back from those with the least way down; later rounds fill what is left with documents that still fit
    ways = wanted.select(F.col("source").alias("s"), F.signum("gap").cast("int").alias("way"))
    rows = _turn(rated, send(ways), most)
    gaps = wanted.select("source", F.abs("gap").alias("gap"))
    steps = []
    for round_ in range(FILL_ROUNDS):
        last = round_ == FILL_ROUNDS - 1
        fitting = F.col(_SIZE) <= F.col("room") * (2 if last else 1)
        room = gaps.select(F.col("source").alias("s"), F.col("gap").alias("room"))
        free = _by_source(rows, send(room), "inner").where(F.col("_m_can") & ~F.col("_m_moved") & fitting)
        free = free.select(F.col(_S).alias("source"), F.col(_SIZE).alias("size"), F.col("_m_flip").alias("flip"))
        cuts = _largest_cut(free, gaps, last, send)
        cut = cuts.select(F.col("source").alias("s2"), "cut")
        steps.append((materialize(room.join(cut, F.col("s").eqNullSafe(F.col("s2"))).drop("s2")), fitting))
        rows = _fill(rows, send(steps[-1][0]), fitting)
        gaps = cuts.select("source", "gap")

    results = ["size", "source_size", "target", "rate", "copies", "taken"]
    base = docs.withColumns(keys).drop(*results) if carry else narrow
    out = _turn(_start(base, send(per_source), most), send(ways), most)
    for step, fitting in steps:
        out = _fill(out, send(step), fitting)
    copies = F.col("_m_base") + F.when(F.col("_m_moved"), F.col("way")).otherwise(0)
    out = out.withColumns({"copies": copies.cast("bigint"), "size": F.col(_SIZE)})
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    first = [c for c in docs.columns if c not in results] if carry else [F.col(_ID).alias(id_col), F.col(_S).alias(source_col)]
    return out.select(*first, *results)
