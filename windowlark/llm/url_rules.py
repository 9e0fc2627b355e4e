"""URL allow and block rules by a sort-merge range join, in DataFrame operations only.

Every host is taken apart into its levels, top label first (``net``, ``net.example``, ...), down to the deepest level
that has a rule. A level and the
path make one canonical key, ``net.example#/en/``; a rule is then the interval of keys that start with its
own key, and the rules of one level are nested intervals. Rule starts, rule ends and URL keys are sorted
together by range partitions. The sweep pushes a rule at its start, pops it at its end, and a URL key
takes the top of the stack. As intervals are nested, the top after a pop is the rule's parent, known from the
rules alone, so the sweep is a running last value; one carried row joins a range to those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowlark.operators.ordered import lay_out
from windowlark.session import materialize

#: Cannot be part of a host or a path, which both end at it.
MARK = "#"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _turned(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _key(level: Column, path: Column) -> Column:
    return F.concat(level, F.lit(MARK), path).cast("binary")


def stack_steps(rules: DataFrame) -> DataFrame:
    """(level, key, top): the rule on top of the stack from each key on; null when the stack is empty.

    ``rules`` has host, path, verdict. Of rules with the same host and path, block outweighs allow. Windows
    here run over the rules of one host, which are control data.
    """
    level = F.concat_ws(".", _turned(F.translate(F.trim("host"), _UPPER, _LOWER)))
    named = rules.where(F.col("host").isNotNull() & (F.trim("host") != "")).select(
        level.alias("level"), F.concat(F.col("host"), F.coalesce("path", F.lit(""))).alias("rule"),
        F.coalesce("path", F.lit("")).alias("path"), "verdict",
    )
    single = named.groupBy("level", "path").agg(F.min("rule").alias("rule"), F.max("verdict").alias("verdict"))
    own = F.struct(F.char_length("rule").alias("size"), "rule", "verdict")
    start = single.select("level", _key(F.col("level"), F.col("path")).alias("key"), own.alias("own"), F.lit(1).alias("move"))
    end = start.select("level", F.concat("key", F.lit(b"\xff")).alias("key"), "own", F.lit(-1).alias("move"))
    by_host = Window.partitionBy("level").orderBy("key")
    depth = F.sum("move").over(by_host.rowsBetween(Window.unboundedPreceding, 0))
    # a start opens its own depth; an end falls back to the opener of the depth it returns to
    moves = start.unionAll(end).withColumn("depth", depth)
    at_depth = Window.partitionBy("level", "depth").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("move") == 1, F.col("own")), ignorenulls=True).over(at_depth)
    return moves.select("level", "key", top.alias("top"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A rule fits its host and every subdomain if the path starts with the rule's path. The rule with most
    characters in host and path wins, then the one on the deeper host. No rule: null and ``default``. Null urls and
    urls without ``://`` have empty host and path and fit no rule. Repeated pages are judged one by one.
    Other columns are not read. With no rules every page gets the default. Hosts may have any number of labels.
    """
    url = F.col(url_col)
    base = materialize(
        pages.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
            host_of(url).alias("host"), path_of(url).alias("path"),
        )
    )
    steps = materialize(stack_steps(rules))
    # no rule fits a level deeper than the deepest rule, so a host of any length has no more prefixes than that
    deepest = steps.agg(F.max(F.size(F.split("level", r"\.", -1)))).first()[0] or 0
    top_labels = F.slice(_turned(F.col("host")), 1, deepest)
    hosts = base.where("host <> ''").select("row", "path", top_labels.alias("labels")).where(F.size("labels") > 0)
    chain = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.concat_ws(".", F.slice("labels", F.lit(1), i)))
    levels = hosts.select("row", "path", F.explode(chain).alias("level"))
    # levels without any rule cannot be inside an interval
    wanted = levels.join(steps.select("level").distinct(), "level", "left_semi")
    points = wanted.select(
        _key(F.col("level"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "row", F.lit(None).alias("step")
    )
    marks = steps.select("key", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("row"), F.struct("top").alias("step"))
    laid = lay_out(marks.unionByName(points), ["key", "kind", "row"])

    ends = laid.where("kind = 0").groupBy("_seg").agg(F.max_by("step", "_off").alias("step"))
    segments = laid.select("_seg").distinct().join(ends, "_seg", "left")
    before = Window.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition, so window and broadcast are bounded by the partition count
    carry = segments.select("_seg", F.last("step", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("_seg").orderBy("_off").rowsBetween(Window.unboundedPreceding, 0)
    swept = laid.withColumn("seen", F.last("step", ignorenulls=True).over(inside)).where("kind = 1")
    tops = swept.join(F.broadcast(carry), "_seg", "left").select(
        "row", F.coalesce("seen", "carried")["top"].alias("top"), F.octet_length("key").alias("depth")
    )
    best = F.max(F.struct(F.col("top.size"), F.col("depth"), F.col("top.rule"), F.col("top.verdict"))).alias("best")
    chosen = tops.where("top IS NOT NULL").groupBy("row").agg(best)
    return base.join(chosen, "row", "left").select(
        F.col("id").alias(id_col), "host", "path",
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
