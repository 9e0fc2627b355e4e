"""Order-based operators on skewed input against plain windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from windowlark.operators import joins, ordered, sampling, windows
from windowlark.operators.aggregates import histogram, lump_top_n, reduce_frames, summarize

pytestmark = pytest.mark.usefixtures("many_parts")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some keys are null."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 17)
    return spark.range(3000, numPartitions=6).select(
        F.col("id"), key.alias("k"), F.pmod(F.col("id") * 7919, F.lit(101)).alias("v"), F.col("id").alias("t")
    )


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_row_id_is_dense(skewed):
    plain = skewed.withColumn("rn", F.row_number().over(Window.orderBy("v", "id")).cast("bigint"))
    named = ordered.assign_row_id(skewed, ["v", "id"], "place")
    assert rows(named, "id", "place") == rows(plain.withColumnRenamed("rn", "place"), "id", "place")


def test_group_position(skewed):
    got = ordered.group_position(skewed, ["k"], [F.desc("v"), F.asc("id")])
    want = skewed.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "id")).cast("bigint"))
    assert rows(got, "id", "pos") == rows(want, "id", "pos")


def test_running_totals(skewed):
    got = ordered.running_totals(skewed, ["k"], ["v", "id"], {"total": F.col("v")})
    w = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got, "id", "total") == rows(skewed.withColumn("total", F.sum("v").over(w)), "id", "total")


@pytest.mark.parametrize("width", [7, 500, 65536])
def test_lead_or_self(skewed, width):
    got = windows.lead_or_self(skewed, ["k"], "t", "v", "nxt", width=width)
    want = skewed.withColumn("nxt", F.coalesce(F.lead("v").over(Window.partitionBy("k").orderBy("t")), "v"))
    assert rows(got, "id", "nxt") == rows(want, "id", "nxt")


@pytest.mark.parametrize("width", [5, 1000])
def test_moving_avg(skewed, width):
    got = windows.moving_avg(skewed, ["k"], ["t"], "v", 3, "m", width=width)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(-2, 0)
    want = skewed.withColumn("m", F.when(F.count("v").over(w) == 3, F.avg("v").over(w)))
    assert rows(got, "id", "m") == rows(want, "id", "m")


@pytest.mark.parametrize("k", [3, 1200])
def test_top_per_group(skewed, k):
    got = windows.top_per_group(skewed, ["k"], [F.desc("v"), F.asc("id")], k)
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "id"))
    assert rows(got, "id") == rows(skewed.withColumn("p", place).where(F.col("p") <= k), "id")


def test_ties_and_totals(skewed):
    best = windows.best_with_ties(skewed, ["k"], "v")
    place = F.rank().over(Window.partitionBy("k").orderBy(F.desc("v")))
    assert rows(best, "id") == rows(skewed.withColumn("p", place).where("p = 1"), "id")
    sized = windows.with_group_size(skewed, ["k"])
    assert rows(sized, "id", "group_size") == rows(skewed.withColumn("group_size", F.count("*").over(Window.partitionBy("k"))), "id", "group_size")


def test_reduce_frames(skewed):
    got = reduce_frames(skewed, ["k"], ["t"], 2, F.max("v"), "peak")
    rn = F.row_number().over(Window.partitionBy("k").orderBy("t"))
    want = skewed.withColumn("frame", F.floor((rn - 1) / 2)).groupBy("k", "frame").agg(F.max("v").alias("peak"))
    assert rows(got, "k", "frame", "peak") == rows(want, "k", "frame", "peak")


def test_splits_cover_everything(skewed):
    parts = sampling.split(skewed, ["id"], [0.8, 0.1, 0.1], seed=1)
    counts = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sum(counts.values()) == 3000 and set(counts) == {0, 1, 2} and 2250 < counts[0] < 2550
    strat = sampling.split_stratified(skewed, "k", 0.67, ["id"], seed=1)
    for r in strat.groupBy("k").agg(F.count("*").alias("n"), F.count_if("is_train").alias("t")).collect():
        assert r.t == int(0.67 * r.n)
    pos = sampling.split_positional(skewed, ["t"], 0.7)
    assert pos.count() == 3000
    assert pos.where("is_train").agg(F.max("t")).first()[0] == 2099
    assert pos.where("not is_train").agg(F.min("t")).first()[0] == 2100


def test_sampling_is_repeatable(skewed):
    a = windows.sample_per_group(skewed, ["k"], ["id"], 5, seed=3)
    b = windows.sample_per_group(skewed.repartition(3), ["k"], ["id"], 5, seed=3)
    c = windows.sample_per_group(skewed, ["k"], ["id"], 5, seed=4)
    assert rows(a, "id") == rows(b, "id") != rows(c, "id")
    share = sampling.sample_strata(skewed, ["id"], 0.6, seed=9).count() / 3000
    assert 0.55 < share < 0.65
    assert sorted(r.id for r in sampling.shuffle_rows(skewed, ["id"], 1).collect()) == list(range(3000))
    assert [r.id for r in sampling.shuffle_rows(skewed, ["id"], 1).take(20)] != list(range(20))


def test_monotonic_id_is_unique(skewed):
    ids = skewed.withColumn("uid", F.monotonically_increasing_id())
    assert ids.select("uid").distinct().count() == 3000


def test_random_partner_and_slots(skewed):
    other = ordered.assign_row_id(skewed.select(F.col("id").alias("other")), ["other"], "index", start=0).where("index < 1500")
    drawn = joins.random_partner(skewed.select("id"), other, ["id"], 3000, seed=2)
    again = joins.random_partner(skewed.select("id").repartition(5), other, ["id"], 3000, seed=2)
    # every row draws once; half of the indices have no partner
    assert drawn.select("id").distinct().count() == drawn.count() and 1350 < drawn.count() < 1650
    assert rows(drawn, "id", "other") == rows(again, "id", "other")
    whole = ordered.assign_row_id(skewed.select(F.col("id").alias("other")), ["other"], "index", start=0)
    # over the true size of the table nobody is lost
    assert joins.random_partner(skewed.select("id"), whole, ["id"], seed=3).count() == 3000
    few = skewed.select(F.col("v").alias("w"), F.col("id").alias("j"))
    pairs = joins.pair_with_slots(skewed.select("id"), few, 4, ["w", "j"])
    best = [(r.w, r.j) for r in few.orderBy("w", "j").limit(4).collect()]
    assert pairs.count() == 12000 and {(r.w, r.j) for r in pairs.select("w", "j").distinct().collect()} == set(best)
    short = joins.pair_with_slots(skewed.select("id"), few.limit(2), 4, ["w", "j"])
    assert short.count() == 6000


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 10, None] if x is not None], "x double")
    got = {r.bin: r.n for r in histogram(df, F.col("x"), 5).collect()}
    assert got == {0: 2, 1: 1, 4: 1}
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [tuple(r) for r in histogram(same, F.col("x"), 5).collect()] == [(0, 2)]


def test_lump_and_summary(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",), ("d",)], "x string")
    assert {(r.lump, r["count"]) for r in lump_top_n(df, "x", 2).groupBy("lump").count().collect()} == {("a", 5), ("b", 3), ("other", 2)}
    s = summarize(spark.createDataFrame([(float(i),) for i in range(1, 6)], "x double"), "x").first()
    assert (s.n, s.mean, s.min, s.p25, s.p50, s.p75, s.max) == (5, 3.0, 1.0, 2.0, 3.0, 4.0, 5.0)


def test_segments_are_many(skewed):
    laid = ordered.lay_out(skewed, ["k", "v", "id"])
    sizes = [r["count"] for r in laid.groupBy("_seg").count().collect()]
    assert len(sizes) > 3 and max(sizes) < 1500
