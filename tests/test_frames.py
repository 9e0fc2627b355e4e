"""Framing of series, with the counts of the original test cases."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windowlark.functions import vector as V
from windowlark.operators import frames as fr
from windowlark.operators.rows import align_frames, plan_segments


def series(spark, values):
    return spark.createDataFrame([(1, [float(v) for v in values])], "id int, x array<double>")


def test_slice_pads_the_last_window(spark):
    rows = fr.slice_windows(series(spark, [1] * 16), "x", 1, ["id"], seconds=5).orderBy("index").collect()
    assert len(rows) == 4
    assert rows[-1].window == [1, 0, 0, 0, 0] and rows[-1].start == 15 and rows[-1].ref_time == 15


def test_slice_with_step(spark):
    rows = fr.slice_windows(series(spark, range(16)), "x", 1, ["id"], seconds=4, step=2).orderBy("index").collect()
    assert len(rows) == 7
    assert [r.window[0] for r in rows] == [0, 2, 4, 6, 8, 10, 12]
    assert [r.ref_time for r in rows] == [0, 4, 8, 12, 16, 20, 24]


def test_slice_unit_windows(spark):
    assert fr.slice_windows(series(spark, range(10)), "x", 1, ["id"], seconds=1.0).count() == 10


def test_slice_short_series(spark):
    assert fr.slice_windows(series(spark, [1, 2]), "x", 1, ["id"], seconds=5, step=1).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 40), k=st.integers(1, 8), step=st.integers(1, 8))
def test_slice_count_formula(spark, n, k, step):
    padded = math.ceil(n / step) * step
    want = max(0, (padded - k) // step + 1)
    rows = fr.slice_windows(series(spark, range(1, n + 1)), "x", 1, ["id"], seconds=k, step=step).orderBy("index").collect()
    assert len(rows) == want
    full = list(range(1, n + 1)) + [0] * (padded - n)
    assert [r.window for r in rows] == [full[i * step : i * step + k] for i in range(want)]


@pytest.mark.parametrize(("duration", "hop"), [(10, 1), (10, 3), (7, 5)])
def test_sequences(spark, duration, hop):
    windows = spark.range(60).select(F.lit("a").alias("track"), F.col("id").alias("i"))
    runs = fr.build_sequences(windows, "i", F.lit(60), duration, hop)
    n = duration // hop
    sizes = [r["count"] for r in runs.groupBy("track", "seq_start").count().collect()]
    assert set(sizes) == {n}
    starts = sorted(r.seq_start for r in runs.select("seq_start").distinct().collect())
    assert starts == [s for s in range(0, 60, duration // 2) if s + n <= 60]
    assert fr.build_sequences(windows, "i", F.lit(duration - 1), duration, hop).count() == 0


def test_pad_center_noise(spark):
    rate = 10
    df = series(spark, [2.0 + (i % 5) for i in range(15 * rate)])
    padded = fr.pad_center_noise(df, "x", rate, "id", alpha=0).first()["padded"]
    assert len(padded) == 18 * rate
    assert padded[:15] == [0.0] * 15 and padded[15] == 2.0 and padded[-15:] == [0.0] * 15
    a = fr.pad_center_noise(df, "x", rate, "id", seed=1).first()["padded"]
    assert a == fr.pad_center_noise(df.repartition(3), "x", rate, "id", seed=1).first()["padded"]
    noise = [(y - 0.9 * p) / 0.1 for y, p in zip(a, padded, strict=True)]
    mean = sum(noise) / len(noise)
    std = math.sqrt(sum((v - mean) ** 2 for v in noise) / len(noise))
    assert abs(mean - 4) < 0.5 and abs(std - math.sqrt(2)) < 0.4


@pytest.mark.parametrize(("d", "longest", "part"), [(10, 3, 2.5), (10, 5, 5), (10, 10, 10), (10, 11, 10)])
def test_split_duration(spark, d, longest, part):
    df = spark.createDataFrame([(float(d),)], "d double")
    assert df.select(V.split_duration("d", longest)).first()[0] == part


def test_segment_plan(spark):
    df = spark.createDataFrame([("a/XC1", 400.0), ("a/XC2", 100.0)], "stem string, d double")
    rows = plan_segments(df, "stem", "d", 180.0).orderBy("stem", "part").collect()
    assert [r.part_name for r in rows] == [f"a/XC1_part{i:03d}.wav" for i in range(4)] + ["a/XC2_part000.wav"]
    assert rows[0].part_sec == 100.0 and rows[-1].part_sec == 100.0


def test_align_variants(spark):
    t = spark.range(20).select(F.col("id").alias("t"))
    assert [r.t for r in align_frames(t, "t").collect()] == [0, 3, 5, 8, 10, 13, 15, 18]
    assert [r.t for r in align_frames(t, "t", 10, (0,)).collect()] == [0, 10]


def test_frames_need_both_windows(spark):
    df = spark.createDataFrame([("a", 0, [1.0]), ("a", 3, [2.0]), ("a", 5, [9.0])], "stem string, t bigint, e array<double>")
    rows = fr.frame_vectors(df, ["stem"], "t", "e").collect()
    assert [(r.seq_id, r.start_time, r.embedding) for r in rows] == [(0, 0, [1.0, 2.0])]


def test_top_classes_up_to_k(spark):
    df = spark.createDataFrame([("a", [0.1, 0.9])], "stem string, e array<double>")
    assert {r["index"] for r in fr.frequent_top_classes(df, ["stem"], "e", 3).collect()} == {0, 1}
