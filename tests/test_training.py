"""Training tables on a small window table."""

import pytest
from pyspark.sql import functions as F

from windowlark.functions import vector as V
from windowlark.operators import labels
from windowlark.plans import reports, training
from windowlark.plans.training import Augment

pytestmark = pytest.mark.usefixtures("many_parts")


@pytest.fixture(scope="module")
def windows(spark):
    """Four recordings x three channels x 30 s; a vector entry is unique to its window."""
    rows = []
    for stem in range(4):
        for c, channel in enumerate(("original", "source0", "source1")):
            for t in range(30):
                own = f"s{stem % 2}"
                called = own if (t + c) % 3 == 0 else ("no_call" if (t + c) % 3 == 1 else "s7")
                prob = ((stem * 31 + c * 17 + t * 7) % 100) / 100
                e = [float(stem), float(c), float(t), 1.0]
                rows.append((f"XC{stem}", channel, t, own, called, prob, e, e))
    ddl = "stem string, track_type string, start_time bigint, species string, prediction string, probability double, embedding array<double>, prediction_vec array<double>"
    return spark.createDataFrame(rows, ddl).withColumn("wid", F.xxhash64("stem", "track_type", "start_time")).cache()


@pytest.fixture(scope="module")
def meta(spark):
    rows = [(f"a/XC{i}.ogg", f"s{i % 2}", "['s7']" if i < 2 else "[]") for i in range(4)]
    return training.track_labels(spark.createDataFrame(rows, "filename string, primary_label string, secondary_labels string"))


def test_v2(windows, meta):
    rows = training.training_v2(windows, meta).orderBy("stem", "start_time").collect()
    assert {r.start_time for r in rows} <= {0, 10, 20}
    for r in rows:
        assert r.predicted_species_prob == sorted(r.predicted_species_prob, reverse=True)
        assert all(p > 0.5 for p in r.predicted_species_prob) and "no_call" not in r.predicted_species
        assert r.embedding[2] == r.start_time
        assert r.next_embedding[2] == min(r.start_time + 10, 20)
        assert r.track_embedding[2] == 10.0


def test_v3_adds_blends(windows, meta):
    base = training.training_v2(windows, meta)
    how = Augment(per_class=3, noise_rows=4, keep=5, weight=0.75)
    out = training.training_v3(windows, meta, ["stem", "wid"], how)
    extra = out.count() - base.count()
    classes = base.select(F.get("metadata_species", F.lit(0))).distinct().count()
    assert 0 < extra <= 5 * classes
    # a halved blend of two vectors whose last entry is 1
    assert {round(r.x, 6) for r in out.select(F.get("embedding", F.lit(3)).alias("x")).distinct().collect()} == {0.5, 1.0}


def test_augmentation_is_repeatable(windows, meta):
    how = Augment(per_class=3, noise_rows=4, keep=5)
    a = sorted(map(str, training.training_v3(windows, meta, ["stem", "wid"], how).collect()))
    b = sorted(map(str, training.training_v3(windows.repartition(5), meta, ["stem", "wid"], how).collect()))
    assert a == b


def test_v5_labels(windows, meta):
    out = training.training_v5(windows, meta, ["stem", "wid"], Augment(per_class=2, noise_rows=2, keep=2, weight=0.9))
    for r in out.collect():
        assert "no_call" not in r.predicted_species
        assert set(r.predicted_species) <= {"s0", "s1", "s7"}
    # s0 and s1 occur with s7 in the metadata of XC0 and XC1
    assert out.where(F.array_contains("predicted_species", "s7")).count() > 0


def test_v6_and_v7(windows, meta):
    v6 = training.training_v6(windows, meta).cache()
    assert v6.groupBy("stem").agg(F.count_distinct("track_type").alias("n")).where("n <> 2").count() == 0
    assert v6.where(F.size("embedding") != 8).count() == 0
    base = training.training_v7_base(windows, meta)
    out = training.training_v7(base)
    # two channels a recording, one of them labelled: every second is labelled once, for both
    per = out.groupBy("stem", "start_time").agg(F.count("*").alias("n"), F.count_distinct("species").alias("s"))
    assert {(r.n, r.s) for r in per.collect()} == {(2, 1)}
    assert out.count() == base.count()
    again = training.relabel_v6(v6)
    assert again.count() == v6.count() and again.agg(F.min("species_count")).first()[0] > 1


def test_v1_parts(windows, meta):
    out = training.training_v1(windows, meta, "prediction_vec", [0, 1, 2, 3], [1, 2], ["wid"], singles=5, pairs=4, triples=3).cache()
    sets = {tuple(sorted(r.species)): r["count"] for r in out.groupBy("species").count().collect()}
    assert ("s0",) in sets and ("no_call",) in sets
    assert sets[("no_call",)] == 4 * 250
    # averages of recordings with several labels
    assert any(len(k) == 2 and "s7" in k for k in sets)
    assert out.where(F.size("embedding") != 4).count() == 0


def test_binary(windows):
    noise = labels.noise_negatives(windows, "prediction_vec", [2], ["wid", "embedding"], threshold=0.9999)
    background = windows.where("stem = 'XC0'").limit(7)
    out = training.build_binary(windows, noise, background, ["wid"], min_count=100, fraction=0.5)
    n = {r.species: r["count"] for r in out.groupBy("species").count().collect()}
    assert n["call"] == windows.where("probability > 0.5").count()
    low = windows.where("probability < 0.1").count()
    assert noise.count() + 7 < n["no_call"] < noise.count() + 7 + low


def test_adaptive_threshold(spark):
    df = spark.createDataFrame([("common", i / 10) for i in range(10)] + [("rare", 0.06), ("rare", 0.04)], "k string, p double")
    kept = labels.adaptive_threshold(df, "k", "p", min_count=10)
    assert sorted((r.k, r.p) for r in kept.collect()) == [("common", x / 10) for x in range(5, 10)] + [("rare", 0.06)]


def test_loudest_channel_keeps_ties(spark):
    df = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 5.0), ("a", "z", 1.0), ("b", "x", 2.0)], "stem string, c string, e double")
    assert sorted(tuple(r) for r in labels.loudest_channel(df, "stem", "c", "e").collect()) == [("a", "x"), ("a", "y"), ("b", "x")]


def test_negatives_use_probability(windows):
    top = labels.noise_negatives(windows, "prediction_vec", [2], ["wid"], n=5).collect()
    assert len(top) == 5 and {r.species for r in top} == {"no_call"}
    assert all(r.probability > 0.99 for r in top)
    assert windows.select(V.sigmoid(F.lit(0.0))).first()[0] == 0.5


def test_neighbor_table(windows):
    emb = windows.select("wid", "embedding")
    meta = windows.select("stem", "species").distinct()
    table = reports.build_neighbor_table(
        windows.select("wid", "stem", "track_type", "start_time"), emb, meta, ["wid"], "stem",
        ["stem", "track_type", "start_time"], "embedding", k=4,
    )
    rows = table.collect()
    assert sorted(r.id for r in rows) == list(range(1, 361))
    assert all(len(r.neighbors) == 4 and r.neighbors[0] == r.id for r in rows)
