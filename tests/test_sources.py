"""Readers, writers and incremental ingestion."""

import json
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from windowlark.sources import media, readers, writers
from windowlark.streaming.incremental import ingest_new


def test_glob_depth(spark, tmp_path):
    for sub, n in (("a/x", 3), ("a/y", 4), ("b/z", 5)):
        spark.range(n).write.parquet(str(tmp_path / "deep" / sub))
    assert readers.read_glob(spark, f"{tmp_path}/deep/*/*/*.parquet").count() == 12
    assert readers.read_glob(spark, f"{tmp_path}/deep/*/*").count() == 12
    spark.range(7).write.parquet(str(tmp_path / "deep/c/p/q"))
    assert readers.read_glob(spark, f"{tmp_path}/deep", any_depth=True).count() == 19


def test_csv_header(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("filename,primary_label,secondary_labels\na/XC1.ogg,s1,\"['s2', 's3']\"\n")
    df = readers.read_csv(spark, str(tmp_path / "meta.csv"))
    assert {t for _, t in df.dtypes} == {"string"}
    from windowlark.functions.text import parse_list

    assert df.select(parse_list("secondary_labels")).first()[0] == ["s2", "s3"]


def test_tsv_ddl_and_build_embeddings(spark, tmp_path):
    for bird, stem in (("zed", "XC2"), ("abe", "XC1")):
        (tmp_path / "emb" / bird).mkdir(parents=True)
        text = "3.0\t6.0\t0.5,1.5\n0.0\t3.0\t1.0,2.0\n"
        (tmp_path / "emb" / bird / f"{stem}.tool.embeddings.txt").write_text(text)
    raw = readers.read_tsv(spark, f"{tmp_path}/emb/*/*.txt", "start_sec FLOAT, end_sec FLOAT, emb_text STRING")
    assert raw.count() == 4 and raw.schema["start_sec"].dataType.simpleString() == "float"
    rows = readers.build_embeddings(spark, f"{tmp_path}/emb/*/*.txt").collect()
    assert [(r.filename, r.start_sec) for r in rows] == [
        ("abe/XC1.ogg", 0.0), ("abe/XC1.ogg", 3.0), ("zed/XC2.ogg", 0.0), ("zed/XC2.ogg", 3.0),
    ]
    assert rows[0].emb == [1.0, 2.0]


def test_build_intervals(spark, tmp_path):
    head = "Start (s),End (s),Scientific name,Common name,Confidence\n"
    for bird in ("abe", "zed"):
        (tmp_path / bird).mkdir()
        (tmp_path / bird / "XC7.tool.csv").write_text(head + "0.0,3.0,X y,Robin,0.9\n3.0,6.0,X z,Ghost,0.4\n")
    taxonomy = spark.createDataFrame([("Robin", "rob1")], "PRIMARY_COM_NAME string, SPECIES_CODE string")
    out = readers.build_intervals(spark, f"{tmp_path}/*/*.csv", taxonomy)
    assert out.columns == ["start_sec", "end_sec", "confidence", "label", "common_name", "filename"]
    got = {(r.filename, r.common_name, r.label, r.confidence) for r in out.collect()}
    assert got == {
        ("abe/XC7.ogg", "Robin", "rob1", 0.9), ("abe/XC7.ogg", "Ghost", "unknown", 0.4),
        ("zed/XC7.ogg", "Robin", "rob1", 0.9), ("zed/XC7.ogg", "Ghost", "unknown", 0.4),
    }


def test_path_columns(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "some bird" / "XC9.part"))
    row = readers.with_path_columns(spark.read.parquet(f"{tmp_path}/some bird/XC9.part")).first()
    assert row["parent"] == "XC9.part" and row["filename"].startswith("XC9.part/part-")


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": "x", "n": 1}, {"k": "y", "n": 2}]))
    df = readers.read_records(spark, str(tmp_path / "a.json"), "k string, n bigint")
    assert sorted(tuple(r) for r in df.collect()) == [("x", 1), ("y", 2)]
    writers.write_records(df, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.json"))) == 1
    assert readers.read_records(spark, str(tmp_path / "out"), lines=True).count() == 2


def test_from_rows(spark):
    ddl = "track string, start_time bigint, emb array<double>"
    a = readers.from_rows(spark, [("t", 1, [1.0, 2.0])], ddl)
    b = readers.from_rows(spark, [{"track": "t", "start_time": 1, "emb": [1.0, 2.0]}], ddl)
    c = readers.from_rows(spark, pd.DataFrame({"track": ["t"], "start_time": [1], "emb": [[1.0, 2.0]]}), ddl)
    assert a.collect() == b.collect() == c.collect()
    assert a.schema == c.schema


def test_class_dictionary(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("B_Bee\nA_Ant\nC_Cat\n", encoding="utf-8")
    (tmp_path / "codes.json").write_text(json.dumps({"A_Ant": "ant", "B_Bee": "bee", "C_Cat": "cat"}))
    df = readers.read_class_dictionary(spark, str(tmp_path / "labels.txt"), str(tmp_path / "codes.json"))
    assert [tuple(r) for r in df.orderBy("index").collect()] == [(0, "B_Bee", "bee"), (1, "A_Ant", "ant"), (2, "C_Cat", "cat")]
    (tmp_path / "codes.json").write_text(json.dumps({"A_Ant": "ant"}))
    with pytest.raises(Exception, match="no code for label"):
        readers.read_class_dictionary(spark, str(tmp_path / "labels.txt"), str(tmp_path / "codes.json")).collect()


def _wav(path, seconds, rate=32000):
    data = b"\0\0" * int(seconds * rate)
    head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(head + b"data" + struct.pack("<I", len(data)) + data)


def test_wav_inventory(spark, tmp_path):
    for species in ("foo", "bar", "baz"):
        for name in ("0.wav", "1.wav"):
            _wav(tmp_path / species / name, 15 if name == "0.wav" else 0.5)
    inventory = media.media_inventory(spark, f"{tmp_path}/*/*.wav")
    rows = inventory.collect()
    assert len(rows) == 6 and {r.duration for r in rows} == {15.0, 0.5}
    total = media.inventory_summary(inventory).first()
    assert (total.n, total.n_durations, total.total_sec) == (6, 2, 46.5)
    with pytest.raises(Exception):
        media.media_inventory(spark, f"{tmp_path}/none/*.wav").collect()


def test_compact_roundtrip(spark, tmp_path):
    for i in range(6):
        spark.range(i * 10, i * 10 + 10).withColumn("track", F.lit(i)).write.parquet(str(tmp_path / "in" / f"t{i}"))
    small = readers.read_glob(spark, f"{tmp_path}/in/*/*.parquet")
    writers.write_table(small, str(tmp_path / "out"), partitions=2, compression="zstd")
    files = list((tmp_path / "out").glob("*.parquet"))
    assert len(files) == 2 and all("zstd" in f.name for f in files)
    back = readers.read_table(spark, str(tmp_path / "out"), ["track"])
    assert back.count() == 60 and back.distinct().count() == 6
    writers.write_table(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_single_file(spark, tmp_path):
    writers.write_single(spark.range(100, numPartitions=5), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1


def test_csv_sink(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([("a", 0.5)], "point string, score double"), str(tmp_path / "csv"))
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "csv")).collect()] == [("a", "0.5")]


def test_uri_passthrough(spark, tmp_path):
    spark.range(4).write.parquet((tmp_path / "u").as_uri())
    assert readers.read_table(spark, (tmp_path / "u").as_uri()).count() == 4


def test_success_marker(spark, tmp_path):
    spark.range(3, numPartitions=3).write.parquet(str(tmp_path / "m"))
    assert {p.name for p in (tmp_path / "m").glob("_*")} == {"_SUCCESS"}


def test_batches(spark):
    df = spark.range(25)
    sizes = writers.assign_batches(df, 10, ["id"]).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [10, 10, 5]
    assert writers.assign_batches(df, 0, ["id"]).select("batch").distinct().collect()[0][0] == 0


def test_ingest_new(spark, tmp_path):
    source, target, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    spark.range(10).write.mode("append").parquet(source)
    keep = lambda df: df.where("id % 2 = 0")
    schema = spark.range(1).schema
    assert ingest_new(spark, source, schema, target, mark, keep) == 10
    spark.range(10, 16).write.mode("append").parquet(source)
    assert ingest_new(spark, source, schema, target, mark, keep) == 6
    assert ingest_new(spark, source, schema, target, mark, keep) == 0
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(0, 16, 2))


def test_wav_with_extra_chunk(spark, tmp_path):
    _wav(tmp_path / "a" / "x.wav", 2)
    raw = (tmp_path / "a" / "x.wav").read_bytes()
    extra = b"LIST" + struct.pack("<I", 10) + b"INFOabcdef"
    (tmp_path / "a" / "y.wav").write_bytes(raw[:36] + extra + raw[36:])
    # chunk names inside a chunk, long chunks before the samples, odd sizes with a pad byte, and no WAV at all
    for i, body in enumerate([b"metadata fmt data", b"x" * 5000, b"y" * 1_000_001, b"data\0\0\0\1"]):
        chunk = b"LIST" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
        (tmp_path / "a" / f"z{i}.wav").write_bytes(raw[:36] + chunk + raw[36:])
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "n.wav").write_bytes(b"not a wav file at all")
    assert media.media_inventory(spark, f"{tmp_path}/b/*.wav").first().duration is None
    assert {r.duration for r in media.media_inventory(spark, f"{tmp_path}/a/*.wav").collect()} == {2.0}
