"""Nearest neighbours and the pipeline against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windowlark.llm import projected_search


def brute(rows, k):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8})
    out = []
    for i, v in good:
        if i % 100 == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), j) for j, w in good if j != i)[:k]
            out += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
    return out


@pytest.mark.parametrize("block", [8192, 40])
def test_search(spark, monkeypatch, block):
    """Odd vectors, ties, a hot vector and many small cells; with a certain stop the search is exact."""
    monkeypatch.setattr(projected_search, "BLOCK_ROWS", block)
    monkeypatch.setattr(projected_search, "VISIT_ROWS", 3)
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-9, 9)) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, [1.0] * 8) for i in range(400)]
    rows += [(2000, None), (2100, []), (2200, [0.0] * 8), (2300, [None] + [1.0] * 7), (2400, [float("nan")] * 8), (2500, [float("inf")] * 8), (2600, [1.0, 2.0]), (None, [1.0] * 8), (700, [5.0] * 8), (700, [5.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = [tuple(r) for r in projected_search.nearest(df, F.col("vec_id") % 100 == 0, confidence=1 - 1e-12).collect()]
    want = brute(rows, 10)
    assert [x[:3] for x in sorted(got)] == [x[:3] for x in sorted(want)]
    assert np.allclose([x[3] for x in sorted(got)], [x[3] for x in sorted(want)], rtol=1e-12)


def test_search_few_or_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 2.0]), (200, [2.0, 2.0])], "vec_id long, embedding array<float>")
    got = projected_search.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 1.0), (0, 2, 200, 1.0), (200, 1, 1, 0.0), (200, 2, 0, 1.0)]
    assert projected_search.nearest(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert projected_search.nearest(df, F.lit(False)).count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in projected_search.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = df.select("vec_id", "embedding").toPandas()
    v, ids = np.stack(rows["embedding"].to_list()).astype(float), rows["vec_id"].to_numpy()
    hit = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((v - v[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hit, total = hit + len(best & got[int(ids[i])]), total + 10
    assert hit / total >= 0.95


def test_chi2_quantile():
    assert projected_search.chi2_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


# --- pipeline


def test_stages(spark):
    import corpus_pipeline as cp

    rng = random.Random(5)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    foot = "this footer stands below every single document of the site"
    rows = [(i, f"the and of {fresh(60)}\n{foot}", "en", "xyz"[i % 3]) for i in range(30)]
    copied = rows[3][1].replace("the and of", "of the and")
    rows += [(100, copied, "en", "x"), (101, rows[4][1], "en", None), (102, "12 34", "en", "x"), (103, None, None, "x"), (104, "", "fr", "y"), (105, foot, "en", "y")]
    rows += [(200 + i, f"der die und {fresh(60)}", "de", "x") for i in range(12)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen, columns = [], docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, "unused")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append([r.doc_id for r in docs.collect()])
        assert docs.columns == columns or k == len(cp.STAGES) - 1
        if k == 1:
            text = {r.doc_id: r.text for r in docs.collect()}
            assert foot in text[0] and all(foot not in t for i, t in text.items() if 0 < i < 100)
    clean = set(range(30)) | set(range(200, 212))
    assert clean <= set(seen[0]) and not {102, 103, 104} & set(seen[0])
    assert clean <= set(seen[1]) and 105 not in seen[1]
    assert clean <= set(seen[2]) and not {100, 101} & set(seen[2])
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].count(i) for i in seen[3]) <= 3
    assert sorted(seen[4]) == sorted(seen[3]) and docs.where("NOT round_trip").count() == 0


def test_texts_unlike_every_language_go(spark):
    """Other scripts, unlearned languages and noise go; labelled rows, held out or not, stay."""
    import base64

    import corpus_pipeline as cp

    rng = random.Random(6)
    odd = [
        "съешь же ещё этих мягких французских булок да выпей чаю " * 5,
        "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        base64.b64encode(rng.randbytes(600)).decode(),
        " ".join(f"{rng.getrandbits(32):08x}" for _ in range(40)),
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1 - i, t, None, "x", len(t)) for i, t in enumerate(odd)], docs.schema)
    held = docs.where("doc_id % 3 = 1").withColumn("lang", F.lit(None).cast("string"))
    given = docs.where("doc_id % 3 <> 1").unionAll(held).unionAll(extra)
    ids = {r.doc_id for r in cp.keep_known_language(spark, given, "unused").select("doc_id").collect()}
    assert not ids & {-1 - i for i in range(len(odd))}
    lettered = docs.where("text RLIKE '[A-Za-z]'")
    for part in (lettered, lettered.where("doc_id % 3 = 1")):
        assert part.where(F.col("doc_id").isin(sorted(ids))).count() >= 0.995 * part.count()


def test_run_on_tables(spark):
    import corpus_pipeline as cp

    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.where("NOT round_trip OR n_tokens IS NULL").count() == 0
