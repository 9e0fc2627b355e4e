"""Archives, near duplicates, language, tokens and shards against brute force, with awkward inputs."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from windowlark.llm import bpe, language_svm, order_minhash, training_order, warc
from windowlark.llm.queries import QUERIES, VOCABULARY

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = bpe.read_ranks(VOCABULARY)
TIKTOKEN = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)


# --- archives


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARE_BYTES", 500)
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    big = "".join(chr(97 + i * i % 26) for i in range(3_000_000)) + "é"
    rows = [(5, "http://a/\r\nb", "one"), (2, None, "one"), (9, "u", big), (None, "u", "one"), (None, "v", "nobody"), (7, "u", None), (8, "u", "")]
    rows += [(5, "http://a/\r\nb", "one"), (20, "x", big)] + [(100 + i, "x", f"page {i}\r\n\r\nWARC/1.1\r\n") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1))
    manifest = warc.archive_pages(pages)
    assert manifest.count() > 10
    chunks = warc.read_archives(manifest).collect()
    last = [c for c in chunks if c.last]
    assert len(last) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    wanted = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = first.get(h or "") is not None and i != first[h or ""]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        wanted.append((i, len(body), digest, "revisit" if again else "response", first[h or ""] if again else None))
    found = [(c.page_id, c.payload_bytes, c.payload_digest, c.record_type, c.refers_to) for c in last]
    assert sorted(map(str, found)) == sorted(map(str, wanted))
    pieces = sorted((c.chunk_no, c.offset, bytes(c.data), c.payload_digest) for c in chunks if c.page_id == 9)
    assert len(pieces) == 3 and b"".join(p[2] for p in pieces) == big.encode()
    seen = hashlib.sha1()
    for _, offset, data, digest in pieces:  # each chunk carries the digest of all so far
        seen.update(data)
        assert base64.b32encode(seen.digest()).decode() == digest
    assert max(len(c.data) for c in chunks) <= warc.CHUNK


def test_warc_shares_are_read_in_parallel(spark, monkeypatch):
    """A task per share, though adaptive execution would merge so small a manifest; numbers do not follow a shuffle."""
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(md5(string(id)), 40) AS html")
    manifest = warc.archive_pages(pages)
    assert manifest.count() == 8
    read = warc.read_archives(manifest, payload=False)
    spread = read.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in spread) == 400 and len(spread) == 8
    first, second = (warc.chunk_rows(pages, "page_id", "url", "html").select("row", "page_id").collect() for _ in range(2))
    assert sorted(first) == sorted(second) and len({r.row for r in first}) == 400


def test_warc_without_broadcast_and_empty(spark, monkeypatch):
    monkeypatch.setattr(warc, "small_enough", lambda *a: False)
    pages = spark.createDataFrame([(i, "u", f"{i % 3}") for i in range(9)], "page_id long, url string, html string")
    got = warc.read_archives(warc.archive_pages(pages), payload=False).where("last")
    assert sorted((r.page_id, r.refers_to) for r in got.collect()) == [(i, i % 3 if i > 2 else None) for i in range(9)]
    assert warc.read_archives(warc.archive_pages(pages.where("false"))).count() == 0


# --- near duplicates


def test_alike_is_the_ordered_jaccard():
    rng = random.Random(1)
    with np.errstate(over="ignore"):
        for _ in range(300):
            a = [rng.randrange(30) for _ in range(rng.randrange(1, 60))]
            b = list(a)
            for _ in range(rng.randrange(0, 8)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randrange(2)] = [rng.randrange(30)] * rng.randrange(2)
            lcs = np.zeros((len(a) + 1, len(b) + 1), int)
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    lcs[i + 1, j + 1] = lcs[i, j] + 1 if x == y else max(lcs[i, j + 1], lcs[i + 1, j])
            whole = len(a) + len(b) - lcs[-1, -1]
            want = not whole or lcs[-1, -1] / whole >= 0.8
            assert order_minhash.alike(np.array(a, np.uint64), np.array(b, np.uint64)) == (want if a and b else len(a) == len(b))


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def test_near_duplicates_brute(spark, monkeypatch):
    """Chains, hot groups, shared passages, swapped halves and awkward texts; small buckets force every path."""
    monkeypatch.setattr(order_minhash, "CENTRES", 3)
    rng = random.Random(2)
    passage = words(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "Two  words"), (6, "two other"), (None, "two words")]
    base = words(rng, 200)
    for i in range(30):  # a hot group of near copies, each with two words changed
        copy = list(base)
        for at in rng.sample(range(200), 2):
            copy[at] = f"new{i}{at}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(300 + i, " ".join(words(rng, 20) + passage + words(rng, 20))) for i in range(16)]
    chain = words(rng, 300)
    for i in range(8):  # each link is near the one before only
        chain = chain[12:] + words(rng, 12)
        rows.append((400 + i, " ".join(chain)))
    rows += [(500, " ".join(base[100:] + base[:100])), (500, " ".join(base[100:] + base[:100])), (501, "x " * 4000), (502, "x " * 3900), (503, "x " * 300)]
    docs = docs_of(spark, [(i, t, "en") for i, t in rows]).withColumn("kept", F.lit("clash"))
    got = order_minhash.near_duplicates(docs).collect()
    plain = [order_minhash.normal(t) for _, t in rows]
    with np.errstate(over="ignore"):
        sh = [order_minhash.shingles(p) for p in plain]
        comp = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if plain[i] == plain[j] or (len(sh[i]) and len(sh[j]) and order_minhash.alike(sh[i], sh[j])):
                    a, b = comp[i], comp[j]
                    comp = [b if c == a else c for c in comp]
    want = []
    for i, (doc, _) in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i]]
        want.append((doc, min((g for g in group if g is not None), default=None), len(group)))
    assert sorted(map(str, [(r.doc_id, r.keep_id, r.group_size) for r in got])) == sorted(map(str, want))
    assert sum(r.kept for r in got) == len(set(comp))
    kept = order_minhash.drop_near_duplicates(docs)
    assert kept.count() == len(set(comp)) and kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for _, k, _ in want}


def test_large_buckets_meet_all_pairs(spark):
    """Near texts that agree in one sketch only are linked in a bucket of many unlinked members, as in a small one."""
    n = order_minhash.SKETCHES
    rng = random.Random(8)
    a = words(rng, 60)
    pair = {b"a": " ".join(a), b"b": " ".join([*a[:-1], "other"])}
    texts = pair | {f"x{i}".encode(): " ".join(words(rng, 60)) for i in range(3 * order_minhash.CENTRES)}
    # smallest members of the bucket first, so that its first class is none of the pair
    rows = [(k, 56, (False, 0 if k[:1] == b"x" else 1, i, i), [7] + [100 + i * n + j for j in range(n - 1)]) for i, (k, _) in enumerate(sorted(texts.items(), reverse=True))]
    classes = spark.createDataFrame(rows, "key binary, n long, ord struct<z: boolean, id: long, rk: long, row: long>, sk array<long>")
    labels = order_minhash.links(classes, spark.createDataFrame(list(texts.items()), "key binary, text string"), 0.8)
    assert labels is not None and {bytes(r.node) for r in labels.collect()} == set(pair)


def test_cuts_do_not_multiply_rows(spark, monkeypatch):
    """A member of large buckets is in one part of each, so no table has more rows than its buckets and their parts."""
    n, members = order_minhash.SKETCHES, 2 * order_minhash.CENTRES
    rng = random.Random(9)
    texts = {f"x{i}".encode(): " ".join(words(rng, 30)) for i in range(members)}
    rows = [(k, 26, (False, i, i, i), [100 + j for j in range(n)]) for i, k in enumerate(texts)]
    classes = spark.createDataFrame(rows, "key binary, n long, ord struct<z: boolean, id: long, rk: long, row: long>, sk array<long>")
    made, write = [], order_minhash.materialize
    monkeypatch.setattr(order_minhash, "materialize", lambda df: made.append(write(df)) or made[-1])
    sizes = []
    monkeypatch.setattr(order_minhash, "discard", lambda *tables: sizes.extend(t.count() for t in tables))
    assert order_minhash.links(classes, spark.createDataFrame(list(texts.items()), "key binary, text string"), 0.8) is None
    assert sizes and max(t.count() for t in made) <= 2 * members * n


def test_no_near_duplicates(spark):
    docs = docs_of(spark, [(1, "a b c d e f", "en"), (2, "g h i j k l m", "en")])
    assert [r.kept for r in order_minhash.near_duplicates(docs).collect()] == [True, True]
    assert order_minhash.near_duplicates(docs.where("false")).count() == 0


# --- language


def test_language_held_out(spark):
    got = QUERIES["op3_language_svm"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    share = got.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share >= 0.98
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and got.count() == truth.count()


def test_language_edges(spark):
    rows = [(i, f"the cat and the dog {i}", "en") for i in range(20)] + [(40 + i, f"der hund und die katze {i}", "de") for i in range(20)]
    rows += [(90 + i, f"le chat et la souris {i}", "fr") for i in range(20)] + [(150, "quien sabe", None)]
    model = language_svm.fit_languages(docs_of(spark, rows), rows=15)
    odd = [(1, None, "en"), (2, "", "en"), (3, "123 $$$ \n", "fr"), (None, "der hund", None), (5, "le chat " * 400_000, None), (6, "the", None), (6, "the", None), (7, "日本", None)]
    docs = docs_of(spark, odd).withColumn("score", F.lit("clash"))
    got = {(r.doc_id, r.lang_pred): r.score for r in language_svm.predict_languages(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "de"), (5, "fr"), (6, "en")} <= set(got)
    assert got[1, "und"] == 0.0 and all(0 <= s <= 1 for s in got.values()) and len(got) == 7
    same = [model.predict([t])[0][0] for _, t, _ in odd]
    assert same == model.predict([t for _, t, _ in odd])[0]  # no text influences another


def test_fit_sample_is_bounded_by_id_hash(spark, monkeypatch):
    """Of a language with more than eight times the rows wanted, features are made of those alone, by hash of the id."""
    made = []
    keep = language_svm.materialize
    monkeypatch.setattr(language_svm, "materialize", lambda df: made.append(keep(df)) or made[-1])
    docs = docs_of(spark, [(i, f"word{'abcdefghij'[i % 10]} " * (i % 7 + 1), "en") for i in range(2000)])
    language_svm.fit_languages(docs, rows=20)
    hashed = docs.select(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 1).alias("h"))
    want = [r.h for r in hashed.orderBy("h").limit(20).collect()]
    assert sorted(r.h for r in made[0].select("h").collect()) == want


def test_language_without_labels(spark):
    docs = docs_of(spark, [(1, "hello there", None)])
    model = language_svm.fit_languages(docs)
    assert [tuple(r) for r in language_svm.predict_languages(docs.select("doc_id", "text"), model).drop("text").collect()] == [(1, "und", 0.0)]
    only = language_svm.fit_languages(docs_of(spark, [(1, "hello there", "en")]))
    assert only.predict(["what"]) == (["en"], [1.0])


# --- tokens

TEXTS = [
    None, "", " ", "  ", "a   b", "it's  a\n \nb \t c", "x\u3000 y", "\ud7ff 's'S 123abc  \r\n  ", "<|endoftext|>", "é" * 50, "日本語 テキスト", "\U0001f600\u200d\U0001f600",
    "word " * 20000, "nospace" * 3000, "\x00\x01", "a\u00a0 b", " lead", "trail ", "Öäü ß", "\n\n\n", "we'll've'd",
]


def test_bpe_matches_tiktoken(spark):
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "again", "en"), (None, "again", "en")]).repartition(3)
    ids = bpe.bpe_encode(docs, "text", RANKS, public_tokenizers.PATTERN)
    got = bpe.bpe_decode(ids, "ids", RANKS).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert r.ids == TIKTOKEN.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.bpe_encode(docs.where("false"), "text", RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.bpe_encode(docs, "text", RANKS, public_tokenizers.PATTERN, name="lang")


def test_short_merges_are_the_same():
    rng = random.Random(4)
    for _ in range(3000):
        piece = bytes(rng.choice(b" thenaio\xc3\xa9") for _ in range(rng.randrange(1, 20)))
        assert bpe.merge_short(piece, RANKS) == bpe.merge_bytes(piece, RANKS)


def test_batches_handed_on_are_bounded(spark, monkeypatch):
    """Rows of one Arrow batch are handed on in shares, so that a worker never holds all their decoded texts."""
    monkeypatch.setattr(bpe, "BATCH_BYTES", 1000)
    seen = []
    monkeypatch.setattr(bpe, "_with_column", lambda batch, *rest: seen.append(batch.num_rows))
    ids = pa.RecordBatch.from_arrays([pa.array([TIKTOKEN.encode_ordinary("word " * 40)] * 50, pa.list_(pa.int32()))], ["ids"])
    runs = []
    df = spark.sql("SELECT array(1) AS ids")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run))
    bpe.bpe_decode(df, "ids", RANKS)
    list(runs[0](iter([ids])))
    assert sum(seen) == 50 and max(seen) == 5


def test_perfect_hash_is_minimal():
    table = bpe.PerfectHash(RANKS)
    assert all(table.get(k) == v for k, v in RANKS.items())
    assert sorted(table.rank) == sorted(RANKS.values()) and len(table.key) == len(RANKS)
    rng = random.Random(3)
    for _ in range(2000):
        key = bytes(rng.randrange(256) for _ in range(9))
        assert table.get(key) == RANKS.get(key)


def test_unknown_id_fails(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.bpe_decode(spark.sql("SELECT array(999999) AS ids"), "ids", RANKS).collect()


# --- shards


@pytest.mark.parametrize("count", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(count):
    order = training_order.Feistel(count)
    slots = order.slot(np.arange(count))
    assert sorted(slots.tolist()) == list(range(count))
    assert (order.sequence(slots) == np.arange(count)).all()
    if count >= 64:
        assert (slots != np.arange(count)).mean() > 0.5
        assert (training_order.Feistel(count, 5).slot(np.arange(count)) != slots).any()


def test_training_order(spark, monkeypatch):
    monkeypatch.setattr(training_order, "SHARD_SEQUENCES", 7)
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, "again", "en"), (3, "  ", "en")]
    docs = docs_of(spark, rows).withColumn("slot", F.lit("clash"))
    manifest, facts = training_order.materialise_order(docs, RANKS, public_tokenizers.PATTERN, length=64)
    stream = []
    for _, t, _ in rows[:-1]:  # the last repeats a row
        stream += TIKTOKEN.encode_ordinary(t or "") + [50256]
    assert facts["tokens"] == len(stream) and facts["kind"] == "<u2"
    stream += [50256] * (-len(stream) % 64)
    got = training_order.read_slots(manifest, facts).collect()
    assert sorted(r.slot for r in got) == list(range(facts["count"]))
    for r in got:
        assert r.ids == stream[r.sequence * 64 : r.sequence * 64 + 64] and r.shard == r.slot // facts["per_shard"]
        assert r.offset == r.slot % facts["per_shard"] * 128
        assert r.sha256 == hashlib.sha256(np.array(r.ids, dtype="<u2").tobytes()).hexdigest()
    rest = training_order.read_slots(manifest, facts, start=facts["count"] - 10).collect()
    assert sorted(r.slot for r in rest) == list(range(facts["count"] - 10, facts["count"]))
    none, empty = training_order.materialise_order(docs.where("false"), RANKS, public_tokenizers.PATTERN)
    assert training_order.read_slots(none, empty).count() == 0


def test_training_order_keeps_copies(spark):
    """A mixed corpus keeps its copies, next to each other; so do null ids with equal texts."""
    rows = [(i, f"text {i} " * (i + 1), "en") for i in range(9) for _ in range(i % 3 + 1)] + [(None, "again", "en")] * 4
    manifest, facts = training_order.materialise_order(docs_of(spark, rows).repartition(5), RANKS, public_tokenizers.PATTERN, length=16, copies=True)
    stream = [t for _, text, _ in rows for t in [*TIKTOKEN.encode_ordinary(text), 50256]]
    assert facts["tokens"] == len(stream)
    stream += [50256] * (-len(stream) % 16)
    got = training_order.read_slots(manifest, facts).collect()
    assert sorted(r.slot for r in got) == list(range(len(stream) // 16))
    assert all(r.ids == stream[r.sequence * 16 : r.sequence * 16 + 16] for r in got)
