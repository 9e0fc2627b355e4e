"""Bloom dedup, URL rules, line templates and entropy mixing against brute force, with awkward inputs."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from windowlark.llm import bloom_dedup, entropy_mix, line_templates, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


ROWS = [
    (1, "a b c", "x"), (2, "a  b\tc", "x"), (3, "ab\nc", "y"), (4, None, "y"), (5, "", None), (6, " \n ", None), (7, "only me", "x"),
    (8, "a\u00a0bc", "x"), (9, "long " * 3000, "x"), (10, "long" * 3000, "y"), (None, "only me", "x"), (7, "only me", "x"), (11, "é", "z"),
]


def test_bloom_dedup_brute(spark):
    got = bloom_dedup.bloom_dedup(docs_of(spark, ROWS).withColumn("keep_id", F.lit("clash"))).collect()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[squeezed(t)].append((-len(t or ""), i is None, i))
    assert len(got) == len(ROWS)
    for text, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert len(mine) == len(members) and {r.group_size for r in mine} == {len(members)}
        assert {r.keep_id for r in mine} == {best} and [r.doc_id for r in mine if r.kept] == [best]


def test_bloom_dedup_without_broadcast_or_bits(spark, monkeypatch):
    """A filter too large to send, and one so small that every row is a suspect, give the same rows."""
    docs = docs_of(spark, [(i, f"text {i % 70}", "x") for i in range(300)])
    want = sorted(map(tuple, bloom_dedup.bloom_dedup(docs).collect()))
    monkeypatch.setattr(bloom_dedup, "small_enough", lambda *a: False)
    assert sorted(map(tuple, bloom_dedup.bloom_dedup(docs).collect())) == want
    assert sorted(map(tuple, bloom_dedup.bloom_dedup(docs, bits_per_row=0).collect())) == want


def test_filter_holds_repeats_only(spark):
    hashes = spark.range(20000).select(F.xxhash64("id").alias("h"))
    words = bloom_dedup.repeat_filter(hashes.unionAll(hashes.where("pmod(h, 50) = 0")), "h", bloom_dedup.word_bits(20000, 16))
    assert 300 < words.count() < 1500


def fits(rule, host, path):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


def test_url_rules_brute(spark, many_parts):
    rules = [
        ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("example.net", "/en/xy", "allow"),
        ("a.example.net", "/", "allow"), ("org", "", "block"), ("b.org", "/fr/", "allow"), ("com", "/é", "block"), ("b.org", "/fr/", "allow"),
    ]
    urls = [
        "http://net/", "http://net", "https://Example.NET/en/x", "https://example.net/en/xyz?q#f", "https://www.example.net/en/", "http://a.example.net/en/xy",
        "http://notnet/", "http://b.org", "http://c.b.org/fr/1", "http://org?x", "http://x.com/é/1", "http://x.com/e", "nothing", None, "", "http://", "a://b://net/",
        "http://example.net/en/\U0010ffff", "http://example.net/en", "http://b.org/fr/#", "http://..net/x", "http://B.ORG/FR/",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 3)] + [(None, "http://net/", "h")], "page_id long, url string, rule string")
    made = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = url_rules.judge_urls(pages, made).collect()
    assert len(got) == len(urls) * 3 + 1
    for r in got:
        if r.page_id is None:
            assert (r.rule, r.verdict) == ("net/", "block")
            continue
        url = urls[r.page_id % len(urls)]
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        best = max([x for x in rules if fits(x, host, path)], key=lambda x: (len(x[0] + x[1]), len(x[0])), default=None)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((best[0] + best[1], best[2]) if best else (None, "allow")), url


def test_hosts_of_many_labels(spark):
    """Work does not grow with the square of the labels; only as many as the deepest rule has are looked at."""
    many = "a." * 100_000
    rows = [(1, f"https://{many}example.net/en/x"), (2, f"https://{many}org/fr/"), (3, f"https://{many}/en/"), (4, "https://net")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame([("example.net", "/en/", "allow"), ("net", "", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules, default="block").collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("org/fr/", "allow"), 3: (None, "block"), 4: ("net", "block")}


def test_no_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_rules.judge_urls(pages, none).collect()] == [(1, "a.b", "/", None, "allow")]
    assert url_rules.judge_urls(pages.where("false"), none).count() == 0


def test_line_templates(spark):
    foot = "Printed on page {} of the annual report by the office"
    rows = [(i, f"own words number{chr(97 + i)} that nobody else has in here\n\n{foot.format(i)}\n{foot.format(i)}", "x") for i in range(12)]
    rows += [(50, "short\n" + "w " * 5000, "x"), (51, None, "x"), (52, "", "x"), (None, foot.format("x"), "x"), (53, "own words " + foot, "x")]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs_of(spark, rows), counts=True).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        if i is not None and i < 12:
            lines = text.split("\n")
            assert got[i].text == ("\n".join(lines[:3]) if i == 0 else "\n".join(lines[:2]))
            assert got[i].n_dropped == (1 if i == 0 else 2) and got[i].n_lines == 4
        elif i is not None:
            assert got[i].text == text and got[i].n_dropped == 0
    assert got[None].text == ""  # the 13th to use the template: x is a variable field
    assert got[0].asDict().keys() >= {"doc_id", "text", "lang", "source", "n_chars"}


def test_lines_of_few_documents_stay(spark):
    rows = [(i, "the same line in nine documents only", "x") for i in range(9)] + [(99, "the same line\n" * 40, "y")]
    got = line_templates.drop_recurring_lines(docs_of(spark, rows))
    assert sorted(map(tuple, got.select("doc_id", "text").collect())) == sorted((i, t) for i, t, _ in rows)


def own_words(i, n=6):
    return " ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:8] for k in range(n))


def test_digit_fields_do_not_count_against_a_template(spark):
    """Lines with many figures recur by their words, and lines of figures only by their wording."""
    rows = [(i, f"{own_words(i)}\nPage {i} of 12\nCopyright 2024 Example Inc.\n030 1234 5678\n7{i} 8{i} 9{i}", "x") for i in range(12)]
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs_of(spark, rows)).collect()}
    for i, text, _ in rows:
        lines = text.split("\n")
        assert got[i] == (text if i == 0 else "\n".join([lines[0], lines[4]]))


def test_frequent_values_stay_variable(spark):
    """Fields whose every value is in many documents; two templates of one leaf stay apart."""
    word = lambda i: "abcdefghijkl"[i % 12] * 4
    foot = "this page was made for {} by the branch in {} and checked"
    rows = [(i, foot.format(word(i), word(i // 12)), "x") for i in range(288)]
    rows += [(1000 + i, f"this page was sent out from an {word(i)} office of our old company", "x") for i in range(40)]
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs_of(spark, rows)).collect()}
    assert {i for i, text in got.items() if text} == {0, 1000}


def test_long_lines_recur_from_two_documents(spark):
    """A passage of more than 50 words in two documents, as it is or with a word changed; short lines and figures stay."""
    passage, other = own_words("passage", 60), own_words("other", 70)
    short = own_words("short", 20)
    figures = lambda i: "sum " + " ".join(str(i * 100 + k) for k in range(60))
    rows = [(i, f"{own_words(i)}\n{passage}\n{short}\n{figures(i)}", "x") for i in range(3)]
    rows += [(5 + i, f"{own_words(5 + i)}\n{other} {'xy'[i]}", "x") for i in range(2)]
    rows += [(10 + i, f"{own_words(10 + i)}\n{figures(99)}", "x") for i in range(2)]
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs_of(spark, rows)).collect()}
    for i, text, _ in rows:
        lines = text.split("\n")
        assert got[i] == (text if i in (0, 5, 10) else lines[0] if i in (6, 11) else "\n".join([lines[0], *lines[2:]]))


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a line that one row repeats often enough", "x")] * 30
    assert line_templates.drop_recurring_lines(docs_of(spark, rows), counts=True).where("n_dropped > 0").count() == 0


def test_line_columns_may_clash(spark, monkeypatch):
    """Columns named as the helper columns stay; counts replace theirs. Joins instead of a broadcast change nothing."""
    monkeypatch.setattr(line_templates, "LEAF_ROW_BYTES", 1 << 40)
    foot = "Printed on page {} of the annual report by the office"
    names = ("row", "key", "gone", "_row", "_key", "_gone", "n_lines", "n_dropped", "line", "leaf", "doc")
    docs = docs_of(spark, [(i, f"{own_words(i)}\n{foot.format(own_words(i, 1))}", "x") for i in range(12)])
    docs = docs.select("*", *[F.lit(f"kept {n}").alias(n) for n in names])
    plain = line_templates.drop_recurring_lines(docs)
    assert plain.columns == docs.columns
    assert all(r[n] == f"kept {n}" for r in plain.collect() for n in names)
    counted = line_templates.drop_recurring_lines(docs, counts=True).collect()
    assert [(r.n_lines, r.n_dropped, r["gone"]) for r in sorted(counted)] == [(2, 0 if i == 0 else 1, "kept gone") for i in range(12)]


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mix_targets_and_rounding(spark):
    rows = [(i, "word " * (1 + i * 37 % 90), ["a", "b", "c", None, "tiny"][i % 5] if i % 40 else "a") for i in range(600)]
    rows = [r for r in rows if r[2] != "tiny" or r[0] < 30] + [(9000, None, "a"), (9001, "", "void"), (None, "x y z", "b")]
    docs = docs_of(spark, rows).withColumn("size", F.lit("clash"))
    got = entropy_mix.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_by_hand(sizes)
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert r.taken == r.copies * r["size"] and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(30, 0.01 * t), s
    assert sorted(map(str, got)) == sorted(map(str, entropy_mix.mix_sources(docs.repartition(7)).collect()))


def test_rates_are_the_entropy_optimum(spark):
    """The fitted rates meet their targets before rounding and are one function of size per source."""
    rows = [(i, "w " * (1 + i % 50), "ab"[i % 2]) for i in range(400)]
    got = entropy_mix.mix_sources(docs_of(spark, rows)).toPandas()
    for _, g in got.groupby("source"):
        assert (g["rate"] * g["size"]).sum() == pytest.approx(g["target"].iloc[0], rel=1e-6)
        assert g.groupby("size")["rate"].nunique().max() == 1


def test_mix_carries_rows(spark):
    docs = docs_of(spark, [(1, "a b", "x"), (2, "c", "y")])
    got = entropy_mix.mix_sources(docs, carry=True)
    assert set(docs.columns) <= set(got.columns) and got.count() == 2
    assert entropy_mix.mix_sources(docs.where("false"), carry=True).count() == 0


@pytest.mark.parametrize("op", [bloom_dedup.bloom_dedup, line_templates.drop_recurring_lines, entropy_mix.mix_sources])
def test_empty_table(spark, op):
    assert op(docs_of(spark, [(1, "a", "x")]).where("false")).count() == 0
