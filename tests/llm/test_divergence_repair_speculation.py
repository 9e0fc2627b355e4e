"""Source divergence, conversation repair and speculative encoding against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from windowlark.llm import conversation_repair, source_divergence, speculative_bpe

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return speculative_bpe.read_tokenizer(JSON)


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(JSON)
    found.no_padding()
    found.no_truncation()
    return found


def odd_texts(n):
    rng = random.Random(7)
    bits = ["a", "aa", " ", "  ", "\n", "\t", "'s", "'", "'ll", "é", "世", "0", "12", "!", "...", "<|endoftext|>", "<|endof", "՘", "\U0003d000",
            " ", "　", "\x1c", "\x85", "th", "ing", "\r\n", "\U0001f600", "½", "\x00"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_words_as_the_library(tokenizer, library):
    texts = [*odd_texts(5000), *["a" * n for n in range(120)], "ab" * 4000, " " * 3000, "!?" * 900]
    encoder = speculative_bpe.Encoder(tokenizer)
    got = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert 0 < encoder.failed < encoder.met


def test_pairs_agree_with_merges(tokenizer):
    rng = np.random.default_rng(1)
    left, right = rng.integers(0, 50256, (2, 20_000))
    left[:300] = right[:300]
    fits = tokenizer.compatible(left, right)
    whole = [tokenizer.merged(tokenizer.token[a] + tokenizer.token[b]) == [a, b] for a, b in zip(left, right, strict=True)]
    assert fits.tolist() == whole and 0 < sum(whole) < len(whole)


def test_disorderly_vocabulary_merges_exactly():
    vocab = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 258}
    # abc can be made by two merges, one of them before its part
    table = speculative_bpe.Tokenizer(vocab, [(b"a", b"bc"), (b"b", b"c"), (b"a", b"b")], {})
    assert not table.orderly
    words = [b"abc", b"aabcb", b"ab" * 40]
    ids, failed = table.encode_words(words)
    assert failed == 3 and [np.frombuffer(x, "<i4").tolist() for x in ids] == [table.merged(w) for w in words]
    assert table.merged(b"abc") == [256] and table.merged(b"aab") == [97, 257]


def test_memory_and_long_texts_change_nothing(tokenizer, monkeypatch):
    texts = odd_texts(300)
    whole = speculative_bpe.Encoder(tokenizer).encode(texts)
    monkeypatch.setattr(speculative_bpe, "MEMO_PIECES", 5)
    encoder = speculative_bpe.Encoder(tokenizer)
    assert [encoder.encode([t])[0] for t in texts] == whole
    monkeypatch.setattr(speculative_bpe, "BLOCK_CHARS", 4)
    assert [b"".join(encoder.encode(list(speculative_bpe._cut_long(t)))) for t in texts if "<" not in t] == [w for t, w in zip(texts, whole, strict=True) if "<" not in t]


def test_table_round_trip(spark, tokenizer, library):
    texts = [None, "", *odd_texts(200), "the same", "the same", "word " * 600_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, decoded_by string")
    ids = speculative_bpe.encode(df, "text", tokenizer)
    back = {r["id"]: r for r in speculative_bpe.decode(ids, "ids", tokenizer).collect()}
    packed = {r["id"]: r for r in speculative_bpe.decode(speculative_bpe.encode(df, "text", tokenizer, carry=["id"], packed=True), "ids", tokenizer).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert back[i]["ids"] == want and back[i]["decoded_by"] == "x"
        assert np.frombuffer(packed[i]["ids"], "<u4").tolist() == want
        assert back[i]["decoded"] == packed[i]["decoded"] == library.decode(want, skip_special_tokens=False) == (text or "")
    none = speculative_bpe.encode(df.limit(0), "text", tokenizer)
    assert none.count() == 0 and none.columns == ["id", "text", "decoded_by", "ids"]
    with pytest.raises(ValueError, match="exists"):
        speculative_bpe.encode(df.withColumnRenamed("decoded_by", "IDS"), "text", tokenizer)


def test_broken_ids_decode_as_the_library(spark, tokenizer, library):
    rows = [[1, 60_000, 2], [-5, 3], [50256, 200, 201, 202], [], [140, 141, 300]]
    df = spark.createDataFrame([(r,) for r in [*rows, None]], "ids array<int>")
    got = [r["decoded"] for r in speculative_bpe.decode(df, "ids", tokenizer).collect()]
    assert got == [*[library.decode([i for i in r if i >= 0], skip_special_tokens=False) for r in rows], ""]


# --- conversations


def _best(rows):
    """Least (cost, audit, lines) by trying every edit with whole strings."""
    follow = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    filled = (2, 2, 3, 2)

    def inserted(states):
        for _ in range(3):
            for q, (cost, audit, lines) in list(states.items()):
                to = filled[q]
                new = (cost + 2, audit + "I", (*lines, ("assistant:" if to == 3 else "user:")))
                if to not in states or new < states[to]:
                    states[to] = new
        return states

    # candidates keep every inserted variant of a state, so that no tie is settled too early
    found = {(0, (0, "", ()))}
    for role, text, fault in rows:
        nxt = {}
        for q, (cost, audit, lines) in found:
            at, more, new_lines = q, 0, lines
            for k in range(4):
                extra = fault == "truncated"
                options = [("D", at, 3, new_lines)]
                if fault not in ("blank", "duplicate"):
                    if at in follow.get(role[:1], {}):
                        options.append(("K", follow[role[:1]][at], extra, (*new_lines, f"{role}:{text}")))
                    to = filled[at]
                    options.append(("R", to, 2 + extra, (*new_lines, f"{'assistant' if to == 3 else 'user'}:{text}")))
                for letter, to, price, out in options:
                    new = (cost + 2 * k + price, audit + "I" * k + letter, out)
                    if to not in nxt or new < nxt[to]:
                        nxt[to] = new
                at = filled[at]
                new_lines = (*new_lines, "assistant:" if at == 3 else "user:")
        found = set(nxt.items())
    ends = [(s[0], s[1], s[2]) for q, s in inserted(dict(found)).items() if q in (0, 3)]
    return min(ends)


def _brute(conversations):
    out = {}
    for key in {r[0] for r in conversations}:
        rows = [(t, r or (" " if r is None else r), x if x is not None else " ") for c, t, r, x in conversations if c == key]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, lines = _best(marked)
        turns = {r[0] for r in rows} - {None}
        faults = Counter(f for *_, f in marked)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[key] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(n):
    rng = random.Random(3)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["Hi.", "Well?", "and so", " \t", "", None, "One.\n", " "]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(50)}{rng.choice('.! ')}") for c in range(n) for _ in range(rng.randrange(1, 12))]
    return [*rows, *rows[:40], (None, 1, "user", "x."), (None, 2, "assistant", "y.")]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment", [(100_000, 1 << 24), (3, 1 << 24), (100, 7)])
def test_repairs_are_the_cheapest(spark, segment):
    rows = conversations(150)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", fault int")
    repaired = conversation_repair.repair_conversations(df, segment=segment)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.audit_conversations(repaired).collect()}
    assert got == _brute(rows)
    letters = {r["edit"] for r in repaired.collect()}
    assert letters == set("KRDI")


def test_giant_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}." if i % 97 else "cut") for i in range(30_000)] + [(2, 0, "user", "a.")]
    df = spark.createDataFrame(rows, SCHEMA)
    repaired = conversation_repair.repair_conversations(df, segment=(1000, 1 << 24))
    got = {r["conv_id"]: r for r in conversation_repair.audit_conversations(repaired).collect()}
    assert got[2]["audit"] == "KI" and got[1]["gaps"] == 0 and len(got[1]["audit"]) >= 30_000
    # "cut" by a user and by an assistant are each seen once, later ones are duplicates
    assert (got[1]["truncated"], got[1]["duplicate"]) == (2, 30_000 // 97 + 1 - 2)


def test_damage_and_empty_conversations(spark):
    df = spark.createDataFrame([(i, t, None if t == 3 else "user", None if t == 2 else "A. b! c") for i in range(60) for t in (0, 1, 2, 3)], SCHEMA)
    hurt = conversation_repair.damaged(df)
    audit = conversation_repair.audit_conversations(conversation_repair.repair_conversations(hurt.where("conv_id > 2")))
    rows = {r["conv_id"]: r for r in conversation_repair.audit_all(df, audit).collect()}
    assert len(rows) == 60 and rows[1]["audit"] == "" and rows[1]["cost"] == rows[1]["gaps"] == 0
    assert rows[1]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert {r["text"] for r in hurt.collect()} == {"A. b! c", "", "A b c", " "}
    none = conversation_repair.audit_conversations(conversation_repair.repair_conversations(df.limit(0)))
    assert none.collect() == [] and conversation_repair.audit_all(df.limit(0), none).collect() == []


# --- divergence


def _divergence(rows, top):
    import re

    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        within = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in within.items() if n >= 3]
        uses = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2]) for s in {d[1] for d in docs if d[0] == lang}}
        total = Counter(t for d in docs if d[0] == lang for t in d[2])

        def share(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: share(c) for s, c in uses.items()}
        q = share(total)
        for s in uses:
            found = {"pair": [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in uses if o != s],
                     "term": [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if uses[s][t] and p[s][t] > q[t]]}
            for part, values in found.items():
                ordered = sorted(values, key=lambda v: (-v[0], v[1].encode()))[: top if part == "term" else None]
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ordered, 1)}
    return out


def _random_docs():
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Über", "über", "É", "don't", "Ǆ"]
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["s0"] * 8 + [f"s{i}" for i in range(12)] + [None])
        rows.append((lang, source, " ".join(rng.choice(words[: rng.choice([5, 40, 125])]) for _ in range(rng.randrange(40)))))
    return [*rows, *rows[:20], ("en", "textless", None), ("en", "textless", ""), ("xx", "a", "once 1 2"), ("xx", "b", "twice"), ("xx", None, "-")]


def test_divergence_is_exact(spark, many_parts, monkeypatch):
    rows = _random_docs()
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "lang string, source string, text string, ix int, term int")
    got = [tuple(r) for r in source_divergence.source_divergence(df, top=30).collect()]
    assert len(got) == len(set(got)) and set(got) == _divergence(rows, 30)


def test_divergence_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert source_divergence.source_divergence(df).collect() == []
    one = spark.createDataFrame([("en", "a", "x x x")], df.schema)
    assert source_divergence.source_divergence(one).collect() == []


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_tree_counts_every_pair_of_entries_once(monkeypatch, block):
    monkeypatch.setattr(source_divergence, "BLOCK_COMBINATIONS", block)
    rng = random.Random(2)
    zero = [10 + i for i in range(6)]
    rows = Counter((rng.choice("xy"), tuple((s, rng.randrange(1, 4) * 10**8) for s in range(6) if rng.random() < 0.6)) for _ in range(200))
    paths = sorted((lang, path, n) for (lang, path), n in rows.items() if path)
    flat = [(s, p, zero[s]) for _, path, _ in paths for s, p in path]
    codes = {lang: i for i, lang in enumerate("xy")}
    parts = source_divergence.tree_corrections(
        np.array([codes[r[0]] for r in paths]), np.cumsum([len(r[1]) for r in paths]), *np.array(flat, dtype=np.int64).T, np.array([r[2] for r in paths])
    )
    got = Counter()
    for lang, group, item, high, low in parts:
        for la, g, i, h, lo in zip(*(x.tolist() for x in (lang, group, item, high, low)), strict=True):
            got["xy"[la], g, i] += (h << 31) + lo
    gain = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for lang, path, n in paths:
        for (s, p), (t, q) in itertools.permutations(path, 2):
            want[lang, s, t] += n * (gain(p, q) - gain(p, zero[t]) - gain(zero[s], q) + gain(zero[s], zero[t]))
    assert got == want
