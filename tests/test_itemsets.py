"""Item sets over bitmaps against counting by hand."""

import itertools
import random
from collections import Counter

import pytest

from windowlark.operators import itemsets


def brute(baskets, support, most):
    n = Counter()
    for b in baskets:
        items = sorted({i for i in b or [] if i is not None})
        for size in range(1, most + 1):
            n.update(itertools.combinations(items, size))
    return {k: v for k, v in n.items() if v >= support * len(baskets) - 1e-9}


def baskets():
    rng = random.Random(4)
    made = [[f"i{int(30 * rng.random() ** 2)}" for _ in range(rng.randrange(9))] for _ in range(500)]
    return [*made, *[["i1", "i2", "i3", "i4", "i1"]] * 60, None, [], [None, "i0"]]


@pytest.mark.parametrize(("segment", "candidates"), [(1 << 15, 200_000), (64, 7)])
def test_sets_and_rules(spark, monkeypatch, segment, candidates):
    monkeypatch.setattr(itemsets, "SEGMENT", segment)
    monkeypatch.setattr(itemsets, "CANDIDATES", candidates)
    rows = baskets()
    if candidates == 7:
        rows = rows[300:]
    df = spark.createDataFrame([(b, 1, 2) for b in rows], "items array<string>, freq int, row int").repartition(3)
    support = 0.03 if candidates > 7 else 0.13
    sets = itemsets.frequent_sets(df, "items", support)
    want = brute(rows, support, 4)
    assert {tuple(r["items"]): r["freq"] for r in sets.collect()} == want and max(map(len, want)) == 4
    rules = itemsets.association_rules(sets, len(rows), 0.5).collect()
    expected = {(k[:i] + k[i + 1 :], k[i]): v / want[k[:i] + k[i + 1 :]] for k, v in want.items() if len(k) > 1 for i in range(len(k))}
    assert {(tuple(r["antecedent"]), r["consequent"]): r["confidence"] for r in rules} == {k: pytest.approx(c) for k, c in expected.items() if c >= 0.5}
    assert all(r["lift"] == pytest.approx(r["confidence"] * len(rows) / want[(r["consequent"],)]) for r in rules)


def test_hot_basket(spark):
    """A basket with very many items, of which all are frequent with a twin, adds bits and no pairs of its own."""
    many = [f"x{i:05}" for i in range(20_000)]
    df = spark.createDataFrame([(many,), (many[:2],), (["x00000", "y"],)], "items array<string>")
    sets = itemsets.frequent_sets(df, "items", 0.6)
    assert {tuple(r["items"]): r["freq"] for r in sets.collect()} == {("x00000",): 3, ("x00001",): 2, ("x00000", "x00001"): 2}


def test_nothing(spark):
    df = spark.createDataFrame([], "items array<string>")
    assert itemsets.frequent_sets(df, "items", 0.1).collect() == []
    alone = spark.createDataFrame([(None,), ([],)], "items array<string>")
    assert itemsets.frequent_sets(alone, "items", 0.1).collect() == []
