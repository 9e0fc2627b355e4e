"""Successive halving against scoring every setting on all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windowlark.learn import halving

CLASSES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 6))
    y = np.stack([x[:, 0] + x[:, 1] > 0, x[:, 2] * x[:, 3] > 0, x[:, 4] > 1], axis=1)
    data = [(i, [float(v) for v in a], [c for c, k in zip(CLASSES, b, strict=True) if k], i % 3 == 0) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id int, v array<double>, tags array<string>, held boolean").repartition(4).cache()


def test_rungs_are_nested_and_shrink(rows):
    seen = []

    def judge(part, points):
        seen.append(({r["id"] for r in part.select("id").collect()}, [p["n"] for p in points]))
        return [float("nan") if p["n"] == 5 else -abs(p["n"] - 3) for p in points]

    best, table = halving.halving(rows, [{"n": n} for n in range(8)], judge, ["id"])
    assert best == {"n": 3} and [p for _, p in seen] == [list(range(8)), [1, 2, 3, 4], [2, 3]]
    assert all(a < b for (a, _), (b, _) in zip(seen, seen[1:], strict=False)) and 60 < len(seen[0][0]) < 170
    assert table.where("goes_on").groupBy("rung").count().orderBy("rung").collect()[-1] == (2, 1)
    again = []
    halving.halving(rows, [{"n": 1}, {"n": 2}], lambda part, points: again.append(part.count()) or [0.0, 0.0], ["id"])
    assert again == [len(seen[0][0])]


def test_same_winner_with_fewer_rows(rows):
    judge = halving.judge_boosted("v", "tags", CLASSES, "held", rounds=3, bins=8)
    points = [{"depth": 1, "eta": 0.3}, {"depth": 3, "eta": 0.3}, {"depth": 1, "eta": 0.01}, {"depth": 3, "min_child_weight": 500.0}]
    best, table = halving.halving(rows, points, judge, ["id"], rungs=(0.4, 1.0))
    whole = judge(rows, points)
    assert best == points[int(np.argmax(whole))] == points[1]
    assert table.agg(F.sum("rows")).first()[0] < 900 * len(points)


def test_penalties_of_all_labels(rows):
    judge = halving.judge_penalties("v", "tags", CLASSES, "held")
    best, table = halving.halving(rows, [{"reg": 1e5}, {"reg": 0.01}], judge, ["id"], rungs=(0.5, 1.0))
    assert table.count() == 2 and best["reg"] in (1e5, 0.01)
    found = judge(rows, [{"reg": 0.01}])
    assert 0.6 < found[0] <= 1


def test_refusals(rows):
    with pytest.raises(ValueError, match="settings"):
        halving.halving(rows, [], None)
    with pytest.raises(ValueError, match="grow"):
        halving.halving(rows, [{}], None, rungs=(0.5, 0.2))
