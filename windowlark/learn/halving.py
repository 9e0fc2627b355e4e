"""Search by successive halving over nested shares of the rows.

The first rung scores every setting on a small hashed share of the rows; the better part goes on to a larger share, and so on to all rows.
Shares are nested, since a row is in a rung if its hash lies below the rung's share, so a rerun sees the same rows.
The share of each rung is the documented bound of what a setting is judged by; the last rung is the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windowlark.functions.vector import unit_hash
from windowlark.learn import boosting, multilabel
from windowlark.learn.metrics import macro_average_precision
from windowlark.session import discard, materialize

#: Shares of the rows, rung by rung.
RUNGS = (0.125, 0.25, 0.5, 1.0)


def halving(
    df: DataFrame, points: Sequence[dict], judge: Callable[[DataFrame, list[dict]], list[float]], key: Sequence[str] = (), rungs: Sequence[float] = RUNGS,
    keep: float = 0.5, seed: int = 0, draw: Column | None = None,
) -> tuple[dict, DataFrame]:
    """(best point, table of rung, share, rows, point, score, goes_on).

    ``judge`` scores settings on the rows of a rung, larger is better; ties and missing scores go to the earlier point. A share ``keep`` of the
    settings goes on, one at least, and a single one is not scored again. ``draw`` replaces the hash of ``key`` as a number in [0, 1).
    """
    if not points:
        raise ValueError("no settings")
    if sorted(rungs) != list(rungs) or rungs[-1] != 1.0:
        raise ValueError("shares must grow to 1")
    drawn = unit_hash(*key, seed=seed) if draw is None else draw
    alive, told = list(range(len(points))), []
    for rung, share in enumerate(rungs):
        part = df if share == 1.0 else materialize(df.where(drawn < share))
        rows = part.count()
        scores = judge(part, [points[i] for i in alive]) if rows else [float("nan")] * len(alive)
        ranked = sorted(zip(alive, scores, strict=True), key=lambda s: (-(s[1] if s[1] == s[1] else -math.inf), s[0]))
        count = 1 if share == 1.0 else max(1, math.ceil(len(alive) * keep))
        alive = sorted(i for i, _ in ranked[:count])
        told += [(rung, float(share), rows, str(points[i]), float(s), i in alive) for i, s in ranked]
        if share < 1.0:
            discard(part)
        if len(alive) == 1:
            break
    table = df.sparkSession.createDataFrame(told, "rung int, share double, rows long, point string, score double, goes_on boolean")
    return points[alive[0]], table


def judge_penalties(vec: str, labels: str, classes: Sequence[str], held: str, tol: float = 1e-5) -> Callable:
    """Macro average precision, on rows where ``held`` is true, of logistic models {"reg": ...} of all labels fitted in shared passes on the others."""

    def judge(rows: DataFrame, points: list[dict]) -> list[float]:
        return multilabel.search_penalty_held(rows, vec, labels, classes, [p["reg"] for p in points], held, tol)[1]

    return judge


def judge_boosted(vec: str, labels: str, classes: Sequence[str], held: str, **fixed) -> Callable:
    """The same of boosted trees whose settings are arguments of ``fit_boosted``; quantile bins are cut once a rung."""

    def judge(rows: DataFrame, points: list[dict]) -> list[float]:
        train, test = rows.where(~F.col(held)), rows.where(held)
        bins = fixed.get("bins", 32)
        edges = boosting.quantile_edges(train, vec, bins)
        out = []
        for p in points:
            model = boosting.fit_boosted(train, vec, labels, classes, edges=edges, **{**fixed, **p})
            scored = test.select(F.col(labels).alias("truth"), model.scores(vec).alias("scores"))
            found = macro_average_precision(scored, "scores", "truth", list(classes)).first()[0]
            out.append(float("nan") if found is None else float(found))
        return out

    return judge
