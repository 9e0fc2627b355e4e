"""Closeness by sketches against breadth-first search."""

from collections import deque

import numpy as np
import pytest

from windowlark.operators import graphs


def search(edges, nodes, directed=False):
    """(reach, distances, closeness) by breadth-first search over incoming steps."""
    into = {n: set() for n in nodes}
    for a, b in edges:
        if a is not None and b is not None:
            into[b].add(a)
            if not directed:
                into[a].add(b)
    out = {}
    for start in nodes:
        seen, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for n in into[at]:
                if n not in seen:
                    seen[n] = seen[at] + 1
                    queue.append(n)
        total = sum(seen.values())
        out[start] = len(seen), total, (len(seen) - 1) ** 2 / total / (len(nodes) - 1) if total else 0.0
    return out


def rows(table):
    return {r["node"]: (r["reach"], r["distances"], pytest.approx(r["closeness"])) for r in table.collect()}


@pytest.mark.parametrize("directed", [False, True])
def test_small_graphs_are_exact(spark, directed):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 5), (1, 2), (7, 8), (9, None), (None, None)]
    table = spark.createDataFrame([(a, b, 1, "x") for a, b in edges], "src int, dst int, reach int, sketch string")
    alone = spark.createDataFrame([(20,), (20,), (None,)], "node int")
    found = graphs.closeness_edges(table, nodes=alone, directed=directed)
    assert rows(found) == search(edges, [0, 1, 2, 3, 4, 5, 7, 8, 9, 20], directed)


def test_star_and_path(spark):
    edges = [(0, i) for i in range(1, 150)] + [(149 + i, 150 + i) for i in range(12)]
    found = graphs.closeness_edges(spark.createDataFrame(edges, "src long, dst long"))
    assert rows(found) == search(edges, range(162))


def test_large_balls_are_within_the_error(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in zip(rng.integers(0, 1500, 3500), (1500 * rng.random(3500) ** 3).astype(int), strict=True)]
    true = search(edges, sorted({n for e in edges for n in e}))
    found = {r["node"]: r["closeness"] for r in graphs.closeness_edges(spark.createDataFrame(edges, "src long, dst long"), lg_k=11).collect()}
    error = [abs(found[n] / c - 1) for n, (_, _, c) in true.items() if c]
    assert found.keys() == true.keys() and np.mean(error) < 0.03 and max(error) < 0.12


def test_rounds_end_and_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    assert {r["reach"] for r in graphs.closeness_edges(edges, max_rounds=2).collect()} == {3, 4, 5}
    assert graphs.closeness_edges(edges.limit(0)).collect() == []


def test_leaves_of_a_hub_share_a_sketch(spark, monkeypatch):
    """Many leaves on few hubs: what a round writes follows the hubs."""
    written = []

    def counted(df, keep=graphs.materialize):
        table = keep(df)
        written.append(table.count() if "sketch" in table.columns else 0)
        return table

    monkeypatch.setattr(graphs, "materialize", counted)
    edges = [(i % 4, 10 + i) for i in range(300)] + [(0, 1), (1, 2), (2, 3), (3, 0)]
    found = graphs.closeness_edges(spark.createDataFrame(edges, "src long, dst long"))
    assert rows(found) == search(edges, [*range(4), *range(10, 310)])
    assert max(written) <= 8


def test_twins_ask_for_both_directions(spark):
    # 1 and 2 reach the same nodes but are reached by others; 5, 6 and 7 are twins, 5 to 7 come back to themselves over 3 and 8
    edges = [(0, 1), (4, 2), (1, 3), (2, 3), (3, 5), (3, 6), (3, 7), (5, 8), (6, 8), (7, 8), (8, 3), (9, 10), (9, 11)]
    found = graphs.closeness_edges(spark.createDataFrame(edges, "src long, dst long"), directed=True)
    assert rows(found) == search(edges, range(12), True)
