"""Neighbour graph against brute force, on clustered and repeated vectors."""

import numpy as np
import pytest

from windowlark.operators import knn, labels

pytestmark = pytest.mark.usefixtures("many_parts")


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "id bigint, emb array<double>")


def brute(q, qi, x, xi, k, include_self=True):
    out = {}
    for a, i in zip(q, qi, strict=True):
        d = np.sqrt(((x - a) ** 2).sum(axis=1))
        order = sorted(range(len(x)), key=lambda j: (d[j], xi[j]))
        order = [j for j in order if include_self or xi[j] != i][:k]
        out[int(i)] = [(int(xi[j]), round(float(d[j]), 9)) for j in order]
    return out


def got(graph):
    return {
        r.id: [(n, round(d, 9)) for n, d in zip(r.neighbors, r.distances, strict=True)] for r in graph.collect()
    }


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8)) * 10
    x = np.concatenate([c + rng.normal(size=(40, 8)) for c in centres])
    # a third of all rows are copies of one vector
    return np.concatenate([x, np.repeat(x[:1], 240, axis=0)])


@pytest.mark.parametrize("include_self", [True, False])
@pytest.mark.parametrize("block", [16, 1024])
def test_exact(spark, clustered, block, include_self):
    ids = np.random.default_rng(1).permutation(len(clustered)) * 3
    graph = knn.knn_exact(frame(spark, clustered, ids), "id", "emb", 7, include_self, block)
    assert got(graph) == brute(clustered, ids, clustered, ids, 7, include_self)


def test_fewer_rows_than_k(spark):
    x = np.arange(6, dtype=float).reshape(3, 2)
    graph = knn.knn_exact(frame(spark, x), "id", "emb", 10)
    assert got(graph) == brute(x, range(3), x, range(3), 10)


def test_between(spark, clustered):
    q, x = clustered[::5], clustered[1::2]
    graph = knn.knn_between(frame(spark, q), frame(spark, x, range(5000, 5000 + len(x))), "id", "emb", 4, block=32)
    assert got(graph) == brute(q, range(len(q)), x, list(range(5000, 5000 + len(x))), 4)


def test_probe_recall(spark, clustered):
    x = clustered[:480]
    want = brute(x, range(480), x, range(480), 10)
    near = got(knn.knn_probe(frame(spark, x), "id", "emb", 10, probes=4, block=16))
    hits = sum(len({a for a, _ in want[i]} & {a for a, _ in near[i]}) for i in want)
    assert hits / 4800 > 0.9


def test_probing_every_block_is_exact(spark, clustered):
    x = clustered[:300]
    near = got(knn.knn_probe(frame(spark, x), "id", "emb", 6, probes=10_000, block=8))
    assert near == brute(x, range(300), x, range(300), 6)


def test_busy_blocks_are_copied(spark, clustered, monkeypatch):
    """Many queries on few blocks: copies of a block serve them, results stay the same."""
    monkeypatch.setattr(knn, "VISITS", 7)
    monkeypatch.setattr(knn, "TOGETHER", 5)
    x = clustered[:200]
    assert got(knn.knn_exact(frame(spark, x), "id", "emb", 5, block=16)) == brute(x, range(200), x, range(200), 5)


def test_long_and_nested(spark, clustered):
    graph = knn.knn_exact(frame(spark, clustered[:50]), "id", "emb", 3)
    assert got(knn.edges_nested(knn.edges_long(graph))) == got(graph)
    assert knn.edges_long(graph).groupBy("id").count().where("count <> 3").count() == 0


def test_vote_and_agreement(spark):
    nodes = spark.createDataFrame(
        [(1, "a", "a"), (2, "a", "b"), (3, "a", "b"), (4, "b", "b")], "id bigint, truth string, guess string"
    )
    edges = spark.createDataFrame(
        [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 2.0), (2, 2, 0.0), (2, 1, 1.0), (3, 3, 0.0), (3, 1, 1.0), (3, 1, 3.0), (4, 4, 0.0)],
        "id bigint, neighbor_id bigint, distance double",
    )
    rows = {r.id: r for r in labels.knn_labels(nodes, edges).collect()}
    assert (rows[1].knn_label, rows[1].n, rows[1].total) == ("b", 2, 3)
    # one vote each: the smaller label wins
    assert rows[2].knn_label == "a" and rows[2].score == 0.5
    assert (rows[3].knn_label, rows[3].distance_p50, rows[3].distance_p95) == ("a", 1.0, 3.0)


@pytest.mark.parametrize(("n", "hits", "rate"), [(11, 0, 0.0), (9, 6, 0.6666666667), (8, 5, 0.625)])
def test_agreement_rates(spark, n, hits, rate):
    rows = [("x", "y", "x" if i < hits else "z") for i in range(n)]
    r = labels.label_agreement(spark.createDataFrame(rows, "ego_truth string, ego_label string, knn_label string")).first()
    assert (r.n, r.n_ego_matches, r.n_knn_matches) == (n, 0, hits)
    assert abs(r.pct_knn_matches - rate) < 1e-9 and r.pct_ego_matches == 0


def test_no_product_in_the_plan(spark, clustered, capsys):
    graph = knn.knn_exact(frame(spark, clustered), "id", "emb", 5, block=16)
    graph.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_exact_search_moves_no_row_per_query_and_block(spark, monkeypatch):
    """Vectors without structure: every query needs every block, but no written table has a row for each such pair."""
    written = []

    def counted(df, keep=knn.materialize):
        table = keep(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(knn, "materialize", counted)
    x = np.random.default_rng(4).normal(size=(600, 32))
    whole = brute(x, range(600), x, range(600), 5)
    assert got(knn.knn_exact(frame(spark, x), "id", "emb", 5, block=8)) == whole
    assert got(knn.knn_probe(frame(spark, x), "id", "emb", 5, probes=10_000, block=8)) == whole
    assert max(written) <= 600 * 5


def test_many_tiles(spark, monkeypatch, clustered):
    monkeypatch.setattr(knn, "TILE", 16)
    monkeypatch.setattr(knn, "RUN", 20)
    monkeypatch.setattr(knn, "MEASURED", 7)
    ids = np.random.default_rng(2).permutation(len(clustered))
    assert got(knn.knn_exact(frame(spark, clustered, ids), "id", "emb", 4, False, 16)) == brute(clustered, ids, clustered, ids, 4, False)


def test_probes_take_the_nearest_rings(spark):
    """Two far groups, and as many probes as one has blocks: each row finds its own group whole."""
    x = np.random.default_rng(6).normal(size=(120, 4)) + np.repeat([[0.0], [500.0]], 60, axis=0)
    near = got(knn.knn_probe(frame(spark, x), "id", "emb", 5, probes=60, block=4))
    assert near == brute(x, range(120), x, range(120), 5)
