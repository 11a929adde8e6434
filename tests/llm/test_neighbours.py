import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import neighbours

VECTORS = "item bigint, feats array<float>, a string, cosine int"


def _clusters(n, dim=16, groups=60, seed=0, spread=0.6):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, dim))
    return (c[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))) * rng.uniform(0.1, 9, (n, 1))


def _truth(x, k, least=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {i: {int(j) for j in np.argsort(-s[i])[:k] if least is None or s[i, j] >= least} for i in range(len(x))}


def _frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in r], "x", 1) for i, r in enumerate(x)] + list(extra), VECTORS)


def test_recall_against_brute_force(spark):
    x = _clusters(6000)
    near = neighbours.nearest(_frame(spark, x).repartition(4), 10, dim=16, list_rows=128, members=3, probes=8, member_ratio=1.3, probe_ratio=1.5, spread=0.0)
    got = near.collect()
    true = _truth(x, 10)
    assert sum(r.b in true[r.a] for r in got) / 60_000 >= 0.9
    assert {r.a for r in got} == set(range(6000)) and all(r.a != r.b for r in got)
    assert max(r.rank for r in got) == 10


def test_close_pairs_and_asked_rows(spark):
    x = _clusters(1500, spread=0.2, seed=3)
    true = {(min(i, j), max(i, j)) for i, js in _truth(x, 5, 0.9).items() for j in js}
    got = {(r.a, r.b) for r in neighbours.close_pairs(_frame(spark, x), 0.9, 5, dim=16, list_rows=400, members=2, probes=4, spread=0.0, member_ratio=1.3, probe_ratio=1.5).collect()}
    assert len(got & true) >= 0.97 * len(true) and len(got - true) <= 0.03 * len(got)
    asked = neighbours.nearest(_frame(spark, x), 3, dim=16, asks=F.col("item") % 20 == 0, list_rows=400).collect()
    assert {r.a for r in asked} == set(range(0, 1500, 20))


def test_graph_finds_what_a_full_search_finds():
    x = neighbours._unit((_clusters(3500, seed=5) * 1000).astype(np.int16))
    c, q = x[:3000], x[3000:]
    g = neighbours.CentroidGraph(c)
    ids, _ = g.search(q, 8, steps=10)
    best = np.argsort(-(q @ c.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids, best)]) >= 0.9


def test_lists_are_balanced():
    x = neighbours._unit((_clusters(8000, seed=7, groups=5) * 1000).astype(np.int16))
    c = neighbours.balanced_centroids(x, 64)
    size = np.bincount(np.argmax(x @ c.T, 1), minlength=len(c))
    assert size.max() <= 4 * 8000 / len(c)


def test_copies_bad_vectors_and_repeats(spark):
    x = _clusters(200, groups=200, seed=9)
    bad = [(900, None, "x", 1), (901, [0.0] * 16, "x", 1), (902, [1.0] * 15, "x", 1), (903, [float("nan")] * 16, "x", 1), (904, [None] * 16, "x", 1), (None, [1.0] * 16, "x", 1)]
    hot = [(1000 + i, [float(v) for v in x[0]], "x", 1) for i in range(300)] + [(5000, [float(v) for v in x[1]], "x", 1)]
    df = _frame(spark, x, bad + hot)
    got = neighbours.nearest(df.union(df.limit(50)), 4, dim=16).collect()
    near = {}
    for r in sorted(got, key=lambda r: r.rank):
        near.setdefault(r.a, []).append((r.b, r.cosine))
    assert set(near) == {*range(200), *(h[0] for h in hot)}
    assert [b for b, _ in near[0]] == [1000, 1001, 1002, 1003] and [b for b, _ in near[1299]] == [0, 1000, 1001, 1002]
    assert near[1][0] == (5000, pytest.approx(1.0)) and near[5000][0][0] == 1 and [b for b, _ in near[1][1:]] == [b for b, _ in near[5000][1:]]
    assert all(len(v) == 4 for v in near.values())


def test_few_and_none(spark):
    assert neighbours.nearest(_frame(spark, np.zeros((0, 16))), 3, dim=16).count() == 0
    assert neighbours.nearest(_frame(spark, np.ones((1, 16))), 3, dim=16).count() == 0
    two = neighbours.nearest(_frame(spark, np.eye(16)[:2]), 3, dim=16).collect()
    assert {(r.a, r.b) for r in two} == {(0, 1), (1, 0)}


def test_many_lists_in_two_levels(spark):
    x = _clusters(6000)
    got = neighbours.nearest(_frame(spark, x), 10, dim=16, list_rows=64, members=3, probes=6, member_ratio=1.4, probe_ratio=1.6, spread=0.0, max_centroids=12).collect()
    true = _truth(x, 10)
    assert sum(r.b in true[r.a] for r in got) / 60_000 >= 0.9
    assert {r.a for r in got} == set(range(6000)) and all(r.a != r.b for r in got)


def test_dense_lists_in_tiles_lose_nothing(spark, monkeypatch):
    x = np.r_[_clusters(300, seed=1), _clusters(1, seed=2) + 0.05 * np.random.default_rng(3).normal(size=(900, 16))]  # a dense ball
    rows = lambda: {(r.a, r.b) for r in neighbours.nearest(_frame(spark, x), 5, dim=16, list_rows=400, members=2, probes=3, spread=0.0, member_ratio=1.3, probe_ratio=1.5).collect()}
    whole = rows()
    monkeypatch.setattr(neighbours, "DENSE", 0.2)
    assert rows() == whole


def test_cosines_are_those_of_the_vectors(spark):
    x = _clusters(400, seed=6).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for r in neighbours.nearest(_frame(spark, x), 4, dim=16).collect():
        assert abs(r.cosine - u[r.a] @ u[r.b]) < 1e-6
    base = np.zeros((40, 16), np.float32)
    base[:, 0], base[:, 1] = 1, 0
    base[1:, 1] = np.tan(np.arccos(0.9 + np.linspace(-2e-5, 2e-5, 39)))  # the bound passes between them
    base[1:, 2:] = 0
    got = {(r.a, r.b) for r in neighbours.nearest(_frame(spark, base), 39, dim=16, min_cosine=0.9).collect()}
    v = base.astype(np.float64) / np.linalg.norm(base.astype(np.float64), axis=1, keepdims=True)
    for i in range(1, 40):
        if abs(v[0] @ v[i] - 0.9) > 1e-7:
            assert ((0, i) in got) == (v[0] @ v[i] >= 0.9)
