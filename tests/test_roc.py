import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.functions import vectors as V
from gaugeworks.operators import grids, roc

S = "g string, score double, label int"


def _auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


@settings(max_examples=12, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from([-1.0, 0.0, 0.25, 0.5, 0.5004, 1.0, 7.0]), st.integers(0, 1)), max_size=40))
def test_auc_matches_pairs(spark, rows):
    got = roc.auc(spark.createDataFrame([("a", s, y) for s, y in rows], S), []).collect()
    want = _auc(rows)
    assert (got[0].auc if got else None) == (pytest.approx(want) if want is not None else None)


def test_groups_single_class_nulls(spark):
    rng = random.Random(0)
    rows = [("a", rng.random(), rng.randrange(2)) for _ in range(300)] + [("one", 0.5, 1), ("one", 0.6, 1), ("nul", None, 1), ("nul", 0.4, None), ("nul", float("nan"), 0), (None, 0.1, 0), (None, 0.2, 1)]
    got = {r.g: r for r in roc.metrics(spark.createDataFrame(rows, S), ["g"]).collect()}
    assert got["a"].auc == pytest.approx(_auc([r[1:] for r in rows[:300]]))
    assert got["one"].auc is None and got["one"].acc is None and got["one"].n == 2
    assert got[None].auc == 1 and "nul" not in got
    assert got["a"].acc == pytest.approx(sum((s >= 0.5) == (y == 1) for _, s, y in rows[:300]) / 300)


def test_vertices_drop_collinear_points_and_operating_points(spark):
    rows = [("a", s, y) for s, y in [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.5, 0), (0.5, 1), (0.4, 0), (0.3, 0)]]
    curve = roc.roc_curve(spark.createDataFrame(rows, S), [])
    assert [(r.threshold, r.tp, r.fp) for r in curve.orderBy(F.desc("threshold")).collect()] == [(0.9, 1, 0), (0.8, 2, 0), (0.7, 2, 1), (0.6, 3, 1), (0.5, 4, 2), (0.4, 4, 3), (0.3, 4, 4)]
    kept = [r.threshold for r in roc.roc_vertices(curve, []).orderBy(F.desc("threshold")).collect()]
    assert kept == [0.9, 0.8, 0.7, 0.6, 0.5, 0.3]
    ops = {r.max_fpr: (r.threshold, r.fpr, r.tpr) for r in roc.operating_points(curve, [], [0.0, 0.3, 0.8]).collect()}
    assert ops == {0.0: (0.8, 0, 0.5), 0.3: (0.6, 0.25, 0.75), 0.8: (0.5, 0.5, 1.0)}
    nothing = roc.operating_points(roc.roc_curve(spark.createDataFrame([("a", 0.9, 0), ("a", 0.1, 1)], S), []), [], [0.01]).first()
    assert (nothing.threshold, nothing.fpr, nothing.tpr) == (None, 0, 0)


def test_thresholds_and_fpr_curve(spark):
    rng = random.Random(1)
    rows = [("a", round(rng.random(), 2), rng.randrange(2)) for _ in range(400)] + [("a", 1.0, 0), ("a", 0.0, 0)]
    df = spark.createDataFrame(rows, S)
    neg, pos = [s for _, s, y in rows if not y], [s for _, s, y in rows if y]
    for r in roc.threshold_table(df, ["g"], [0.1, 0.5]).collect():
        assert r.fpr == pytest.approx(sum(s >= r.threshold for s in neg) / len(neg)) and r.tpr == pytest.approx(sum(s >= r.threshold for s in pos) / len(pos))
    curve = roc.fpr_curve(df).collect()
    assert len(curve) == 201 and all(r.fpr == pytest.approx(sum(s >= r.threshold for s in neg) / len(neg)) for r in curve)


def test_group_floor_19_and_20(spark):
    rows = [("x", 0.9, 1)] * 19 + [("y", 0.7, 1)] * 20 + [(None, 0.8, 0), (None, 0.1, 0)]
    got = roc.auc_vs_all_negatives(spark.createDataFrame(rows, S), "g").collect()
    assert [(r.g, r.n_fake, r.auc) for r in got if r.g] == [("y", 20, 0.5)]


def test_grid_and_summary(spark):
    rows = [("clean", 0, 0.9, 1, "primary"), ("clean", 0, 0.1, 0, "primary"), ("clean", 0, 0.2, 0, "alt"), ("jpeg_90", 1, 0.3, 1, "primary"), ("jpeg_90", 1, 0.5, 0, "primary"), ("jpeg_90", 1, 0.2, 0, "alt")]
    g = grids.auc_grid(spark.createDataFrame(rows, "tag string, ord int, score double, label int, real_set string"))
    d = {r.tag: r for r in g.collect()}
    assert (d["clean"].auc_primary, d["clean"].auc_alt, d["jpeg_90"].auc_primary, d["jpeg_90"].auc_alt, d["jpeg_90"].delta_primary, d["jpeg_90"].shortcut_gap) == (1, 1, 0, 1, 1, -1)
    s = grids.grid_summary(g).first()
    assert (s.worst_condition, s.max_delta, s.robust_auc) == ("jpeg_90", 1, 0)
    only = grids.grid_summary(g.filter("tag = 'clean'")).first()
    assert only.robust_auc == 1 and only.worst_condition is None


def test_counterfactual_uses_strict_threshold(spark):
    rows = [(1, 0.9, 0.2), (0, 0.5, 0.6)]
    got = {r.view: (r.auc, r.reals_flagged) for r in grids.counterfactual(spark.createDataFrame(rows, "label int, clean double, degraded double")).collect()}
    assert got == {"clean": (1, 0), "both": (0, 1), "fakes_only": (0, 0), "reals_only": (1, 1)}


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    got = df.select(V.norm(F.col("v")).alias("n"), V.l2_normalize(F.col("v")).alias("u"), V.dot(F.col("v"), V.constant([1, 2])).alias("d"), V.two_logit_score(F.col("v"), [[0, 0], [1, -1]], [0, 1]).alias("p")).collect()
    assert got[0].n == 5 and got[0].u == pytest.approx([0.6, 0.8]) and got[0].d == 11 and got[0].p == pytest.approx(0.5)
    assert got[1].u == [0, 0] and got[2].n is None
    use = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), (None,)], "v array<float>").select(V.usable(F.col("v"), 2).alias("u")).collect()
    assert [bool(r.u) for r in use] == [True, False, False, False, False, False]
    c = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "p double").select(V.clamp(F.col("p")).alias("c")).collect()
    assert [r.c for r in c] == [0, 1, None]


def _vertices(rows):
    """Brute force: (threshold, tp, fp) of the vertices of one curve."""
    points = [(t, sum(s >= t and y == 1 for s, y in rows), sum(s >= t and y == 0 for s, y in rows)) for t in sorted({s for s, _ in rows}, reverse=True)]
    inner = lambda i: 0 < i < len(points) - 1 and all(points[i + 1][k] - points[i][k] == points[i][k] - points[i - 1][k] for k in (1, 2))
    return {p for i, p in enumerate(points) if not inner(i)}


def test_vertices_need_no_global_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([-1.0, 2.0, 0.5, round(rng.random(), 4), round(rng.random() / 500, 6)]), rng.randrange(2)) for _ in range(1500)] + [(None, 0.2, 1), (None, 0.1, 1), (None, 0.05, 1)]
    df = spark.createDataFrame(rows, S)
    flat = roc.roc_vertices(roc.roc_curve(df, []), [])
    assert "windowspecdefinition(threshold" not in flat._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.threshold, r.tp, r.fp) for r in flat.collect()} == _vertices([r[1:] for r in rows])
    got = roc.roc_vertices(roc.roc_curve(df, ["g"]), ["g"]).collect()
    for g in ("a", "b", None):
        assert {(r.threshold, r.tp, r.fp) for r in got if r.g == g} == _vertices([r[1:] for r in rows if r[0] == g])


def test_operating_points_of_one_class(spark):
    rows = [("p", 0.9, 1), ("n", 0.9, 0), ("n", 0.1, 0)]
    got = {r.g: (r.threshold, r.fpr, r.tpr) for r in roc.operating_points(roc.roc_curve(spark.createDataFrame(rows, S), ["g"]), ["g"], [0.5]).collect()}
    assert got == {"p": (None, None, 0), "n": (0.9, 0.5, None)}
