import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import vectors as V
from gaugeworks.operators import models, roc


def _data(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 4)) + y[:, None] * np.array([1.5, 0, -1, 0])
    return spark.createDataFrame([(f"{'Real' if i % 2 else 'gan'}/{i}", int(a), [float(v) for v in b], ["clean", "blur_2.0"][i % 2]) for i, (a, b) in enumerate(zip(y, x))], "path string, label int, feats array<float>, tag string")


def test_head_scores_and_sweep(spark):
    train, test = _data(spark), _data(spark, 300, 1)
    model = models.train_head(train, reg=0.01)
    auc = roc.auc(models.head_scores(model, test), [], "p").first().auc
    assert auc > 0.85
    rows = models.weights_row(model)
    assert len(rows) == 2 and len(rows[1][1]) == 4 and rows[0][2] == 0
    table = {r.arm: r.n_train for r in models.ablation(train, test, {"all": [], "real": ["Real"]}, 200, 1).collect()}
    assert table == {"all": 200, "real": 200}


def test_probe_grains(spark):
    tags = F.when(F.pmod(F.xxhash64("path"), F.lit(3)) == 0, "clean").when(F.pmod(F.xxhash64("path"), F.lit(3)) == 1, "blur_1.0").otherwise("blur_2.0")
    move = F.when(F.col("tag") == "clean", 0.0).when(F.col("tag") == "blur_1.0", 4.0).otherwise(8.0)
    d = _data(spark).withColumn("tag", tags).withColumn("feats", F.expr("transform(feats, x -> x)")).withColumn("_m", move)
    d = d.withColumn("feats", F.transform("feats", lambda x: (x + F.col("_m")).cast("float"))).drop("_m")
    p = models.probe(d, "tag", "path", iterations=40)
    told = {r.grain: r for r in models.probe_summary(p).collect()}
    assert set(told) == set(models.GRAINS) and all(r.accuracy > 0.85 for r in told.values()) and 0.3 < told["condition"].majority_share < 0.45 and told["family"].majority_share > 0.5
    c = models.confusion(p.filter("grain = 'condition'"), "label").collect()
    assert all(abs(sum(r.share for r in c if r.label == t) - 1) < 1e-9 for t in ("clean", "blur_1.0", "blur_2.0"))
    assert models.majority_share(d, "tag").first()[0] > 0.3


@pytest.mark.parametrize("loss,norm", [("ce", "none"), ("focal", "standardize"), ("focal", "l2")])
def test_gradients_are_those_of_the_loss(loss, norm):
    rng = np.random.default_rng(0)
    x, y, weight = rng.normal(size=(30, 5)), rng.integers(0, 2, 30), rng.uniform(0.5, 2, 30)
    w = rng.normal(size=(1, 6)) * 0.4
    heads = lambda v: models.Heads([models.setting(loss=loss, norm=norm, alpha=0.3, gamma=1.7)], v[:, :-1], v[:, -1], x.mean(0), x.std(0))
    _, by = heads(w).gradient(x, y, weight)
    for k in range(6):
        up, down = w.copy(), w.copy()
        up[0, k] += 1e-5
        down[0, k] -= 1e-5
        assert by[0, k] == pytest.approx((heads(up).gradient(x, y, weight)[0][0] - heads(down).gradient(x, y, weight)[0][0]) / 2e-5, rel=1e-4, abs=1e-6)


def test_heads_trained_together_learn_and_are_ranked(spark):
    train, test = _data(spark), _data(spark, 400, 1)
    settings = [models.setting(epochs=1, lr=1e-3), models.setting(epochs=15, lr=0.2), models.setting(epochs=15, lr=0.2, loss="focal", norm="standardize")]
    got = models.sweep_heads(train, test, settings).collect()
    assert [r.clean_auc for r in got] == sorted((r.clean_auc for r in got), reverse=True) and got[0].clean_auc > 0.85 and {r.worst_condition for r in got} == {"blur_2.0"}
    alone = models.fit_heads(train, settings[1:2])
    together = models.fit_heads(train.repartition(7), settings)
    assert np.allclose(alone.weights[0], together.weights[1], atol=1e-6)
    assert len(models.sweep_settings("reg")) == 40 and len(models.sweep_settings("norm")) == 3 and len(models.sweep_settings("loss")) == 6
    with pytest.raises(ValueError):
        models.fit_heads(train.filter("label = 1"), settings)
    assert [round(models.rate_factor(i, 10, 2), 3) for i in (0, 1, 2, 6, 10)] == [0.5, 1.0, 1.0, 0.5, 0.0]
    steps = spark.createDataFrame([(i,) for i in (0, 1, 2, 6)], "step int").select(V.cosine_warmup(F.col("step"), 10, 2).alias("f")).collect()
    assert [round(r.f, 3) for r in steps] == [0.5, 1.0, 1.0, 0.5]


def test_frozen_training_keeps_the_best_epoch(spark):
    train, val = _data(spark), _data(spark, 400, 1)
    clean, worse = val.filter("tag = 'clean'"), val.filter("tag <> 'clean'")
    head, history, summary = models.train_frozen([train, train], clean, worse, clean.filter("label = 0"), models.setting(epochs=6, lr=0.2))
    best = max(history, key=lambda h: h["val_robust"])
    assert len(history) == 6 and summary["best_epoch"] == best["epoch"] and summary["best_robust_val_auc"] == best["val_degraded"]
    assert summary["shortcut_gap"] == pytest.approx(0) and summary["clean_auc_primary"] > 0.85
    arms = {r.arm: r.n_train for r in models.draw_arms({"one": [train], "two": [train, train]}, val, models.setting(epochs=3, lr=0.2)).collect()}
    assert arms == {"one": 600, "two": 1200}


def test_views_epochs_and_limits(spark):
    a = spark.createDataFrame([("x", 0.2), ("y", 0.4)], "path string, p double")
    assert {r.path: r.p for r in models.two_views(a, a.withColumn("p", F.lit(1.0)), ["path"]).collect()} == {"x": pytest.approx(0.6), "y": pytest.approx(0.7)}
    with pytest.raises(ValueError):
        models.two_views(a, a.limit(1), ["path"])
    h = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "epoch int, val_robust double")
    assert models.best_epoch(h).first().epoch == 2
    big = lambda: models.Provider("big", 8, models.MAX_PARAMETERS, lambda p: None)
    small = lambda: models.Provider("stub", 2, 10, lambda p: np.stack([p["w"].to_numpy(), p["w"].to_numpy() * 2], 1).astype(np.float32))
    got = models.provider([big, small])
    assert got.name == "stub" and got.extract(spark.createDataFrame([("a", 3.0)], "path string, w double")).first().feats == [3.0, 6.0]
    models.self_test(0.5, 0.5004)
    with pytest.raises(AssertionError):
        models.self_test(0.5, 0.6)
