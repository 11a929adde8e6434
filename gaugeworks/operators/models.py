"""Heads over feature vectors: training, sweeps, ablation and the degradation probe, with spark.ml."""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from ..functions.strings import keep_any
from ..functions.vectors import column_stats, constant, standardize
from ..shipping import ship
from ..storage import save
from .grids import condition_key
from .roc import auc, metrics
from .sampling import class_weights, grouped_split, stratified_draws

MAX_PARAMETERS = 2_000_000_000


class Provider:
    """Where feature vectors come from: a function from picture batches to vectors, and its number of parameters."""

    def __init__(self, name: str, dim: int, parameters: int, run: Callable[[pd.DataFrame], np.ndarray]):
        if parameters >= MAX_PARAMETERS:
            raise ValueError(f"{name} has {parameters} parameters; {MAX_PARAMETERS} is the limit")
        self.name, self.dim, self.parameters, self.run = name, dim, parameters, run

    def extract(self, df: DataFrame, key: str = "path") -> DataFrame:
        """(key, feats): Arrow batches through the provider, loaded once in each Python worker."""
        run = self.run

        def batches(it):
            for p in it:
                yield pd.DataFrame({key: p[key], "feats": list(run(p))})

        return df.mapInPandas(batches, f"{key} string, feats array<float>")


def provider(wanted: list[Callable[[], Provider]]) -> Provider:
    """The first provider that can be set up; the others are its fallbacks."""
    for make in wanted[:-1]:
        try:
            return make()
        except (ValueError, RuntimeError, MemoryError):
            continue
    return wanted[-1]()


def train_head(df: DataFrame, features: str = "feats", label: str = "label", reg: float = 0.0, iterations: int = 50, family: str = "auto"):
    """Logistic regression with each class weighing the same."""
    weighted = df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)  # a row for each class
    ready = weighted.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"), "weight")
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=reg, maxIter=iterations, family=family).fit(ready)


def head_scores(model, df: DataFrame, features: str = "feats") -> DataFrame:
    """df with p, the chance of class 1."""
    out = model.transform(df.withColumn("_x", array_to_vector(F.col(features))).withColumnRenamed("_x", "features"))
    return out.withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")


def weights_row(model) -> list[tuple]:
    """[(class, weights, bias)]: a head as rows, to be kept in a table."""
    w = model.coefficientMatrix.toArray() if model.numClasses > 2 else np.stack([np.zeros(model.numFeatures), model.coefficients.toArray()])
    b = model.interceptVector.toArray() if model.numClasses > 2 else np.array([0.0, model.intercept])
    return [(i, [float(x) for x in row], float(bias)) for i, (row, bias) in enumerate(zip(w, b))]


def ablation(samples: DataFrame, test: DataFrame, arms: dict[str, list[str]], n: int, seed: int, features: str = "feats") -> DataFrame:
    """(arm, n_train, auc): for each arm keep the paths that contain any of its pieces, draw n in the class shares, train, test."""
    rows = []
    for arm, pieces in arms.items():
        own = stratified_draws(samples.filter(keep_any(F.col("path"), pieces)).withColumn("_draw", F.lit(0)), n, seed, "_draw").drop("_draw").persist()
        scored = head_scores(train_head(own, features), test, features)
        rows.append((arm, own.count(), auc(scored, [], "p").first()["auc"]))
        own.unpersist()
    return test.sparkSession.createDataFrame(rows, "arm string, n_train bigint, auc double")


def best_epoch(history: DataFrame, value: str = "val_robust") -> DataFrame:
    """The epoch of the highest value, the first one on ties."""
    return history.agg(F.max_by("epoch", F.struct(F.col(value), -F.col("epoch"))).alias("epoch"), F.max(value).alias(value))


#: Label granularities of the probe.
GRAINS = ("condition", "family", "degraded")


def grain(tag: Column, which: str) -> Column:
    """A condition tag as it is, as its family, or as clean or degraded."""
    if which == "condition":
        return tag
    family = condition_key(tag)[0]
    return family if which == "family" else F.when(family == "clean", "clean").otherwise("degraded")


def probe(df: DataFrame, tag: str, group: str, features: str = "feats", seed: int = 0, c: float = 0.1, iterations: int = 100, grains: tuple[str, ...] = GRAINS) -> DataFrame:
    """Predict which degradation a vector underwent: (grain, label, predicted, n) on the test third, whole groups on one side.

    Features are standardised by mean and population deviation of the training part. c weighs the summed loss against the
    penalty, so Spark's penalty on the mean loss is 1 / (c x rows). Labels are a small set.
    """
    d = save(grouped_split(df.select(tag, group, features), group, seed), "probe")
    train = d.filter("part = 'train'")
    stats = {r.pos: (r.mean, r.std) for r in column_stats(train, features).collect()}  # a row for each element
    if not stats:
        return df.sparkSession.createDataFrame([], "grain string, label string, predicted string, n bigint")
    mean, std = ([stats[i][k] for i in range(len(stats))] for k in (0, 1))
    ready = d.withColumn("features", array_to_vector(standardize(F.col(features), constant(mean), constant(std))))
    n = train.count()
    out = []
    for which in grains:
        named = ready.select("part", "features", grain(F.col(tag), which).alias("label")).filter("label is not null")
        names = [r[0] for r in named.select("label").distinct().orderBy("label").limit(1001).collect()]
        if len(names) > 1000:
            raise ValueError("more than 1000 labels")
        listed = F.array(*[F.lit(x) for x in names])
        own = named.withColumn("y", (F.array_position(listed, F.col("label")) - 1).cast("double"))
        model = LogisticRegression(labelCol="y", regParam=1 / (c * n), maxIter=iterations, family="multinomial").fit(own.filter("part = 'train'"))
        said = F.get(listed, F.col("prediction").cast("int"))
        out.append(model.transform(own.filter("part = 'test'")).select(F.lit(which).alias("grain"), "label", said.alias("predicted")).groupBy("grain", "label", "predicted").agg(F.count(F.lit(1)).alias("n")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def probe_summary(pairs: DataFrame) -> DataFrame:
    """(grain, accuracy, majority_share) of (grain, label, predicted, n)."""
    per = pairs.groupBy("grain", "label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    return per.groupBy("grain").agg((F.sum("right") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n")).alias("majority_share"))


def majority_share(df: DataFrame, label: str) -> DataFrame:
    """(majority_share): share of the most frequent label."""
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("majority_share"))


NORMS = ("none", "l2", "standardize")


class Heads:
    """Linear heads trained together: each setting has a weight vector, and one pass over the rows serves all of them."""

    def __init__(self, settings: list[dict], weights: np.ndarray, bias: np.ndarray, mean: np.ndarray, std: np.ndarray):
        self.settings, self.weights, self.bias, self.mean, self.std = settings, weights, bias, mean, std

    def inputs(self, x: np.ndarray) -> dict[str, np.ndarray]:
        made = {"none": lambda: x, "l2": lambda: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8), "standardize": lambda: (x - self.mean) / np.maximum(self.std, 1e-6)}
        return {n: made[n]() for n in {s["norm"] for s in self.settings}}

    def logits(self, x: np.ndarray) -> np.ndarray:
        given = self.inputs(x)
        out = np.empty((len(x), len(self.settings)))
        for n, y in given.items():
            own = [i for i, s in enumerate(self.settings) if s["norm"] == n]
            out[:, own] = y @ self.weights[own].T + self.bias[own]
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed losses of the settings, and their derivatives by weights and bias."""
        p = 1 / (1 + np.exp(-np.clip(self.logits(x), -60, 60)))
        t = y[:, None] >= 1
        pt = np.clip(np.where(t, p, 1 - p), 1e-12, 1 - 1e-12)
        gamma, alpha = (np.array([s[k] for s in self.settings]) for k in ("gamma", "alpha"))
        focal = np.array([s["loss"] == "focal" for s in self.settings])
        a = np.where(focal, np.where(t, alpha, 1 - alpha), 1.0)
        g = np.where(focal, gamma, 0.0)
        # d loss / d logit, the loss being -a (1 - pt)^g log pt
        slope = a * (1 - pt) ** g * (g * pt * np.log(pt) - (1 - pt)) * np.where(t, 1, -1) * weight[:, None]
        loss = (-a * (1 - pt) ** g * np.log(pt) * weight[:, None]).sum(0)
        by = np.zeros((len(self.settings), x.shape[1] + 1))
        for n, z in self.inputs(x).items():
            own = [i for i, s in enumerate(self.settings) if s["norm"] == n]
            by[own, :-1] = slope[:, own].T @ z
            by[own, -1] = slope[:, own].sum(0)
        return loss, by


def setting(**given) -> dict:
    """A head's training setting: norm, loss (ce or focal), gamma, alpha, wd, epochs, lr, warmup (epochs)."""
    return {"norm": "none", "loss": "ce", "gamma": 2.0, "alpha": 0.5, "wd": 0.01, "epochs": 10, "lr": 0.05, "warmup": 1} | given


def sweep_settings(kind: str) -> list[dict]:
    """Settings of a sweep over regularisation (40), normalisation (3) or loss (6)."""
    if kind == "reg":
        return [setting(wd=wd, epochs=e, lr=lr) for wd, e, lr in itertools.product([0.01, 0.1, 0.3, 1.0], [1, 2, 5, 10, 30], [1e-1, 1e-2])]
    if kind == "norm":
        return [setting(norm=n) for n in NORMS]
    if kind == "loss":
        return [setting(), *(setting(loss="focal", gamma=g) for g in (1.0, 2.0, 5.0, 10.0, 20.0))]
    raise ValueError(kind)


def rate_factor(step: int, total: int, warmup: int) -> float:
    """Factor of the learning rate: linear to 1 over the warm-up, then half a cosine."""
    return (step + 1) / warmup if step < warmup else 0.5 * (1 + math.cos(math.pi * (step - warmup) / max(1, total - warmup)))


def _matrix(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def fit_heads(df: DataFrame, settings: list[dict], features: str = "feats", label: str = "label", after: Callable[[int, Heads], None] | None = None) -> Heads:
    """Train a head for every setting by Adam with decoupled weight decay and a cosine schedule, each class weighing the same.

    Every epoch is one distributed pass: tasks send one summed gradient of all settings, so that what reaches the driver
    does not grow with the rows. Rows must have a label and vectors of one length. after(epoch, heads) sees each epoch.
    """
    rows = save(df.filter(F.col(label).isNotNull()).select(F.col(features).alias("x"), F.when(F.col(label) >= 1, 1).otherwise(0).alias("y")), "training")
    size = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        raise ValueError("training needs both classes")
    total = sum(size.values())
    stats = sorted(column_stats(rows, "x").collect())
    mean, std = (np.array([r[k] for r in stats]) for k in ("mean", "std"))
    dim, n = len(stats), len(settings)
    w = np.zeros((n, dim + 1))
    first, second = np.zeros_like(w), np.zeros_like(w)
    most = max(s["epochs"] for s in settings)
    heads = Heads(settings, w[:, :-1], w[:, -1], mean, std)
    for epoch in range(most):
        def passed(batches, heads=heads):
            loss, by = np.zeros(n), np.zeros((n, dim + 1))
            for b in batches:
                y = b.column("y").to_numpy(zero_copy_only=False)
                one, two = heads.gradient(_matrix(b, "x", dim), y, np.where(y >= 1, total / (2 * size[1]), total / (2 * size[0])))
                loss, by = loss + one, by + two
            yield pa.RecordBatch.from_arrays([pa.array([np.c_[loss, by].tobytes()], pa.binary())], names=["g"])

        sums = sum(np.frombuffer(bytes(r.g)).reshape(n, dim + 2) for r in rows.mapInArrow(passed, "g binary").collect())  # a row for each task
        g = sums[:, 1:] / total
        live = np.array([epoch < s["epochs"] for s in settings])[:, None]
        rate = np.array([s["lr"] * rate_factor(epoch, s["epochs"], s["warmup"]) if epoch < s["epochs"] else 0.0 for s in settings])[:, None]
        decay = np.array([s["wd"] for s in settings])[:, None]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = first / (1 - 0.9 ** (epoch + 1)) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        w = np.where(live, w * (1 - rate * decay) - rate * step, w)
        heads = Heads(settings, w[:, :-1], w[:, -1], mean, std)
        if after:
            after(epoch, heads)
    return heads


def heads_scores(heads: Heads, df: DataFrame, keep: list[str], features: str = "feats") -> DataFrame:
    """(keep, setting, p): a row for each row of df and setting."""
    dim = heads.weights.shape[1]
    kept = df.select(*keep).schema

    def run(batches):
        for b in batches:
            p = 1 / (1 + np.exp(-np.clip(heads.logits(_matrix(b, features, dim)), -60, 60)))
            k = p.shape[1]
            at = pa.array(np.repeat(np.arange(len(p)), k))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), pa.array(np.tile(np.arange(k, dtype=np.int32), len(p))), pa.array(p.ravel())], names=[*keep, "setting", "p"])

    return df.select(*keep, features).mapInArrow(run, kept.add("setting", IntegerType()).add("p", DoubleType()))


def sweep_heads(train: DataFrame, evaluation: DataFrame, settings: list[dict], features: str = "feats") -> DataFrame:
    """(setting columns, clean_auc, worst_condition, worst_auc, mean_degraded_auc), best first. evaluation: (tag, label, features)
    of the clean pictures and of every condition; each row is scored by all settings in one pass."""
    heads = fit_heads(train, settings, features)
    per = auc(heads_scores(heads, evaluation, ["tag", "label"], features), ["setting", "tag"], "p").filter("auc is not null")
    degraded = F.col("tag") != "clean"
    worst = F.min(F.when(degraded, F.struct("auc", "tag")))
    found = per.groupBy("setting").agg(F.max(F.when(~degraded, F.col("auc"))).alias("clean_auc"), worst.alias("w"), F.avg(F.when(degraded, F.col("auc"))).alias("mean_degraded_auc"))
    rows = [(i, s["norm"], s["loss"], float(s["gamma"]) if s["loss"] == "focal" else None, float(s["wd"]), int(s["epochs"]), float(s["lr"])) for i, s in enumerate(settings)]
    named = train.sparkSession.createDataFrame(rows, "setting int, norm string, loss string, gamma double, wd double, epochs int, lr double")
    out = named.join(found, "setting").select("setting", "norm", "loss", "gamma", "wd", "epochs", "lr", "clean_auc", F.col("w.tag").alias("worst_condition"), F.col("w.auc").alias("worst_auc"), "mean_degraded_auc")
    return out.orderBy(F.desc("clean_auc"), "setting")


def train_frozen(draws: list[DataFrame], clean: DataFrame, degraded: DataFrame, alternative: DataFrame, given: dict | None = None, features: str = "feats") -> tuple[Heads, list[dict], dict]:
    """Train one head on the union of cached draws; (best head, history, summary).

    After each epoch: AUC on the training rows, on the clean validation set and on its degraded copy. The head of the highest
    degraded AUC is kept, the first on ties. The summary compares fakes against the validation's reals with fakes
    against alternative reals; the difference is the shortcut gap.
    """
    given = given or setting()
    train = save(union_all(draws), "draws")
    sets = {"train": train, "clean": clean, "degraded": degraded}
    every = save(union_all([d.filter("label is not null").select(F.lit(k).alias("part"), "label", features) for k, d in sets.items()]), "parts")
    history, best = [], None

    def after(epoch, heads):
        nonlocal best
        found = {r.part: r.auc for r in auc(heads_scores(heads, every, ["part", "label"], features), ["part"], "p").collect()}
        robust = found.get("degraded") if found.get("degraded") is not None else found.get("clean")
        history.append({"epoch": epoch, "train_auc": found.get("train"), "val_clean": found.get("clean"), "val_degraded": found.get("degraded"), "val_robust": robust})
        if robust is not None and (best is None or robust > best[0]):
            best = (robust, epoch, heads)

    fit_heads(train, [given], features, after=after)
    if best is None:
        raise ValueError("the validation sets lack a class")
    fakes = clean.filter("label >= 1").select("label", features)
    rows = union_all([fakes.unionByName(reals.filter("label = 0").select("label", features)).withColumn("part", F.lit(k)) for k, reals in (("primary", clean), ("alternative", alternative))])
    found = {r.part: r.auc for r in auc(heads_scores(best[2], rows, ["part", "label"], features), ["part"], "p").collect()}
    primary, other = found.get("primary"), found.get("alternative")
    summary = {"clean_auc_primary": primary, "clean_auc_alternative": other, "best_robust_val_auc": best[0], "best_epoch": best[1], "shortcut_gap": None if primary is None or other is None else primary - other}
    return best[2], history, summary


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


def draw_arms(arms: dict[str, list[DataFrame]], evaluation: DataFrame, given: dict | None = None, features: str = "feats") -> DataFrame:
    """(arm, n_train, clean_auc, worst_condition, worst_auc, mean_degraded_auc): a head for each arm, trained on the union of
    its draws. With the same number of draws in two arms, volume is controlled for."""
    out = []
    for name, draws in arms.items():
        train = save(union_all([d.select("label", features) for d in draws]), "arm")
        out.append(sweep_heads(train, evaluation, [given or setting()], features).select(F.lit(name).alias("arm"), F.lit(train.count()).alias("n_train"), "clean_auc", "worst_condition", "worst_auc", "mean_degraded_auc"))
    return union_all(out)


def confusion(pairs: DataFrame, label: str, predicted: str = "predicted", n: str = "n") -> DataFrame:
    """(label, predicted, n, share): confusion counts, normalised by row."""
    from pyspark.sql.window import Window

    return pairs.groupBy(label, predicted).agg(F.sum(n).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def two_views(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """Mean of the scores of two views of each sample; both must have exactly the same keys."""
    sides = first.select(*on, F.lit(1).alias("_side")).unionByName(second.select(*on, F.lit(-1).alias("_side")))
    if not sides.groupBy(*on).agg(F.sum("_side").alias("_odd")).filter("_odd <> 0").isEmpty():
        raise ValueError("the views hold different samples")
    return first.join(second.select(*on, F.col("p").alias("_q")), on).withColumn("p", (F.col("p") + F.col("_q")) / 2).drop("_q")


def self_test(got: float, stated: float, tolerance: float = 1e-3) -> None:
    if abs(got - stated) > tolerance:
        raise AssertionError(f"score {got} differs from the stated {stated}")


ship(sys.modules[__name__])
