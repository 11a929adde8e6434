"""Condition grids: AUC of each condition against the primary and the alternative reals, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import save
from .roc import metrics


def condition_key(spelling: Column) -> tuple[Column, Column]:
    """Name and numeric level of a condition spelt with any separator, letter case and number format."""
    low = F.lower(F.trim(F.regexp_replace(spelling, r"\s+", " ")))
    return F.regexp_extract(low, r"^([^0-9@_:= -]+)", 1), F.regexp_extract(low, r"([0-9]+\.?[0-9]*|\.[0-9]+)$", 1).try_cast("double")


def with_tag(df: DataFrame, conditions: DataFrame, column: str = "condition") -> DataFrame:
    """Add `tag` and `ord` of the condition that a spelling names; rows that name none are left out."""
    level = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    names = conditions.select("ord", "tag", F.lower("transform").alias("_t"), level(F.col("level").try_cast("double")).alias("_l"))
    name, number = condition_key(F.col(column))
    return df.withColumn("_t", name).withColumn("_l", level(number)).join(names, ["_t", "_l"]).drop("_t", "_l")


def auc_grid(scored: DataFrame, real_set: str = "real_set") -> DataFrame:
    """A row for each condition: AUC, errors, accuracies against primary and alternative reals, deltas to clean and the gap.

    scored: (tag, ord, score, label, real_set); real_set is 'alt' for alternative reals, anything else is primary;
    positives belong to both comparisons, so they are doubled before one grouped pass.
    """
    sides = F.when(F.col("label") >= 1, F.array(F.lit("coco"), F.lit("alt"))).when(F.col(real_set) == "alt", F.array(F.lit("alt"))).otherwise(F.array(F.lit("coco")))
    m = metrics(scored.withColumn("side", F.explode(sides)), ["tag", "ord", "side"])
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    d = m.groupBy("tag", "ord").agg(
        side("coco", "auc").alias("auc_primary"), side("alt", "auc").alias("auc_alt"), side("coco", "err").alias("err_primary"), side("alt", "err").alias("err_alt"), side("coco", "bal_acc").alias("bal_acc"), side("coco", "acc").alias("acc"),
        side("coco", "majority_baseline").alias("majority_baseline"), F.coalesce(side("coco", "n_fake"), side("alt", "n_fake")).alias("n_fake"), F.coalesce(side("coco", "n_real"), F.lit(0)).alias("n_real_primary"), F.coalesce(side("alt", "n_real"), F.lit(0)).alias("n_real_alt"))
    whole = Window.partitionBy()  # a row for each condition
    clean = lambda c: F.max(F.when(F.col("tag") == "clean", F.col(c))).over(whole)
    return d.select("*", (clean("auc_primary") - F.col("auc_primary")).alias("delta_primary"), (clean("auc_alt") - F.col("auc_alt")).alias("delta_alt"), (F.col("auc_primary") - F.col("auc_alt")).alias("shortcut_gap"))


def grid_summary(grid: DataFrame) -> DataFrame:
    """Clean AUC, worst degraded condition (the first on ties), largest delta, mean degraded AUC and the AUC that a
    checkpoint is chosen by: the mean over degraded conditions, or clean where there are none."""
    degraded = F.when((F.col("tag") != "clean") & F.col("auc_primary").isNotNull(), F.struct("auc_primary", "ord", "tag"))
    d = grid.agg(F.max(F.when(F.col("tag") == "clean", F.col("auc_primary"))).alias("clean_auc"), F.min(degraded).alias("w"), F.max(F.when(F.col("tag") != "clean", F.col("delta_primary"))).alias("max_delta"), F.avg(F.when(F.col("tag") != "clean", F.col("auc_primary"))).alias("mean_degraded_auc"))
    return d.select("clean_auc", F.col("w.tag").alias("worst_condition"), F.col("w.auc_primary").alias("worst_auc"), "max_delta", "mean_degraded_auc", F.coalesce("mean_degraded_auc", "clean_auc").alias("robust_auc"))


def expand_conditions(samples: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every sample under every condition: the conditions (a fixed table of a few rows) are collected and exploded in
    place, which needs no join."""
    rows = conditions.select("ord", "transform", "level", "tag").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("conditions has more than 1000 rows")
    item = F.array(*[F.struct(F.lit(r.ord).cast("int").alias("ord"), F.lit(r.transform).cast("string").alias("transform"), F.lit(r.level).cast("string").alias("level"), F.lit(r.tag).cast("string").alias("tag")) for r in rows])
    return samples.select("*", F.inline(item))


def paired(clean: DataFrame, degraded: DataFrame, on: str = "path") -> DataFrame:
    """(on, label, clean, degraded): two scored tables (on, label, score) of the same pictures, row for row. A picture that only
    one of them has, has twice, or has with another label is an error."""
    side = lambda d, k: d.groupBy(on).agg(F.count(F.lit(1)).alias(f"_n{k}"), F.min("label").alias(f"_l{k}"), F.max("label").alias(f"_m{k}"), F.min("score").alias(f"_s{k}"))
    both = save(side(clean, 0).join(side(degraded, 1), on, "full"), "paired")
    good = (F.col("_n0") == 1) & (F.col("_n1") == 1) & F.col("_l0").eqNullSafe(F.col("_l1"))
    wrong = both.filter(~F.coalesce(good, F.lit(False))).limit(10).collect()
    if wrong:
        raise ValueError(f"the tables do not hold the same pictures: {[r[on] for r in wrong]}")
    return both.select(on, F.col("_l0").alias("label"), F.col("_s0").alias("clean"), F.col("_s1").alias("degraded"))


def counterfactual(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-class controls of (label, clean, degraded) scores: AUC with none, both, only fakes, only reals degraded, and the
    share of reals flagged (score > threshold). The four columns become rows of one grouped pass."""
    views = {"clean": ("clean", "clean"), "both": ("degraded", "degraded"), "fakes_only": ("degraded", "clean"), "reals_only": ("clean", "degraded")}
    rows = F.array(*[F.struct(F.lit(v).alias("view"), F.when(F.col("label") >= 1, F.col(f)).otherwise(F.col(r)).alias("score")) for v, (f, r) in views.items()])
    long = save(df.select("label", F.inline(rows)), "views")
    flagged = long.filter("label = 0").groupBy("view").agg(F.avg(F.when(F.col("score") > threshold, 1.0).otherwise(0.0)).alias("reals_flagged"))
    return metrics(long, ["view"]).select("view", "n_fake", "n_real", "auc").join(flagged, "view", "left")


def top_errors(scored: DataFrame, k: int = 20) -> DataFrame:
    """The k reals of highest and the k fakes of lowest score over all conditions, ties by condition order, then path and id."""
    tie = [F.col("ord"), F.col("path"), F.col("err_id")]
    reals = scored.filter("label = 0").orderBy(F.desc("score"), *tie).limit(k)
    fakes = scored.filter("label >= 1").orderBy("score", *tie).limit(k)
    return reals.unionByName(fakes)
