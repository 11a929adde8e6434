"""Exact, tie-aware ROC statistics by grouped counts of distinct scores.

Everything starts from score_counts: one row for each group and distinct score with its numbers of positives and
negatives, so the shuffle carries pre-aggregated counts and never a row per sample. Running totals go in two levels
(cumulate): score ranges first, then inside each range, so that neither a hot group nor the ungrouped case ends up in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import save

#: Counts up to which running totals go in one level, a group's in one task.
ONE_TASK = 500_000
#: Score ranges of the two-level running totals; scores outside 0 to 1 fall to the outermost ranges.
RANGES = 1024


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def score_counts(df: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(group, score, pos, neg). Rows with a null label, a null or NaN score take no part. -0.0 counts as 0.0."""
    used = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    return used.groupBy(*group, (F.col(score) + F.lit(0.0)).alias("score")).agg(count_if(F.col(label) >= 1).alias("pos"), count_if(F.col(label) == 0).alias("neg"))


def _range(c: str, lower: float = 0.0, upper: float = 1.0) -> Column:
    return F.greatest(F.lit(-1), F.least(F.lit(RANGES), F.floor((F.col(c) - lower) / (upper - lower) * RANGES))).cast("int")


def cumulate(counts: DataFrame, group: list[str], columns: list[str], lower: float = 0.0, upper: float = 1.0) -> DataFrame:
    """Add, for each column, <column>_below (its sum over strictly smaller scores of the group) and <column>_all. The counts
    are written first: what they are made of is read once, and their number tells whether two levels are needed."""
    counts = save(counts, "counts")
    if counts.count() <= ONE_TASK:
        own = Window.partitionBy(*group)
        below = own.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("*", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in columns], *[F.sum(c).over(own).alias(f"{c}_all") for c in columns])
    d = counts.withColumn("_range", _range("score", lower, upper))
    per = d.groupBy(*group, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    per = per.select(*group, "_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in columns], *[F.sum(f"_{c}").over(whole).alias(f"{c}_all") for c in columns])
    inside = Window.partitionBy(*group, "_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}_inside") for c in columns])
    on = [d[g].eqNullSafe(per[g]) for g in [*group, "_range"]]
    out = d.join(per, on)
    return out.select(*[d[c] for c in counts.columns], *[(F.col(f"_{c}_before") + F.col(f"_{c}_inside")).alias(f"{c}_below") for c in columns], *[F.col(f"{c}_all") for c in columns])


def auc(df: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(group, n_pos, n_neg, auc): chance that a positive scores above a negative, ties counting one half; null when a
    group has one class only."""
    c = cumulate(score_counts(df, group, score, label), group, ["neg"])
    part = F.col("pos") * (F.col("neg_below") + F.col("neg") * F.lit(0.5))
    out = c.groupBy(*group).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(part).alias("_u"))
    value = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg")))
    return out.select(*group, "n_pos", "n_neg", value.alias("auc"))


def metrics(df: DataFrame, group: list[str], score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """n, n_fake, n_real and, where both classes are present, auc, err, accuracy, balanced accuracy and majority baseline."""
    c = cumulate(score_counts(df, group, score, label), group, ["neg"])
    high = F.col("score") >= threshold
    d = c.groupBy(*group).agg(
        F.sum("pos").alias("n_fake"), F.sum("neg").alias("n_real"), F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * F.lit(0.5))).alias("_u"),
        F.sum(F.when(high, F.col("pos")).otherwise(0)).alias("_tp"), F.sum(F.when(high, 0).otherwise(F.col("neg"))).alias("_tn"))
    n = F.col("n_fake") + F.col("n_real")
    both = (F.col("n_fake") > 0) & (F.col("n_real") > 0)
    value = F.col("_u") / (F.col("n_fake") * F.col("n_real"))
    return d.select(
        *group, n.alias("n"), "n_fake", "n_real", F.when(both, value).alias("auc"), F.when(both, 1 - value).alias("err"), F.when(both, (F.col("_tp") + F.col("_tn")) / n).alias("acc"),
        F.when(both, (F.col("_tp") / F.col("n_fake") + F.col("_tn") / F.col("n_real")) / 2).alias("bal_acc"), F.when(both, F.greatest("n_fake", "n_real") / n).alias("majority_baseline"))


def roc_curve(df: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(group, threshold, tp, fp, tpr, fpr): the ROC point of every distinct score, a sample being flagged at score >= threshold."""
    c = cumulate(score_counts(df, group, score, label), group, ["pos", "neg"])
    tp, fp = F.col("pos_all") - F.col("pos_below"), F.col("neg_all") - F.col("neg_below")
    return c.select(*group, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), F.when(F.col("pos_all") > 0, tp / F.col("pos_all")).alias("tpr"), F.when(F.col("neg_all") > 0, fp / F.col("neg_all")).alias("fpr"))


def roc_vertices(curve: DataFrame, group: list[str]) -> DataFrame:
    """ROC points without those on a straight line between their neighbours; first and last stay.

    A point between others is dropped if the steps before and after it have the same number of positives and of negatives.
    Neighbours are found in two levels, as in cumulate: within a score range, and across ranges from each range's end points.
    """
    d = curve.withColumn("_range", _range("threshold"))
    point = F.struct("tp", "fp")
    per = d.groupBy(*group, "_range").agg(F.max_by(point, "threshold").alias("_high"), F.min_by(point, "threshold").alias("_low"))
    across = Window.partitionBy(*group).orderBy(F.desc("_range"))  # at most RANGES + 2 rows a group
    per = per.select(*group, "_range", F.lag("_low").over(across).alias("_before"), F.lead("_high").over(across).alias("_after"))
    inside = Window.partitionBy(*group, "_range").orderBy(F.desc("threshold"))
    d = d.select("*", F.lag(point).over(inside).alias("_lag"), F.lead(point).over(inside).alias("_lead"))
    on = [d[g].eqNullSafe(per[g]) for g in [*group, "_range"]]
    before, after = F.coalesce("_lag", "_before"), F.coalesce("_lead", "_after")
    step = lambda c: (after[c] - d[c]) - (d[c] - before[c])
    d = d.join(per, on).select(*[d[c] for c in curve.columns], step("tp").alias("_t"), step("fp").alias("_f"))
    return d.filter(F.col("_t").isNull() | (F.col("_t") != 0) | (F.col("_f") != 0)).drop("_t", "_f")


def operating_points(curve: DataFrame, group: list[str], rates: list[float] = [0.001, 0.01, 0.05]) -> DataFrame:  # noqa: B006
    """For each false-positive rate, the last ROC vertex that does not exceed it: (group, max_fpr, threshold, fpr, tpr).

    Below the first vertex nothing is flagged: threshold null, both rates 0. A rate of a class that the group lacks is null.
    """
    best = [F.max(F.when(F.col("fpr") <= r, F.struct("fpr", "tpr", (-F.col("threshold")).alias("t")))).alias(f"_b{i}") for i, r in enumerate(rates)]
    v = roc_vertices(curve, group).groupBy(*group).agg(*best, F.max("fpr").alias("_f"), F.max("tpr").alias("_t"))
    d = v.select(*group, "_f", "_t", F.explode(F.array(*[F.struct(F.lit(float(r)).alias("max_fpr"), F.col(f"_b{i}").alias("b")) for i, r in enumerate(rates)])).alias("r"))
    rate = lambda c, known: F.when(F.col(known).isNotNull(), F.coalesce(f"r.b.{c}", F.lit(0.0))).alias(c)
    return d.select(*group, "r.max_fpr", (-F.col("r.b.t")).alias("threshold"), rate("fpr", "_f"), rate("tpr", "_t"))


def threshold_table(df: DataFrame, group: list[str], thresholds: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """(group, threshold, fpr, tpr) at fixed thresholds, score >= threshold being flagged: one aggregate over the counts."""
    c = score_counts(df, group, score, label)
    sums = [F.sum("pos").alias("_p"), F.sum("neg").alias("_n")]
    for i, t in enumerate(thresholds):
        high = F.col("score") >= t
        sums += [F.sum(F.when(high, F.col("pos")).otherwise(0)).alias(f"_p{i}"), F.sum(F.when(high, F.col("neg")).otherwise(0)).alias(f"_n{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_n{i}").alias("fp"), F.col(f"_p{i}").alias("tp")) for i, t in enumerate(thresholds)])).alias("r")
    d = c.groupBy(*group).agg(*sums).select(*group, "_p", "_n", rows)
    return d.select(*group, "r.threshold", F.when(F.col("_n") > 0, F.col("r.fp") / F.col("_n")).alias("fpr"), F.when(F.col("_p") > 0, F.col("r.tp") / F.col("_p")).alias("tpr"))


def fpr_curve(df: DataFrame, points: int = 201, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, fpr) on evenly spaced thresholds from 0 to 1: each negative adds to the points up to its score.

    A histogram of the points that a score just reaches, then a running sum over the `points` rows.
    """
    counts = save(score_counts(df, [], score, label), "counts")
    c = counts.filter((F.col("neg") > 0) & (F.col("score") >= 0))
    last = F.least(F.floor(F.col("score") * (points - 1)), F.lit(points - 1)).cast("int")
    up = F.when((last + 1) / F.lit(points - 1) <= F.col("score"), last + 1).otherwise(F.when(last / F.lit(points - 1) > F.col("score"), last - 1).otherwise(last))
    per = c.groupBy(F.least(up, F.lit(points - 1)).alias("i")).agg(F.sum("neg").alias("n"))
    total = counts.agg(F.sum("neg").alias("total"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    w = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # `points` rows
    d = grid.join(per, "i", "left").select("i", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n"))
    return d.crossJoin(total).select((F.col("i") / F.lit(points - 1)).alias("threshold"), (F.col("n") / F.col("total")).alias("fpr"))  # total: one row


def auc_vs_all_negatives(df: DataFrame, group: str, score: str = "score", label: str = "label", least: int = 20, first: str | None = None) -> DataFrame:
    """(group, n_fake, auc, mean_score), lowest AUC first: AUC of each group's positives against all negatives; groups under
    `least` are left out. first: a column that describes the group, of which the smallest value is handed on.

    One table of counts by group and score serves both sides: the negatives of all groups are added up for each distinct
    score, and their share below it is joined to the groups' counts, so that negatives are never repeated for each group.
    """
    used = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
    more = [F.min(first).alias(first)] if first else []
    counts = save(used.groupBy(group, (F.col(score) + F.lit(0.0)).alias("score")).agg(count_if(F.col(label) >= 1).alias("pos"), count_if(F.col(label) == 0).alias("neg"), *more), "counts")
    every = counts.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    c = cumulate(every, [], ["neg"]).select("score", ((F.col("neg_below") + F.col("neg") * F.lit(0.5)) / F.col("neg_all")).alias("beats"))
    d = counts.filter("pos > 0").join(c, "score").groupBy(group).agg(F.sum("pos").alias("n_fake"), (F.sum(F.col("pos") * F.col("beats")) / F.sum("pos")).alias("auc"), (F.sum(F.col("pos") * F.col("score")) / F.sum("pos")).alias("mean_score"), *more)
    return d.filter(F.col("n_fake") >= least).orderBy("auc", group)
