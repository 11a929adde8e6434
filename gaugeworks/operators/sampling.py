"""Seeded sampling and splits. The order is md5(seed || key), never a row's position: inserting rows changes no other draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffled(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.col(key)))


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = "path") -> DataFrame:
    """n rows (all if there are fewer), in the order of the key. A top-n by hash: each task keeps n rows at most."""
    return df.orderBy(shuffled(seed, key), key).limit(n).orderBy(key)


def stratified_sample(df: DataFrame, n: int, seed: int, key: str = "path", label: str = "label") -> DataFrame:
    """About n rows with the class shares of df: each class gets n x share, rounded half to even; the largest label the rest."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c").over(Window.partitionBy())  # a row for each class
    per = per.withColumn("_quota", F.bround(F.lit(n) * F.col("_c") / total).cast("long"))
    last = F.row_number().over(Window.partitionBy().orderBy(F.desc(label))) == 1
    per = per.withColumn("_quota", F.when(last, F.lit(n) - (F.sum("_quota").over(Window.partitionBy()) - F.col("_quota"))).otherwise(F.col("_quota")))
    return _take(df, per, seed, key, [label])


def stratified_draws(df: DataFrame, n: int, seed: int, draw: str, key: str = "path", label: str = "label") -> DataFrame:
    """For each draw and class min(size, round(n x size / draw size)) rows without replacement."""
    per = df.groupBy(draw, label).agg(F.count(F.lit(1)).alias("_c"))
    share = F.bround(F.lit(n) * F.col("_c") / F.sum("_c").over(Window.partitionBy(draw)))
    return _take(df, per.withColumn("_quota", F.least(F.col("_c"), share.cast("long"))), seed, key, [draw, label])


def _take(df: DataFrame, per: DataFrame, seed: int, key: str, by: list[str]) -> DataFrame:
    """The first _quota rows of each class. Ranks go in two levels, the leading digits of the hash first, so that a class
    of any size spreads over 4096 ranges instead of being sorted in one task."""
    d = df.withColumn("_h", shuffled(seed, key)).withColumn("_range", F.substring("_h", 1, 3))
    ranges = d.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*[F.col(b).alias(f"_q_{b}") for b in by], F.col("_range").alias("_q_range"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    quotas = per.select(*[F.col(b).alias(f"_p_{b}") for b in by], "_quota")
    ranges = ranges.join(F.broadcast(quotas), [F.col(f"_q_{b}").eqNullSafe(F.col(f"_p_{b}")) for b in by]).filter(F.col("_before") < F.col("_quota"))  # quotas: a row for each class
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_h", key)))
    on = [F.col(b).eqNullSafe(F.col(f"_q_{b}")) for b in by] + [F.col("_range") == F.col("_q_range")]
    return d.join(ranges, on).filter(F.col("_before") + F.col("_n") <= F.col("_quota")).select(*df.columns)


def grouped_split(df: DataFrame, group: str, seed: int, part: float = 1 / 3) -> DataFrame:
    """Add `part`: the first floor(part x groups) groups in the order of a hash go to 'test', whole, the others to 'train'.
    Rows of a null group go to 'train'."""
    groups = df.select(F.col(group).cast("string").alias("_group")).filter("_group is not null").distinct().withColumn("_all", F.lit(0))
    quota = groups.groupBy("_all").agg(F.floor(F.count(F.lit(1)) * F.lit(part) + F.lit(1e-9)).cast("long").alias("_quota"))
    test = _take(groups, quota, seed, "_group", ["_all"]).select("_group", F.lit("test").alias("_part"))
    d = df.withColumn("_group", F.col(group).cast("string")).join(test, "_group", "left")
    return d.withColumn("part", F.coalesce("_part", F.lit("train"))).drop("_group", "_part")


def weighted_draws(df: DataFrame, n: int, seed: int, key: str = "path", weight: str = "weight") -> DataFrame:
    """About n draws with replacement in proportion to `weight`: every row with `draws`, how often it was drawn, at least 1.

    Draws of a row are Poisson with mean n x weight / total, the limit of drawing with replacement, so that no row has to
    know of another; the total is an aggregate. A mean above 50 is rounded up or down at random instead. Chance comes from a
    hash of seed and key: the same on every run.
    """
    total = df.agg(F.sum(weight).alias("_total"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"draw{seed}"), F.col(key))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    d = df.crossJoin(total).withColumn("_mean", F.lit(float(n)) * F.col(weight) / F.col("_total")).withColumn("_u", u)  # one row
    low = F.least("_mean", F.lit(50.0))
    start = F.struct(F.lit(0).alias("k"), F.exp(-low).alias("term"), F.exp(-low).alias("sum"))

    def step(s, _):  # how many partial sums of the Poisson distribution u reaches
        more, term = F.col("_u") >= s["sum"], s["term"] * low / (s["k"] + 1)
        return F.struct(F.when(more, s["k"] + 1).otherwise(s["k"]).alias("k"), F.when(more, term).otherwise(s["term"]).alias("term"), F.when(more, s["sum"] + term).otherwise(s["sum"]).alias("sum"))

    few = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, step, lambda s: s["k"].cast("bigint"))
    many = F.floor("_mean") + F.when(F.col("_u") < F.col("_mean") - F.floor("_mean"), 1).otherwise(0)
    return d.withColumn("draws", F.when(F.col("_mean") <= 50, few).otherwise(many)).filter("draws > 0").drop("_total", "_mean", "_u")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight), weight 1 / n: join it on label, or use it as the weight column of an estimator."""
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.lit(1.0) / F.col("n"))
