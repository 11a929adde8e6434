"""Vector expressions on array columns: everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if either is null; elements beyond the shorter one are ignored as nulls make them."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, floor: float = 1e-8) -> Column:
    """v / max(|v|, floor)."""
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / n)


def constant(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def standardize(v: Column, mean: Column, std: Column, floor: float = 1e-6) -> Column:
    """(v - mean) / max(std, floor), element by element."""
    return F.zip_with(F.zip_with(v, mean, lambda x, m: x.cast("double") - m), std, lambda x, s: x / F.greatest(s, F.lit(floor)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def two_logit_score(v: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Softmax of two logits, the second class: 1 / (1 + exp(l0 - l1)); the two rows fold into one dot product."""
    diff = [b - a for a, b in zip(*weights)]
    return sigmoid(dot(v, constant(diff)) + F.lit(float(bias[1] - bias[0])))


def clamp(p: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    """min(max(p, lower), upper); null stays null."""
    return F.when(p.isNotNull(), F.greatest(F.lit(lower), F.least(F.lit(upper), p)))


def printed(c: Column, digits: int = 4) -> Column:
    """Rounded for a report, halves to the even digit."""
    return F.bround(c, digits)


def focal_loss(p: Column, label: Column, gamma: float = 2.0, alpha: float | None = 0.5, floor: float = 1e-12) -> Column:
    """Focal loss of one score: alpha_t (1 - p_t)^gamma (-log p_t)."""
    pt = F.greatest(F.when(label >= 1, p).otherwise(F.lit(1.0) - p), F.lit(floor))
    weight = F.lit(1.0) if alpha is None else F.when(label >= 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return weight * F.pow(F.lit(1.0) - pt, F.lit(gamma)) * -F.log(pt)


def cosine_warmup(step: Column, total: int, warmup: int) -> Column:
    """Factor of the learning rate at a step: linear to 1 over the warm-up, then half a cosine down to 0."""
    t = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, (step + 1) / F.lit(float(max(1, warmup)))).otherwise(F.lit(0.5) * (1 + F.cos(F.lit(3.141592653589793) * t)))


def usable(v: Column, dim: int) -> Column:
    """Right length, no null, NaN or infinite element."""
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def column_stats(df: DataFrame, vector: str) -> DataFrame:
    """(pos, mean, std): mean and population deviation of each element over all rows. One vector of moments for each task is
    sent, whatever the number of rows; null vectors take no part. Spark's deviation is that of a sample, so it is scaled."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    s = df.filter(F.col(vector).isNotNull()).select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vector))).alias("s"))
    d = s.select(F.col("s.count").alias("n"), F.arrays_zip(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance")).alias("e"))
    d = d.select("n", F.posexplode("e").alias("pos", "e"))
    return d.select("pos", F.col("e.mean").alias("mean"), F.sqrt(F.col("e.variance") * (F.col("n") - 1) / F.col("n")).alias("std"))


def scores(df: DataFrame, vector: str, heads: dict[str, tuple[list[list[float]], list[float]]]) -> DataFrame:
    """One column p_<head> for each head over the same vector: one scan, one projection."""
    return df.select("*", *[two_logit_score(F.col(vector), w, b).alias(f"p_{name}") for name, (w, b) in heads.items()])
