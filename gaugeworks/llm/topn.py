"""Top N items within every group (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from .common import plain, save


def top_per_group(df: DataFrame, group: list[str], order: list[Column], item: list[str], n: int) -> DataFrame:
    """The n smallest rows of every group by `order` (ascending), each row once.

    The aggregate keeps a bounded heap per group. Spark builds it before the shuffle and merges the heaps afterwards, so
    a group of any size sends at most one heap from each task. Rows that stand several times must count once, and a heap
    cannot see that: it holds 2 n entries, from which equal ones are removed. Where that leaves fewer than n entries of
    a full heap (a row stands more than twice), the group alone is made distinct by an exact second pass.

    group: columns; null is a group of its own. order: expressions that make the rows of a group distinct; their nulls
    come first. item: columns handed on. Returns group columns, item columns and `rank` from 1.
    Empty input gives an empty table. Columns of df that are not named take no part and cannot clash.
    """
    keys = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    rows = df.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.struct(*keys, *[F.col(c).alias(f"_i{i}") for i, c in enumerate(item)]).alias("_row"))
    by = [f"_g{i}" for i in range(len(group))]
    heap = save(rows.groupBy(*by).agg(InternalFunction.collect_top_k(F.col("_row"), 2 * n, True).alias("_heap")), "heaps")
    short = (F.size("_heap") == 2 * n) & (F.size(F.array_distinct("_heap")) < n)
    best = heap.filter(~short).select(*by, F.array_distinct("_heap").alias("_heap"))
    if not heap.filter(short).isEmpty():
        again = rows.alias("r").join(heap.filter(short).select(*[F.col(b).alias(f"h{b}") for b in by]), [F.col(b).eqNullSafe(F.col(f"h{b}")) for b in by], "left_semi")
        best = best.unionByName(again.distinct().groupBy(*by).agg(InternalFunction.collect_top_k(F.col("_row"), n, True).alias("_heap")))
    out = best.select(*by, F.posexplode(F.slice(F.array_sort("_heap"), 1, n)).alias("_at", "_row"))
    return out.select(*[F.col(b).alias(g) for b, g in zip(by, group)], *[F.col(f"_row._i{i}").alias(c) for i, c in enumerate(item)], (F.col("_at") + 1).alias("rank"))


def same_condition(errors: DataFrame, conditions: DataFrame) -> DataFrame:
    """Replace `condition` by the tag of the row of conditions that it names, its level compared as a number.

    A spelling that names no row stays as it is but for letter case and white space; null stays null.
    """
    def parts(c: Column) -> tuple[Column, Column]:
        name = F.regexp_extract(c, r"^\s*([^\d@_:=\s\-]+)", 1)
        return name, F.regexp_extract(c, r"([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s*$", 1).try_cast("double")

    level = lambda c: F.coalesce(c.try_cast("double").cast("string"), F.lit(""))
    names = conditions.select(plain("transform").alias("_t"), level(F.col("level")).alias("_l"), F.col("tag").alias("_tag")).dropDuplicates(["_t", "_l"])
    name, number = parts(plain("condition"))
    return errors.withColumn("_t", name).withColumn("_l", level(number)).join(names, ["_t", "_l"], "left").withColumn("condition", F.coalesce("_tag", plain("condition"))).drop("_t", "_l", "_tag")


def top_errors(errors: DataFrame, conditions: DataFrame, n: int = 5) -> DataFrame:
    """The n most confident errors of every arm, condition and label: the highest score for reals (label 0), the lowest
    for the others; ties by path, then err_id.

    Rows whose label or score is null, NaN or outside 0 to 1 do not count. Smaller groups give all their rows.
    Null arm, condition, path or err_id: a value of its own, before all others. Columns: arm, condition, label, err_id,
    path, score, rank.
    """
    used = errors.select("arm", "condition", "label", "path", "score", "err_id").filter(F.col("label").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(0, 1))
    used = same_condition(used, conditions)
    confidence = F.when(F.col("label") == 0, F.lit(0.0) - F.col("score")).otherwise(F.col("score"))
    return top_per_group(used, ["arm", "condition", "label"], [confidence, F.col("path"), F.col("err_id")], ["err_id", "path", "score"], n)
