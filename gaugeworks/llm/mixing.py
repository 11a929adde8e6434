"""Mixing sources to target weights (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import plain, prefix_sums, save


def mix(items: DataFrame, targets: DataFrame, seed: int = 0, rows_each: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Choose items (item, source, tokens) so that every source gives its weight's share of the budget of each mix.

    targets: (mix_id, source, weight, max_repeats, budget_tokens). A source's budget is weight / sum of weights x
    budget_tokens. Items of a source stand in a random order (a hash of the item and the seed); prefix sums of their
    tokens in that order cut the order at the budget: an item is taken if its middle lies below the cut, so that a
    source misses its budget by at most half an item. A budget beyond all items of the source repeats the whole order, at
    most max_repeats times; what is missing then is reported.

    Returns (choice, report). choice: (mix_id, source, item, tokens, repeats), repeats >= 1. report: one row for each
    row of targets with target_tokens, available_tokens, reached_tokens, reached_share (of the mix) and target_share.
    Letter case and white space of sources never matter; a null source belongs to no target. Items of null or no tokens
    give nothing and are not chosen. Repeated rows count once. A null or negative weight counts as 0, a null or negative
    max_repeats as 0.
    """
    n = items.count()
    have = items.select("item", plain("source").alias("source"), F.col("tokens").cast("long").alias("tokens")).filter("source is not null and tokens > 0").distinct()
    placed = save(prefix_sums(have, "source", F.xxhash64(F.lit(seed), "item"), "tokens", n, rows_each, ("item", "tokens")).select("item", "source", "tokens", "upto"), "mix-order")
    totals = placed.groupBy("source").agg(F.max("upto").alias("available_tokens"))

    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    goal = targets.select("mix_id", plain("source").alias("source"), weight.alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"), "budget_tokens")
    share = F.try_divide("weight", F.sum("weight").over(Window.partitionBy("mix_id")))
    goal = goal.withColumn("target_share", F.coalesce(share, F.lit(0.0))).withColumn("target_tokens", F.col("target_share") * F.col("budget_tokens"))
    goal = goal.join(totals, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0).cast("long")))
    rounds = F.least(F.col("max_repeats").cast("long"), F.floor(F.try_divide("target_tokens", "available_tokens")))
    goal = goal.withColumn("rounds", F.when(F.col("available_tokens") > 0, rounds).otherwise(F.lit(0).cast("long")))
    goal = goal.withColumn("cut", F.when(F.col("rounds") < F.col("max_repeats"), F.col("target_tokens") - F.col("rounds") * F.col("available_tokens")).otherwise(F.lit(0.0)))
    goal = save(goal, "mix-goal")  # a row for each target

    extra = F.when(F.col("upto") - F.col("tokens") / 2 < F.col("cut"), 1).otherwise(0)
    choice = placed.join(goal.select("mix_id", "source", "rounds", "cut"), "source").withColumn("repeats", (F.col("rounds") + extra).cast("int")).filter("repeats > 0").select("mix_id", "source", "item", "tokens", "repeats")
    reached = choice.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("reached_tokens"))
    report = goal.join(reached, ["mix_id", "source"], "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0).cast("long")))
    report = report.withColumn("reached_share", F.coalesce(F.try_divide("reached_tokens", F.sum("reached_tokens").over(Window.partitionBy("mix_id"))), F.lit(0.0)))
    return choice, report.select("mix_id", "source", "target_share", "target_tokens", "max_repeats", "available_tokens", "reached_tokens", "reached_share")


def short_sources(report: DataFrame) -> DataFrame:
    """Rows of mix()'s report whose source gave all it may and still missed its target."""
    return report.filter((F.col("target_tokens") > F.col("reached_tokens")) & (F.col("reached_tokens") == F.col("max_repeats") * F.col("available_tokens")))
