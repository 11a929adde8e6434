"""Leakage control by content hash: exclusion lists, checks, removal and keep-first deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import filesystem


class LeakageError(AssertionError):
    """Training rows share content with held-out rows."""


def exclusion_list(held_out: DataFrame, key: str = "content_hash") -> DataFrame:
    """Distinct non-null hashes in lower case."""
    return held_out.select(F.lower(key).alias(key)).filter(F.col(key).isNotNull()).distinct()


def read_exclusion(spark: SparkSession, path: str, key: str = "content_hash") -> DataFrame:
    """A written exclusion list, one hash on a line. One that is missing or empty is refused: nothing may be trained without."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no exclusion list at {path}")
    return refuse_empty(spark.read.text(path).select(F.trim("value").alias(key)).filter(F.col(key) != ""), key)


def refuse_empty(excluded: DataFrame, key: str = "content_hash") -> DataFrame:
    if excluded.filter(F.col(key).isNotNull()).isEmpty():
        raise LeakageError("the exclusion list is empty")
    return excluded


def leaked(train: DataFrame, excluded: DataFrame, key: str = "content_hash") -> DataFrame:
    """Training rows whose hash is excluded. A null hash passes, as an unreadable picture does in the workload."""
    return train.withColumn("_k", F.lower(key)).join(excluded.select(F.col(key).alias("_k")), "_k", "left_semi").drop("_k")


def without_leaks(train: DataFrame, excluded: DataFrame, key: str = "content_hash") -> DataFrame:
    return train.withColumn("_k", F.lower(key)).join(excluded.select(F.col(key).alias("_k")), "_k", "left_anti").drop("_k")


def assert_no_leak(train: DataFrame, excluded: DataFrame, key: str = "content_hash", show: str = "path") -> None:
    """Raise LeakageError naming at most ten offenders, or if nothing is excluded at all."""
    refuse_empty(excluded, key)
    rows = leaked(train, excluded, key).orderBy(show).limit(10).collect()
    if rows:
        raise LeakageError(f"{len(rows)} or more training rows are held out: {[r[show] for r in rows]}")


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the first by order; all null keys are one. The filter on row_number limits groups before the shuffle."""
    w = Window.partitionBy(F.lower(key)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def overlap_counts(df: DataFrame, group: str, key: str) -> DataFrame:
    """(group, rows, distinct_hashes)."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.lower(key)).alias("distinct_hashes"))
