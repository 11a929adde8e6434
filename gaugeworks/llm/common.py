"""What the operators share: the shared folder, written tables and the spelling of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship  # noqa: F401
from ..storage import discard, filesystem, save, shared_folder  # noqa: F401


def plain(c: Column | str) -> Column:
    """Letter case and surrounding or repeated white space never matter."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))


def small_rows(df: DataFrame, bound: int, what: str) -> list:
    """The rows of a specification table, whose size is checked: more than `bound` rows are an error."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows")
    return rows


def hash_buckets(n: int, rows_each: int) -> int:
    """Bits of a hash that give buckets of about rows_each rows."""
    return max(0, (max(1, n) // max(1, rows_each)).bit_length())


def prefix_sums(df: DataFrame, group: str, key: Column, size: str, n: int, rows_each: int = 100_000, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add `upto`, the sum of `size` over the rows of the same group up to and with this row, in the order of a hash.

    key is a 64-bit hash. Its leading bits cut every group into ranges of about equal number of rows, which are the
    partitions of a range sort without sampling; a hot group thus spreads over all of them. Ranges are summed first
    (with map-side combine) and only the few range sums pass through an ordered window per group.
    Adds the columns _key and _range as well. Rows with equal keys follow each other by the columns `ties`, which should
    make the order strict.
    """
    bits = hash_buckets(n, rows_each)
    ranged = df.withColumn("_key", key)
    ranged = ranged.withColumn("_range", F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = ranged.groupBy(group, "_range").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_range").orderBy("_key", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = ranged.withColumn("_inside", F.sum(size).over(inside))
    return ranged.join(sums, [group, "_range"]).withColumn("upto", F.col("_before") + F.col("_inside")).drop("_before", "_inside")
