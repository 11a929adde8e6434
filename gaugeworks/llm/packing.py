"""Filling fixed-capacity containers with items (problem 6)."""

from __future__ import annotations

import sys
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, ship, small_rows

#: Specifications are a small table; more rows than this are an error.
MAX_SPECS = 1000
#: What becomes of a bin: emitted, goes on as one item, goes on as its items (nothing that is left could enter it).
FULL, OPEN, STUCK = 0, 1, 2
#: Rounds end when one leaves more than this share of the underfull bins before it.
PROGRESS = 0.999
_ITEMS = "array<struct<item:bigint,piece:int,pieces:int,tokens:bigint>>"
_BIN = f"spec_id int, capacity bigint, bucket bigint, container string, fill bigint, items {_ITEMS}, state int"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit of the sizes in falling order: the positions of the sizes in each bin."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}  # residual -> bins
    residuals: list[int] = []  # sorted keys of free
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[at]
        k = bisect_left(residuals, size)
        if k == len(residuals):
            bins.append([at])
            b, left = len(bins) - 1, capacity - size
        else:
            r = residuals[k]
            own = free[r]
            b = own.pop()
            if not own:
                del free[r], residuals[k]
            bins[b].append(at)
            left = r - size
        if left:
            if left in free:
                free[left].append(b)
            else:
                free[left] = [b]
                insort(residuals, left)
    return bins


def _pack_group(level: int, full: float, least: dict[int, int]):
    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("fill", "ascending"), ("container", "ascending")])  # the same result whatever the order of arrival
        spec, capacity, bucket = (table.column(c)[0].as_py() for c in ("spec_id", "capacity", "bucket"))
        sizes = table.column("fill").to_pylist()
        bins = best_fit(sizes, capacity)
        fill = np.array([sum(sizes[i] for i in own) for own in bins], dtype=np.int64)
        own = table.column("items").combine_chunks().take(pa.array(np.concatenate([np.asarray(x) for x in bins])))
        upto = np.r_[0, np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))][np.r_[0, np.cumsum([len(x) for x in bins])]]
        state = np.where(fill >= full * capacity, FULL, np.where(capacity - fill >= least[spec], OPEN, STUCK))
        n = len(bins)
        return pa.table({
            "spec_id": pa.array([spec] * n, pa.int32()), "capacity": pa.array([capacity] * n, pa.int64()), "bucket": pa.array([bucket] * n, pa.int64()), "container": pa.array([f"{spec}-{level}-{bucket}-{k}" for k in range(n)]),
            "fill": pa.array(fill), "items": pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), own.flatten()), "state": pa.array(state.astype(np.int32))})

    return pack


def pack(items: DataFrame, specs: DataFrame, rows_each: int = 25_000, fan_in: int = 8, full: float = 0.99) -> DataFrame:
    """Put items (item bigint, tokens bigint) into containers of each specification (spec_id int, capacity bigint).

    Hierarchical residual packing: items are hashed into buckets of about rows_each, each packed best-fit in falling
    size. Bins filled to `full` are emitted. Underfull bins meet those of other buckets in a round of fan_in times fewer
    buckets (more where they are many, so that a task never holds more than about rows_each): as one item, or, where nothing
    that is left could enter them, as the items that they hold. Rounds end with one bucket, when a round hardly lowers
    the number of underfull bins, or after as many rounds as fan_in needs for the first buckets, and two; no bin is ever
    set aside for the number of them. An item larger than the
    capacity is cut into full containers and one rest, which is packed like any item; no other item is cut.

    Returns (spec_id, container, item, piece, pieces, tokens), one row per piece. Items of null or zero size take no
    room: they have one row with a null container and 0 pieces. Repeated rows count once. Capacities that are null or
    below 1 take no part.
    """
    given = [(int(r[0]), int(r[1])) for r in small_rows(specs.select("spec_id", "capacity").distinct(), MAX_SPECS, "specs") if r[0] is not None and r[1] is not None and r[1] > 0]
    spark = items.sparkSession
    if not given:
        return spark.createDataFrame([], "spec_id int, container string, item bigint, piece int, pieces int, tokens bigint")
    all_items = save(items.select(F.col("item").cast("long").alias("item"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens")).distinct(), "sizes")
    rests = {s: F.when(F.col("tokens") % c > 0, F.col("tokens") % c) for s, c in given}
    n, *least = all_items.agg(F.count(F.lit(1)), *[F.min(x) for x in rests.values()]).first()
    least = {s: x or 1 for s, x in zip(rests, least)}
    spec = F.explode(F.array(*[F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in given])).alias("s")
    each = all_items.select(spec, "item", "tokens").select("s.spec_id", "s.capacity", "item", "tokens")
    each = each.withColumn("pieces", F.ceil(F.col("tokens") / F.col("capacity")).cast("int"))
    whole = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    none = each.filter("tokens <= 0").select("spec_id", F.lit(None).cast("string").alias("container"), "item", F.lit(0).alias("piece"), F.lit(0).alias("pieces"), F.lit(0).cast("long").alias("tokens"))
    cut = each.filter(whole >= 1).select("spec_id", "capacity", "item", "pieces", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    cut = cut.select("spec_id", F.concat_ws("-", "spec_id", F.lit("whole"), F.coalesce(F.col("item").cast("string"), F.lit("null")), "piece").alias("container"), "item", "piece", "pieces", F.col("capacity").alias("tokens"))

    buckets = max(1, -(-n // rows_each))
    rest = each.filter(F.col("tokens") % F.col("capacity") > 0)
    left = (F.col("tokens") % F.col("capacity")).alias("tokens")
    bins = rest.select("spec_id", "capacity", F.pmod(F.xxhash64("item"), F.lit(buckets)).alias("bucket"), F.coalesce(F.col("item").cast("string"), F.lit("")).alias("container"), left.alias("fill"), F.array(F.struct("item", (F.col("pieces") - 1).alias("piece"), "pieces", left)).alias("items"))
    closed = []
    level, before = 0, None
    rounds = 2
    while fan_in ** (rounds - 2) < buckets:
        rounds += 1
    while True:
        packed = save(bins.groupBy("spec_id", "bucket").applyInArrow(_pack_group(level, full, least), _BIN), f"bins{level}")
        under = packed.filter(F.col("state") > FULL).groupBy("spec_id").agg(F.count(F.lit(1)).alias("bins"), F.sum(F.when(F.col("state") == OPEN, 1).otherwise(F.size("items"))).alias("rows")).collect()  # a row for each specification
        number, most = sum(r.bins for r in under), max([0, *(r.rows for r in under)])
        if buckets == 1 or not number or level == rounds or (before is not None and number > PROGRESS * before):
            closed.append(packed)
            break
        closed.append(packed.filter(F.col("state") == FULL))
        buckets, level, before = max(-(-buckets // fan_in), -(-most // rows_each)), level + 1, number
        go = packed.filter(F.col("state") == OPEN).select("spec_id", "capacity", "container", "fill", "items")
        parts = packed.filter(F.col("state") == STUCK).select("spec_id", "capacity", F.explode("items").alias("x"))
        go = go.unionByName(parts.select("spec_id", "capacity", F.concat_ws("/", F.coalesce(F.col("x.item").cast("string"), F.lit("")), "x.piece").alias("container"), F.col("x.tokens").alias("fill"), F.array("x").alias("items")))
        bins = go.select("spec_id", "capacity", F.pmod(F.xxhash64("container", F.lit(level)), F.lit(buckets)).alias("bucket"), "container", "fill", "items")
    out = none.unionByName(cut)
    for c in closed:
        out = out.unionByName(c.select("spec_id", "container", F.explode("items").alias("x")).select("spec_id", "container", "x.item", "x.piece", "x.pieces", "x.tokens"))
    return out


def pack_report(packed: DataFrame) -> DataFrame:
    """Containers of each specification against the least possible number by volume: (spec_id, containers, tokens, capacity_used)."""
    per = packed.filter("container is not null").groupBy("spec_id", "container").agg(F.sum("tokens").alias("fill"))
    return per.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"))


ship(sys.modules[__name__])
