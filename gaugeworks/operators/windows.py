"""Byte windows: archive members grouped into ranges that are fetched at once."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .folds import sorted_fold
from .sampling import shuffled

MAX_GAP, MAX_WINDOW = 1 << 20, 16 << 20
# Bytes of a member's local header, and of the extra fields that are allowed for.
HEADER, EXTRA = 30, 512


def member_end(offset: Column, name: Column, size: Column) -> Column:
    """Where a member ends at the latest: header, name, extra fields and compressed content."""
    return offset + HEADER + F.octet_length(name) + EXTRA + size


def gap_windows(members: DataFrame, archive: str = "archive", offset: str = "offset", size: str = "size", name: str = "name", max_gap: int = MAX_GAP) -> DataFrame:
    """Add `stop`, a member's end, and `island`: members of an archive, in order of offset, split where one begins more than
    max_gap after the end of the member before."""
    d = members.withColumn("stop", member_end(F.col(offset), F.col(name), F.col(size)))
    w = Window.partitionBy(archive).orderBy(offset, name)
    before = F.lag("stop").over(w)
    first = F.when(before.isNull() | (F.col(offset) - before > max_gap), 1).otherwise(0)
    return d.withColumn("_new", first).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def byte_windows(members: DataFrame, archive: str = "archive", offset: str = "offset", size: str = "size", name: str = "name", max_gap: int = MAX_GAP, max_window: int = MAX_WINDOW) -> DataFrame:
    """(archive, start, stop, members): ranges that end at a gap, or before they span more than max_window.

    The span rule depends on where the range before ended, so it is a fold over the sorted members; it holds one range.
    """
    rows = members.select(F.col(archive).cast("string").alias("archive"), F.col(offset).cast("bigint").alias("offset"), member_end(F.col(offset), F.col(name), F.col(size)).cast("bigint").alias("stop"), F.col(name).alias("name"))
    out = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("members", pa.int32())])

    def step(state, key, at, stop, _):
        done = []
        if state and (stop - state["start"] > max_window or at - state["stop"] > max_gap):
            done = finish(key, state)
            state.clear()
        state |= {"start": state.get("start", at), "stop": stop, "members": state.get("members", 0) + 1}
        return done

    def finish(key, state):
        return [(key, state["start"], state["stop"], state["members"])] if state else []

    return sorted_fold(rows, "archive", ["offset", "name"], out, dict, step, finish)


def select_members(members: DataFrame, grep: str | None = None, limit: int = 0, seed: int = 0, name: str = "name", offset: str = "offset") -> DataFrame:
    """Archive members whose name holds a literal piece, a seeded choice of `limit` of them (0: all), in order of offset."""
    d = members.filter(F.col(name).contains(grep)) if grep else members
    if limit:
        d = d.orderBy(shuffled(seed, name), name).limit(limit)
    return d.orderBy(offset, name)


def listing(members: DataFrame, rows: int = 200, name: str = "name", size: str = "size", offset: str = "offset") -> DataFrame:
    """Name and size of the first `rows` members by offset."""
    return members.orderBy(offset, name).limit(rows).select(name, size)


ship(sys.modules[__name__])
