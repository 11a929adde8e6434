"""Sample matching target category proportions (problem 1)."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, save, ship, small_rows

#: A draw's targets are a small table; more rows than this are an error. It bounds what reaches the driver.
MAX_TARGETS = 100_000


def calibrate(counts: np.ndarray, member: np.ndarray, targets: np.ndarray, rate: float | np.ndarray, tol: float = 1e-9, rounds: int = 100) -> np.ndarray:
    """Inclusion probability of each cell: min(1, rate * exp(member' lambda)), meeting member @ (counts * p) = targets.

    Newton iterations on the dual of exponential tilting. counts: records in each cell (the moments, aggregated before).
    member: constraints x cells, 0 or 1. targets: what each constraint must sum to, at most what its cells hold. rate:
    the probability before tilting, of all cells or of each. A cell that reaches 1 drops out of the derivative; steps are halved while they
    worsen the residual.
    """
    lam = np.zeros(len(targets))
    p_of = lambda x: np.minimum(1.0, rate * np.exp(np.clip(member.T @ x, -700, 700)))
    miss_of = lambda p: member @ (counts * p) - targets
    p = p_of(lam)
    for _ in range(rounds):
        miss = miss_of(p)
        if np.all(np.abs(miss) <= tol * np.maximum(1.0, targets)):
            break
        weight = counts * np.where(p < 1, p, 0.0)
        hess = (member * weight) @ member.T
        step = np.linalg.lstsq(hess + 1e-12 * np.eye(len(lam)), miss, rcond=None)[0]
        step = np.clip(step, -20, 20)
        scale = np.ones(len(lam))
        for _ in range(40):
            new = lam - scale * step
            gone = np.abs(miss_of(p_of(new))) > np.abs(miss)
            if not gone.any():
                break
            scale = np.where(gone, scale / 2, scale)
        lam = new
        p = p_of(lam)
    return p


def aims(available: np.ndarray, share: np.ndarray, floor: np.ndarray, size: float) -> np.ndarray:
    """Records to draw of each cell, `size` in all where the records allow: floors are kept, cells that hold too few are
    taken whole, and the others share what is left in proportion to `share`.

    The total is one constraint over the cells that are neither at their floor nor exhausted. Newton iterations on the
    dual give the tilt of their design probabilities (share x size / records); cells that the tilt pushes below their floor
    are fixed there and the others calibrated anew.
    """
    most = available.astype(np.float64)
    low = np.minimum(most, floor)
    goal = low.copy()
    free = (share > 0) & (most > 0)
    while free.any():
        left = min(size - goal[~free].sum(), most[free].sum())
        if left <= low[free].sum():
            goal[free] = low[free]
            break
        rate = np.minimum(1e6, share[free] * size / most[free])
        got = most[free] * calibrate(most[free], np.ones((1, int(free.sum()))), np.array([left]), rate)
        goal[free] = got
        under = np.zeros(len(free), dtype=bool)
        under[free] = got < low[free] - 1e-9
        if not under.any():
            break
        goal[under], free = low[under], free & ~under
    return goal


def pivotal(cell: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The pivotal method within each cell: probabilities after duels, at most one of each cell not 0 or 1.

    cell: sorted. In each round neighbours of a cell meet: of two with p1 + p2 < 1 one takes the sum and the other 0; else
    one becomes 1 and the other keeps p1 + p2 - 1. Expected values never change, and the sum of a cell stays fixed.
    rng: where the luck of each duel comes from.
    """
    p = p.astype(np.float64).copy()
    live = np.flatnonzero((p > 1e-12) & (p < 1 - 1e-12))
    while len(live) > 1:
        c = cell[live]
        start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        at = np.arange(len(c)) - np.repeat(start, np.diff(np.r_[start, len(c)]))
        left = np.flatnonzero((at % 2 == 0) & np.r_[c[1:] == c[:-1], False])
        if not len(left):
            break
        a, b = live[left], live[left + 1]
        u = rng.random(len(a))
        pa_, pb_ = p[a], p[b]
        total = pa_ + pb_
        small = total < 1
        first = np.where(small, u * total < pa_, u * np.maximum(2 - total, 1e-300) < 1 - pb_)
        p[a] = np.where(small, np.where(first, total, 0.0), np.where(first, 1.0, total - 1))
        p[b] = np.where(small, np.where(first, 0.0, total), np.where(first, total - 1, 1.0))
        p[live[np.abs(p[live]) < 1e-12]] = 0.0
        p[live[np.abs(p[live] - 1) < 1e-12]] = 1.0
        live = live[(p[live] > 0) & (p[live] < 1)]
    return p


def _luck(h: pd.Series) -> np.random.Generator:
    """Random numbers that depend on which units meet, not on their order of arrival."""
    return np.random.default_rng(np.bitwise_xor.reduce(np.asarray(h, dtype=np.int64).view(np.uint64)))


def _duel(pdf: pd.DataFrame) -> pd.DataFrame:
    """Duels among the units of one bucket; chosen units (p = 1) and the undecided one of each draw and category."""
    pdf = pdf.drop_duplicates(["draw_id", "source", "label", "item"]).sort_values(["draw_id", "source", "label", "h", "item"], kind="stable")
    cell = pdf.groupby(["draw_id", "source", "label"], sort=False).ngroup().to_numpy()
    pdf = pdf.assign(p=pivotal(cell, pdf["p"].to_numpy(), _luck(pdf["h"])))
    return pdf[pdf["p"] > 0]


def _final(pdf: pd.DataFrame) -> pd.DataFrame:
    """Duels among what the buckets left undecided in one draw and category; a last undecided unit is drawn by its p."""
    pdf = _duel(pdf)
    rest = (pdf["p"] < 1).to_numpy()
    taken = ~rest | (_luck(pdf["h"] ^ 0x5DEECE66D).random(len(pdf)) < pdf["p"].to_numpy())
    return pdf[taken].assign(p=1.0)


_UNIT = "draw_id int, source string, label int, item bigint, p double, h bigint"


def draw(records: DataFrame, targets: DataFrame, seed: int = 0, rows_each: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Draw, for every draw_id, records of each category (source, label) in the given proportions.

    records: (item bigint, source, label). targets: (draw_id, source, label, share, min_rows, n_rows). A category's goal
    is the greater of share x n_rows and min_rows (the floor). Its aim is what is drawn of it: category counts are
    aggregated in one pass and calibrated (`aims`), so that a draw has n_rows records where there are as many: floors are
    kept, short categories are taken whole, and the others make up for both in proportion to their shares. Aims over
    records are inclusion probabilities, with which the pivotal method draws, first within hash buckets of records,
    then among the one undecided unit that each bucket leaves of a category. A category thus gets its aim rounded up or down.

    Returns (sample, report). sample: (draw_id, source, label, item), distinct. report: a row for each target with goal,
    aim, available, drawn and gap (goal - available where positive, else 0).
    Labels above 1 count as 1. Records with null source or label belong to no category; letter case and white space of
    source never matter; repeated rows of an item count once. A null share or min_rows counts as 0. The same seed gives the
    same sample. Columns other than those named take no part.
    """
    label = lambda c: F.when(F.col(c) > 1, 1).otherwise(F.col(c)).cast("int")
    units = records.select(F.col("item").cast("long").alias("item"), plain("source").alias("source"), label("label").alias("label")).filter("item is not null and source is not null and label is not null")
    zero = F.lit(0.0)
    goals = targets.select(F.col("draw_id").cast("int").alias("draw_id"), plain("source").alias("source"), label("label").alias("label"), F.greatest(F.coalesce("share", zero), zero).alias("share"), F.greatest(F.coalesce(F.col("min_rows").cast("double"), zero), zero).alias("floor"), F.greatest(F.coalesce(F.col("n_rows").cast("double"), zero), zero).alias("n_rows"))
    goals = goals.withColumn("goal", F.greatest(F.col("share") * F.col("n_rows"), F.col("floor")))
    wanted = goals.filter("source is not null and label is not null").select("source", "label").distinct()
    used = units.join(wanted, ["source", "label"], "left_semi")
    counts = used.distinct().groupBy("source", "label").agg(F.count(F.lit(1)).alias("available"))
    table = goals.join(counts, ["source", "label"], "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    rows = small_rows(table.select("draw_id", "source", "label", "share", "floor", "n_rows", "goal", "available"), MAX_TARGETS, "targets")
    spark = records.sparkSession

    cells, told, expected = [], [], 0.0
    for d in sorted({r.draw_id for r in rows if r.draw_id is not None}):
        own = [r for r in rows if r.draw_id == d]
        aim = aims(np.array([r.available for r in own]), np.array([r.share for r in own]), np.array([r.floor for r in own]), max(r.n_rows for r in own))
        for r, x in zip(own, aim):
            told.append((d, r.source, r.label, r.goal, float(x), r.available))
            if x > 0:
                p = min(1.0, x / r.available)
                cells.append((d, r.source, r.label, float(1.0 if p > 1 - 1e-9 else p)))  # a full category leaves no duel to chance
                expected += r.available
    told += [(None, r.source, r.label, r.goal, 0.0, r.available) for r in rows if r.draw_id is None]
    probabilities = spark.createDataFrame(cells, "draw_id int, source string, label int, p double")
    buckets = max(1, -(-int(expected) // rows_each))  # a unit for each record and draw
    ready = used.join(F.broadcast(probabilities), ["source", "label"])  # at most MAX_TARGETS rows
    ready = ready.select("draw_id", "source", "label", "item", "p", F.xxhash64(F.lit(seed), "draw_id", "item").alias("h"))
    # by a hash of the item: every bucket has its share of every category, however large the category
    fought = save(ready.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets))).groupBy("bucket").applyInPandas(lambda pdf: _duel(pdf.drop(columns="bucket"))[["draw_id", "source", "label", "item", "p", "h"]], _UNIT), "duels")
    last = fought.filter("p < 1").groupBy("draw_id", "source", "label").applyInPandas(_final, _UNIT)
    sample = save(fought.filter("p = 1").unionByName(last).select("draw_id", "source", "label", "item"), "sample")

    drawn = sample.groupBy("draw_id", "source", "label").agg(F.count(F.lit(1)).alias("drawn"))
    report = spark.createDataFrame(told, "draw_id int, source string, label int, goal double, aim double, available bigint")
    report = report.join(drawn, ["draw_id", "source", "label"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long")))
    return sample, report.withColumn("gap", F.greatest(F.lit(0.0), F.col("goal") - F.col("available")))


ship(sys.modules[__name__])
