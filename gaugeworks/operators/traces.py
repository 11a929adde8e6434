"""Score traces: rolling medians, averages, the two badge rules and what is told about a clip.

What depends on the step before (average, badge) is a fold over the sorted rows of a clip, in linear time; the rest are
windows and aggregates.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .folds import sorted_fold

# Fixed values of the badge rules.
RAISE_AT, CLEAR_AT, RAISE_AFTER, CLEAR_AFTER, DWELL = 0.9446, 0.70, 2, 5, 2.5
ALPHA = 0.35
SHARES = [0.1266, 0.5, 0.6388, 0.9446]


def _order(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def rolling_median(df: DataFrame, key: str = "vid", order: str = "seq", value: str = "p", width: int = 5, least: int = 3) -> DataFrame:
    """Add med: the median of the last `width` values, null before the `least`-th."""
    w = _order(key, order)
    m = F.percentile(value, F.lit(0.5)).over(w.rowsBetween(1 - width, 0))
    return df.withColumn("med", F.when(F.row_number().over(w) >= least, m))


def rolling_upper_median(df: DataFrame, key: str = "vid", order: str = "seq", value: str = "p", width: int = 5, least: int = 3) -> DataFrame:
    """As rolling_median, taking the upper of the two middle values of an even number."""
    w = _order(key, order)
    near = F.array_sort(F.collect_list(value).over(w.rowsBetween(1 - width, 0)))
    return df.withColumn("med", F.when(F.row_number().over(w) >= least, F.element_at(near, F.floor(F.size(near) / 2).cast("int") + 1)))


def traces(df: DataFrame, key: str = "vid", order: str = "seq", value: str = "p", time: str = "t") -> DataFrame:
    """(key, trace array<struct<order, t, p>>) of the rows with a value."""
    rows = df.filter(F.col(value).isNotNull()).select(key, F.struct(F.col(order).alias("seq"), F.col(time).alias("t"), F.col(value).alias("p")).alias("r")).distinct()
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("trace"))


def ema(df: DataFrame, key: str = "vid", order: str = "seq", value: str = "p", alpha: float = ALPHA) -> DataFrame:
    """(key, seq, p, ema): e0 = p0, e = alpha p + (1 - alpha) e. Rows without a value take no part."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(key).cast("string").alias(key), F.col(order).cast("bigint").alias("seq"), F.col(value).cast("double").alias("p")).distinct()
    out = pa.schema([(key, pa.string()), ("seq", pa.int64()), ("p", pa.float64()), ("ema", pa.float64())])

    def step(state, k, seq, p):
        state["e"] = p if "e" not in state else alpha * p + (1 - alpha) * state["e"]
        return [(k, seq, p, state["e"])]

    return sorted_fold(rows, key, ["seq", "p"], out, dict, step)


def median_of(values: list[float], upper: bool) -> float:
    """Median, or the upper of the two middle values of an even number."""
    v = sorted(values)
    m = len(v) // 2
    return v[m] if len(v) % 2 or upper else (v[m - 1] + v[m]) / 2


def badge_step(state: dict, t: float | None, p: float, dwell: float | None, upper: bool) -> float | None:
    """Advance a badge by one score; the median of the last five from the third score on.

    On after RAISE_AFTER updates in a row at RAISE_AT or more; off after CLEAR_AFTER in a row at CLEAR_AT or less. A value
    between them breaks the run that is being counted; both runs are zero after a change. With dwell, nothing counts
    towards off until that many seconds after the badge came on.
    """
    state["raw"] = [*state["raw"], p][-5:]
    state["n"] += 1
    if state["n"] < 3:
        return None
    med = median_of(state["raw"], upper)
    on = state["on"]
    state["up"] = state["up"] + 1 if not on and med >= RAISE_AT else 0
    state["down"] = state["down"] + 1 if on and med <= CLEAR_AT and (dwell is None or t - state["since"] >= dwell) else 0
    if state["up"] >= RAISE_AFTER:
        state |= {"on": True, "up": 0, "since": t, "raised": True, "med": med}
    elif state["down"] >= CLEAR_AFTER:
        state |= {"on": False, "down": 0}
    return med


def badge_start() -> dict:
    return {"raw": [], "n": 0, "on": False, "up": 0, "down": 0, "since": None, "top": 0.0, "trigger": (None, None), "raised": False, "med": None}


def badge(df: DataFrame, key: str = "vid", dwell: float | None = None, upper: bool = False) -> DataFrame:
    """(key, seq, med, on, top, trigger_seq, trigger_med): state of the badge at every scored frame of a clip.

    The first two frames have no median and are off. top is the largest median so far (0 before there is one); the trigger
    is the frame at which the badge last came on, and its median.
    """
    rows = df.filter(F.col("p").isNotNull()).select(F.col(key).cast("string").alias(key), F.col("seq").cast("bigint").alias("seq"), F.col("t").cast("double").alias("t"), F.col("p").cast("double").alias("p")).distinct()
    out = pa.schema([(key, pa.string()), ("seq", pa.int64()), ("med", pa.float64()), ("on", pa.bool_()), ("top", pa.float64()), ("trigger_seq", pa.int64()), ("trigger_med", pa.float64())])

    def step(state, k, seq, t, p):
        med = badge_step(state, t, p, dwell, upper)
        state["top"] = max(state["top"], med or 0.0)
        if state["raised"]:
            state |= {"trigger": (seq, state["med"]), "raised": False}
        return [(k, seq, med, state["on"], state["top"], *state["trigger"])]

    return sorted_fold(rows, key, ["seq", "t", "p"], out, badge_start, step)


def badge_summary(states: DataFrame, key: str = "vid") -> DataFrame:
    """(key, updates, on_fraction, transitions, max_median, headroom): every frame counts, also those before the first median."""
    before = F.lag("on").over(_order(key, "seq"))
    d = states.withColumn("_turn", F.when(before.isNotNull() & (before != F.col("on")), 1).otherwise(0))
    top = F.coalesce(F.max("med"), F.lit(0.0))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("updates"), F.avg(F.col("on").cast("double")).alias("on_fraction"), F.sum("_turn").alias("transitions"), top.alias("max_median"), (F.lit(RAISE_AT) - top).alias("headroom"))


def verdict(label: Column, on_fraction: Column, transitions: Column) -> Column:
    """What a clip's badge history amounts to; the order of the cases matters."""
    right = ((label == "ai") & (on_fraction > 0.5)) | ((label == "real") & (on_fraction < 0.02))
    return F.when(transitions > 2, "flickering").when(right, "pinned_correct").when((on_fraction >= 0.02) & (on_fraction <= 0.5), "crosses_mid_clip").otherwise("pinned_wrong")


def trace_stats(df: DataFrame, key: str = "vid", value: str = "p") -> DataFrame:
    """Exact order statistics with linear interpolation, mean, and shares at or above fixed thresholds."""
    q = lambda x: F.percentile(value, F.lit(x))
    shares = [F.avg((F.col(value) >= t).cast("double")).alias(f"frac_ge_{str(t).replace('.', '_')}") for t in SHARES]
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min_p"), q(0.05).alias("p05"), q(0.5).alias("median_p"), F.avg(value).alias("mean_p"), q(0.95).alias("p95"), F.max(value).alias("max_p"), *shares)


def lag_correlation(df: DataFrame, key: str = "vid", order: str = "seq", value: str = "p") -> DataFrame:
    """(key, frame_corr): Pearson correlation of each value with the one before; 1 for two values or fewer, or for no spread."""
    w = _order(key, order)
    d = df.filter(F.col(value).isNotNull()).withColumn("_before", F.lag(value).over(w))
    own = F.when(F.col("_before").isNotNull(), F.col(value))
    together = F.try_divide(F.covar_pop("_before", own), F.stddev_pop("_before") * F.stddev_pop(own))  # corr() fails where nothing varies
    out = d.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop(value).alias("_s"), together.alias("_c"))
    return out.select(key, F.when((F.col("_n") <= 2) | (F.col("_s") <= 1e-9) | F.col("_c").isNull() | F.isnan("_c"), F.lit(1.0)).otherwise(F.col("_c")).alias("frame_corr"))


def head_medians(df: DataFrame, key: str = "vid", heads: str = "heads") -> DataFrame:
    """(key, head, median_p) of a map of head scores."""
    return df.filter(F.col(heads).isNotNull()).select(key, F.explode(heads).alias("head", "p")).groupBy(key, "head").agg(F.percentile("p", F.lit(0.5)).alias("median_p"))


def recent_rate(df: DataFrame, key: str = "vid", order: str = "seq", time: str = "t", last: int = 20) -> DataFrame:
    """(key, order, fps): (n - 1) / (latest - earliest) over the last `last` arrivals; null for one arrival or no time passed."""
    w = _order(key, order)
    frame = w.rowsBetween(1 - last, 0)
    n, span = F.count(F.lit(1)).over(frame), F.col(time) - F.min(time).over(frame)
    return df.select(key, order, F.when((n > 1) & (span > 0), (n - 1) / span).alias("fps"))


def recent(trace: Column, n: int) -> Column:
    """The last n entries."""
    return F.slice(trace, -F.least(F.lit(n), F.greatest(F.size(trace), F.lit(1))), n)


ship(sys.modules[__name__])
