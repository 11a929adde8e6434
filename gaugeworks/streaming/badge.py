"""The badge over a live score stream, with state for each clip in Structured Streaming."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.traces import ALPHA, badge_start, badge_step
from ..shipping import ship

OUT = "vid string, seq bigint, p double, med double, ema double, badge boolean, late bigint"
#: Last five scores, last sequence number, time the badge came on, ema, badge, the two runs, frames scored and late.
STATE = "raw array<double>, seq bigint, since double, ema double, badge boolean, up int, down int, scored bigint, late bigint"


def _update(dwell: float | None, upper: bool, idle: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the clip is over
            state.remove()
            return
        raw, seq, since, ema, on, up, down, scored, late = state.get if state.exists else ([], -1, None, None, False, 0, 0, 0, 0)
        fold = badge_start() | {"raw": list(raw), "n": scored, "on": on, "up": up, "down": down, "since": since}
        out = []
        for r in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            if r.seq <= seq:  # late or repeated: the clip has moved on
                late += 1
                continue
            seq = int(r.seq)
            ema = r.p if ema is None else ALPHA * r.p + (1 - ALPHA) * ema
            med = badge_step(fold, float(r.t), float(r.p), dwell, upper)
            out.append((key[0], seq, float(r.p), med, float(ema), fold["on"], late))
        state.update((fold["raw"], seq, fold["since"], ema, fold["on"], fold["up"], fold["down"], fold["n"], late))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["vid", "seq", "p", "med", "ema", "badge", "late"])

    return run


def badge_stream(scores: DataFrame, dwell: float | None = None, upper: bool = False, idle_ms: int | None = 3_600_000) -> DataFrame:
    """(vid, seq, p, med, ema, badge, late) for every scored frame of a stream (vid, seq, t, p).

    Frames without a score are left out. State is a few numbers for each clip, and is dropped when the clip had no frame
    for idle_ms (None: never; a run over what is there needs that, as a timeout keeps such a run waiting). Of frames that arrive within one micro-batch the order is restored by seq; a frame whose seq
    is not above the clip's last one comes too late and is dropped, as the workload never queues frames; `late` is how
    many of the clip were. A change of the scoring head starts a clip anew: see with_head.
    """
    used = scores.filter(F.col("p").isNotNull()).select("vid", F.col("seq").cast("bigint").alias("seq"), F.col("t").cast("double").alias("t"), F.col("p").cast("double").alias("p"))
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return used.groupBy("vid").applyInPandasWithState(_update(dwell, upper, idle_ms), OUT, STATE, "append", timeout)


def with_head(scores: DataFrame, head: str, heads: list[str]) -> DataFrame:
    """Score by another head of the map `heads`: p is its score and the clip's key names it, so that state starts anew.
    A head that is not known is an error."""
    if head not in heads:
        raise KeyError(f"unknown head {head!r}; there are {heads}")
    return scores.withColumn("p", F.col("heads")[head]).withColumn("active_head", F.lit(head)).withColumn("vid", F.concat_ws("@", "vid", F.lit(head)))


MAX_FRAME_BYTES = 8 * 1024 * 1024


def admitted(frames: DataFrame, content: str = "body", ok: Column | None = None, most: int = MAX_FRAME_BYTES) -> DataFrame:
    """Add `reject` to frames (body binary, ...): null for what may be scored, else why not and the status that tells so
    ('400 empty body', '413 frame too large', '400 undecodable'). ok: whether the picture could be read, where that is known."""
    size = F.octet_length(content)
    why = F.when(F.coalesce(size, F.lit(0)) == 0, "400 empty body").when(size > most, "413 frame too large")
    return frames.withColumn("reject", why if ok is None else why.when(~F.coalesce(ok, F.lit(False)), "400 undecodable"))


def live_and_dead(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames to be scored, and the dead letters with their reason but without their content."""
    return frames.filter("reject is null").drop("reject"), frames.filter("reject is not null").drop("body")


def counted(frames: DataFrame, name: str = "frames") -> DataFrame:
    """The same frames, observed: scored and busy frames of every micro-batch stand in the query's progress under `name`."""
    return frames.observe(name, F.count_if(F.col("p").isNotNull()).alias("scored"), F.count_if(F.col("p").isNull()).alias("busy"))


def fresh_frames(scores: DataFrame, bound: str = "30 seconds", sent: str = "sent_at", received: str = "received_at") -> DataFrame:
    """Drop, not queue: only frames received within a bound of being sent, each (vid, seq) once while the watermark holds it."""
    kept = scores.filter(F.col(received) <= F.col(sent) + F.expr(f"interval {bound}"))
    return kept.withWatermark(sent, bound).dropDuplicatesWithinWatermark(["vid", "seq"])


def window_counts(scores: DataFrame, width: str = "1 minute", late: str = "10 minutes", sent: str = "sent_at") -> DataFrame:
    """Frames, scored frames and mean score of each clip and event-time window."""
    return scores.withWatermark(sent, late).groupBy("vid", F.window(sent, width).alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.count("p").alias("scored"), F.avg("p").alias("mean_p"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, written by the tasks into Parquet at `path`; the table of it. Other modes than append rewrite the
    table with each micro-batch."""
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", path)
    else:
        out = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    out.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def cadence(ms: int = 500, scale: float = 1.0) -> str:
    """Trigger interval of a live query: one tick each 500 ms, times the rate scale."""
    return f"{max(1, round(ms * scale))} milliseconds"


ship(sys.modules[__name__])
