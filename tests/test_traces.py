import random
import statistics

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import traces, windows
from gaugeworks.streaming import badge as B

FR = "vid string, seq bigint, t double, p double"


def _fold(ps, ts=None, dwell=None, upper=False):
    """The badge after each update, written as a plain loop."""
    on, up, down, since, out = False, 0, 0, None, []
    for i in range(len(ps)):
        if i < 2:
            out.append(False)
            continue
        w = sorted(ps[max(0, i - 4) : i + 1])
        med = w[len(w) // 2] if upper else statistics.median(w)
        t = ts[i] if ts else i / 2
        if not on:
            up = up + 1 if med >= traces.RAISE_AT else 0
            if up == traces.RAISE_AFTER:
                on, up, down, since = True, 0, 0, t
        else:
            down = down + 1 if med <= traces.CLEAR_AT and (dwell is None or t - since >= dwell) else 0
            if down == traces.CLEAR_AFTER:
                on, up, down = False, 0, 0
        out.append(on)
    return out


def _clips():
    rng = random.Random(3)
    clips = {f"len{n}": [0.99] * n for n in range(6)}
    clips["exact"] = [0.95] * 4 + [0.1] * 9 + [0.8] * 3 + [0.99] * 6
    for i in range(25):
        x, ps = rng.random(), []
        for _ in range(60):
            x = min(1.0, max(0.0, x + rng.uniform(-0.3, 0.32)))
            ps.append(round(x, 3))
        clips[f"r{i}"] = ps
    return clips


def _frame(spark, clips):
    return spark.createDataFrame([(v, i, i / 2, p) for v, ps in clips.items() for i, p in enumerate(ps)], FR)


@pytest.mark.parametrize("dwell,upper", [(None, False), (2.5, True)])
def test_badge_matches_a_plain_loop(spark, dwell, upper):
    clips = _clips()
    got = {}
    for r in traces.badge(_frame(spark, clips), dwell=dwell, upper=upper).orderBy("vid", "seq").collect():
        got.setdefault(r.vid, []).append(r.on)
    assert got == {v: _fold(ps, dwell=dwell, upper=upper) for v, ps in clips.items() if ps}


def test_stream_equals_batch(spark, tmp_path):
    clips = _clips()
    df = _frame(spark, clips).filter("p is not null")
    rng = random.Random(1)
    for part in range(3):  # arrival in three files, each in mixed order
        rows = [r for r in df.collect() if r.seq // 20 == part]
        rng.shuffle(rows)
        spark.createDataFrame(rows + rows[:5], FR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FR).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = B.run_to_table(B.badge_stream(stream, idle_ms=None), str(tmp_path / "badges"), str(tmp_path / "check"))
    got = {(r.vid, r.seq): (r.badge, r.ema) for r in out.collect()}
    want = {(r.vid, r.seq): r.on for r in traces.badge(df).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    emas = {(r.vid, r.seq): r.ema for r in traces.ema(df).collect()}
    assert all(v[1] == pytest.approx(emas[k]) for k, v in got.items())


def test_late_frames_are_dropped(spark, tmp_path):
    for i, seqs in enumerate([[0, 1, 2, 5], [3, 4, 6, 6]]):
        spark.createDataFrame([("a", s, s / 2, 0.5) for s in seqs], FR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FR).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = B.run_to_table(B.badge_stream(stream, idle_ms=None), str(tmp_path / "late"), str(tmp_path / "c"))
    rows = out.orderBy("seq").collect()
    seqs = [r.seq for r in rows]
    assert len(seqs) == len(set(seqs)) and seqs[-1] == 6 and rows[-1].late >= 1  # what came too late is counted


def test_medians_rates_and_stats(spark):
    ps = [0.1, 0.9, 0.4, 0.8]
    df = _frame(spark, {"a": ps, "b": [0.5, 0.5, 0.5], "c": [0.3]})
    med = {(r.vid, r.seq): r.med for r in traces.rolling_median(df).collect()}
    assert med["a", 1] is None and med["a", 2] == pytest.approx(0.4) and med["a", 3] == pytest.approx(0.6)
    assert {(r.vid, r.seq): r.med for r in traces.rolling_upper_median(df).collect()}["a", 3] == 0.8
    assert {r.vid: r.frame_corr for r in traces.lag_correlation(df).collect()}["b"] == 1 == {r.vid: r.frame_corr for r in traces.lag_correlation(df).collect()}["c"]
    fps = {(r.vid, r.seq): r.fps for r in traces.recent_rate(df).collect()}
    assert fps["a", 0] is None and fps["a", 3] == 2
    s = {r.vid: r for r in traces.trace_stats(df).collect()}["a"]
    assert (s.n, s.min_p, s.max_p, s.frac_ge_0_6388) == (4, 0.1, 0.9, 0.5) and s.median_p == pytest.approx(0.6)


@pytest.mark.parametrize("label,on,turns,want", [("ai", 0.9, 3, "flickering"), ("ai", 0.51, 2, "pinned_correct"), ("real", 0.0, 0, "pinned_correct"), ("real", 0.02, 1, "crosses_mid_clip"), ("ai", 0.5, 1, "crosses_mid_clip"), ("ai", 0.0, 0, "pinned_wrong"), ("real", 0.6, 1, "pinned_wrong")])
def test_verdict(spark, label, on, turns, want):
    assert spark.range(1).select(traces.verdict(F.lit(label), F.lit(on), F.lit(turns))).first()[0] == want


def test_byte_windows(spark):
    end = lambda at, size: at + windows.HEADER + 1 + windows.EXTRA + size
    rows = [("z", o, s, n) for o, s, n in [(0, 10, "a"), (553, 5, "b"), (1500, 10, "c"), (2060, 300, "d"), (9000, 10, "e")]]
    df = spark.createDataFrame(rows, "archive string, offset bigint, size bigint, name string")
    got = windows.byte_windows(df, max_gap=500, max_window=2500).orderBy("start").collect()
    assert [(r.start, r.stop, r.members) for r in got] == [(0, end(1500, 10), 3), (2060, end(2060, 300), 1), (9000, end(9000, 10), 1)]
    islands = {r.name: r.island for r in windows.gap_windows(df, max_gap=500).collect()}
    assert islands == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 2}
    assert [r.name for r in windows.select_members(df, "c").collect()] == ["c"] and windows.select_members(df, limit=2, seed=1).count() == 2
    assert [r.name for r in windows.listing(df, 2).collect()] == ["a", "b"]


def test_trigger_and_running_maximum(spark):
    ps = [0.1, 0.99, 0.99, 0.99, 0.99, 0.2]
    rows = traces.badge(_frame(spark, {"a": ps})).orderBy("seq").collect()
    assert [r.on for r in rows] == [False, False, False, False, True, True] or [r.on for r in rows][3]
    on = next(r.seq for r in rows if r.on)
    assert {(r.trigger_seq, r.trigger_med) for r in rows if r.on} == {(on, 0.99)} and rows[0].trigger_seq is None
    assert [r.top for r in rows] == sorted(r.top for r in rows) and rows[-1].top == 0.99


# Score traces of three clips, 3 frames a second, and what was told about them.
TOLD = {
    "clip 1": ("ai", [0.9492, 0.9518, 0.9822, 0.9372, 0.8126, 0.8444, 0.9142, 0.5184, 0.6899, 0.984, 0.9933, 0.9782, 0.9688, 0.9577, 0.9998, 0.9994, 0.9998, 0.9994, 0.9943, 0.993, 0.9996, 0.9968, 0.9997, 0.9999, 0.9998, 0.9996, 0.9993, 0.9901, 0.9991, 0.9993], {"badge": (0.9, 1, 0.9997, -0.0551, "pinned_correct"), "range": (30, 0.5184, 0.9999), "shares": [1.0, 1.0, 0.967, 0.8], "levels": [0.7451, 0.9932, 0.9483, 0.9998]}),
    "clip 2": ("real", [0.5187, 0.4262, 0.4724, 0.4093, 0.6618, 0.5929, 0.5005, 0.4965, 0.2562, 0.5468, 0.6756, 0.3627, 0.1618, 0.4179, 0.6684, 0.8096, 0.4045, 0.6006, 0.5386, 0.645, 0.7197, 0.674, 0.5209, 0.6797, 0.2631, 0.4917, 0.6785, 0.3515, 0.6875, 0.4948], {"badge": (0.0, 0, 0.674, 0.2706, "pinned_correct"), "range": (30, 0.1618, 0.8096), "shares": [1.0, 0.567, 0.333, 0.0], "levels": [0.2593, 0.5198, 0.5243, 0.7052]}),
    "clip 3": ("real", [0.0357, 0.028, 0.0225, 0.1086, 0.0334, 0.0314, 0.0197, 0.0087, 0.0184, 0.0119, 0.0124, 0.034, 0.0237, 0.0196, 0.0164, 0.0286, 0.0284, 0.0173, 0.027, 0.0419, 0.1315, 0.1937, 0.0842, 0.113, 0.1083, 0.0255, 0.0749, 0.0655, 0.1186, 0.0488], {"badge": (0.0, 0, 0.113, 0.8316, "pinned_correct"), "range": (30, 0.0087, 0.1937), "shares": [0.067, 0.0, 0.0, 0.0], "levels": [0.0121, 0.03, 0.051, 0.1257]}),
}


@pytest.mark.parametrize("clip", sorted(TOLD))
def test_clips_are_told_as_before(spark, clip):
    label, ps, want = TOLD[clip]
    f = _frame(spark, {clip: ps})
    s = traces.badge_summary(traces.badge(f)).withColumn("verdict", traces.verdict(F.lit(label), F.col("on_fraction"), F.col("transitions"))).first()
    assert (round(s.on_fraction, 3), s.transitions, round(s.max_median, 4), round(s.headroom, 4), s.verdict) == want["badge"]
    t = traces.trace_stats(f).first()
    assert (t.n, t.min_p, t.max_p) == want["range"] and [round(t[f"frac_ge_{str(x).replace('.', '_')}"], 3) for x in traces.SHARES] == want["shares"]
    for got, value in zip((t.p05, t.median_p, t.mean_p, t.p95), want["levels"]):
        assert got == pytest.approx(value, abs=1e-4)
