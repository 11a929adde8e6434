import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import grids
from gaugeworks.sources import sinks
from gaugeworks.streaming import badge as B

SCHEMA = "vid string, seq bigint, t double, p double, sent_at timestamp, received_at timestamp"


def _rows():
    at = dt.datetime(2025, 1, 1)
    rows = []
    for s in range(10):
        sent = at + dt.timedelta(seconds=10 * s)
        rows.append(("a", s, s / 2, 0.5 if s % 3 else None, sent, sent + dt.timedelta(seconds=1 if s < 8 else 3600)))
    return rows + rows[:2]


def test_stale_and_repeated_frames_are_dropped(spark, tmp_path):
    spark.createDataFrame(_rows(), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = B.run_to_table(B.fresh_frames(stream, "30 seconds"), str(tmp_path / "fresh"), str(tmp_path / "c"))
    assert sorted(r.seq for r in out.collect()) == list(range(8))


def test_event_time_windows(spark, tmp_path):
    spark.createDataFrame(_rows()[:10], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = B.run_to_table(B.window_counts(stream), str(tmp_path / "minutes"), str(tmp_path / "c"), "complete")
    got = {r.w.start.minute: (r.frames, r.scored) for r in out.collect()}
    assert got == {0: (6, 4), 1: (4, 2)}


def test_conditions_are_expanded_in_place(spark):
    conditions = spark.createDataFrame([(0, "clean", None, "clean"), (1, "jpeg", "90", "jpeg_90")], "ord int, transform string, level string, tag string")
    got = grids.expand_conditions(spark.createDataFrame([("x",), ("y",)], "path string"), conditions)
    assert got.count() == 4 and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    spelt = spark.createDataFrame([("JPEG@90.0",), (" Clean",), ("jpeg",), (None,)], "condition string")
    assert sorted(r.tag for r in grids.with_tag(spelt, conditions).collect()) == ["clean", "jpeg_90"]


def test_validation_document(spark, tmp_path):
    v = spark.createDataFrame([("a", 0, "s"), ("b", 1, None)], "path string, label int, source string")
    sinks.write_validation(v, v.limit(0), str(tmp_path / "v.json"))
    assert json.load(open(tmp_path / "v.json")) == {"val": [["a", 0, "s"], ["b", 1, None]], "alt_real": []}


def test_ingress_rejects_and_counts(spark, tmp_path):
    rows = [("a", 0, bytearray(b"x"), 0.5), ("a", 1, bytearray(), None), ("a", 2, None, None), ("a", 3, bytearray(b"x" * 40), None), ("a", 4, bytearray(b"bad"), None)]
    df = spark.createDataFrame(rows, "vid string, seq int, body binary, p double")
    live, dead = B.live_and_dead(B.admitted(df, most=30, ok=F.col("body") != b"bad"))
    assert [r.seq for r in live.collect()] == [0] and {r.seq: r.reject for r in dead.collect()} == {1: "400 empty body", 2: "400 empty body", 3: "413 frame too large", 4: "400 undecodable"}
    assert "body" not in dead.columns and B.cadence(500, 2) == "1000 milliseconds"
    df.select("vid", "p").write.parquet(str(tmp_path / "in"))
    seen = B.counted(spark.readStream.schema("vid string, p double").parquet(str(tmp_path / "in")))
    q = seen.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(x["observedMetrics"]["frames"]["scored"] for x in map(json.loads, (p.json for p in q.recentProgress)) if x.get("observedMetrics")) == 1


def test_head_switch(spark):
    df = spark.createDataFrame([("a", {"x": 0.1, "y": 0.9})], "vid string, heads map<string,double>").withColumn("p", F.lit(0.0))
    r = B.with_head(df, "y", ["x", "y"]).first()
    assert (r.vid, r.p, r.active_head) == ("a@y", 0.9, "y")
    with pytest.raises(KeyError):
        B.with_head(df, "z", ["x", "y"])
