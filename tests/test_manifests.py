import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import strings as S
from gaugeworks.operators import leakage, sampling
from gaugeworks.sources import frames, manifests, sinks


def _touch(root, *paths):
    for p in paths:
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")


def test_label_csv(spark, tmp_path):
    _touch(tmp_path, "images/val2017/a.jpg", "images/val2017/b.jpg", "images/x/c.jpg", "csv/x")
    rows = ["Generator,Architecture,Weight,Category,IsAdvanced,IsFake,Image_path,Num"] + [f"g,a,w,c,1,0,{p},{i}" for i, p in enumerate(["./val2017/b.jpg", ".//val2017/a.jpg", "./x/c.jpg", "./val2017/gone.jpg"])]
    (tmp_path / "csv/real_coco.csv").write_text("\n".join(rows))
    got = manifests.label_csv(spark, str(tmp_path), "real_coco", path_filter="/val2017/")
    assert sorted(r.path[len(str(tmp_path)) + 1 :] for r in got.collect()) == ["images/val2017/a.jpg", "images/val2017/b.jpg"]
    assert {(r.label, r.source, r.meta["advanced"], r.harmonize) for r in got.collect()} == {(0, "wildfake:real_coco", "1", False)}
    assert manifests.label_csv(spark, str(tmp_path), "real_coco", require_exists=False).count() == 4
    one = [manifests.alternative_reals(spark, str(tmp_path), "real_coco", 1, seed).first().path for seed in (1, 1, 2, 3, 4)]
    assert one[0] == one[1] and len(set(one)) > 1
    train = manifests.training_manifest([got, got])
    assert {r.harmonize for r in train.collect()} == {True} and [r.pos for r in manifests.with_position(train).orderBy("pos").collect()] == [0, 1, 2, 3]
    assert manifests.training_set(spark, str(tmp_path), ["real_coco"]).count() == 0  # none under /test2017/
    with pytest.raises(manifests.PolicyError):
        manifests.training_set(spark, str(tmp_path), ["real_coco", "dalle3"])
    with pytest.raises(manifests.PolicyError):
        manifests.training_manifest([got.withColumn("source", F.lit("wildfake:dalle3"))])


def test_shards(spark, tmp_path):
    rows = [(f"i{i}", i % 3, (bytes([i]),)) for i in range(9)] + [("none", None, (b"n",))]
    spark.createDataFrame(rows, "img_id string, label int, image struct<bytes:binary>").coalesce(1).write.parquet(str(tmp_path / "s"))
    m = manifests.label_shards(spark, str(tmp_path / "s"), "sid_set", include_tampered=True)
    assert sorted(r.label for r in m.collect() if r.label is not None) == [0] * 3 + [1] * 6 and m.filter("label is null").count() == 1
    assert manifests.label_shards(spark, str(tmp_path / "s"), "sid_set").count() == 7
    assert manifests.label_shards(spark, str(tmp_path / "s"), "sid_set", n=3, include_tampered=True).filter("label is not null").groupBy("label").count().orderBy("label").collect()[0]["count"] == 1
    full = {r.meta["img_id"]: bytes(r.content) for r in manifests.shard_content(spark, str(tmp_path / "s"), m.filter("label = 1")).collect()}
    assert full == {f"i{i}": bytes([i]) for i in range(9) if i % 3}
    few = m.filter("label = 1")
    written = manifests.materialised(spark, str(tmp_path / "s"), few, str(tmp_path / "out"))
    assert sorted(r.path for r in written.collect()) == sorted(str(tmp_path / f"out/i{i}") for i in range(9) if i % 3) and (tmp_path / "out/i4").read_bytes() == bytes([4])
    (tmp_path / "out/i4").write_bytes(b"kept")
    (tmp_path / "out/i5").unlink()
    manifests.materialised(spark, str(tmp_path / "s"), few, str(tmp_path / "out"))
    assert (tmp_path / "out/i4").read_bytes() == b"kept" and (tmp_path / "out/i5").read_bytes() == bytes([5])
    ext = manifests.score_rows(spark, str(tmp_path / "s"), "image")
    assert ext.columns == ["path", "label", "model_name", "architecture", "real_source", "content"] and ext.first().model_name is None


def test_trees(spark, tmp_path):
    _touch(tmp_path, "test/ai/real/x_12.jpg", "train/fake/y.PNG", "train/other/z.jpg", "nature/deep/w_1_2.webp", "fake/readme.txt")
    got = {r.path: (r.label, r.split, r.category) for r in manifests.labelled_tree(spark, str(tmp_path)).collect()}
    assert got == {"test/ai/real/x_12.jpg": (0, "test", "x"), "train/fake/y.PNG": (1, "train", "y"), "nature/deep/w_1_2.webp": (0, None, "w_1")}
    _touch(tmp_path / "c", "train/REAL/1.png", "test/FAKE/2.png")
    assert {r.label for r in manifests.two_class_tree(spark, str(tmp_path / "c")).collect()} == {0, 1}
    assert manifests.pictures(spark, str(tmp_path / "c")).count() == 2


def test_json_feed_and_archive_members(spark, tmp_path):
    clip = {"id": "a", "label": "ai", "ship": True, "trim": {"start": 1.5, "duration": 3.0}}
    (tmp_path / "v.json").write_text(json.dumps({"clips": [clip, clip | {"id": "b", "ship": False}, clip | {"id": "c"}]}))
    clips = manifests.clip_manifest(spark, str(tmp_path / "v.json"))
    assert clips.filter("id = 'a'").first().trim.duration == 3.0
    present = spark.createDataFrame([("a",), ("b",)], "id string")
    feed = manifests.feed(clips, present, spark.createDataFrame([("c", 1)], "id string, n int")).collect()
    assert [(r.id, r.n) for r in feed] == [("a", None)]
    (tmp_path / "arm1/eval").mkdir(parents=True)
    (tmp_path / "arm1/eval/summary.json").write_text('{"clean_auc": 0.5}')
    s = manifests.summaries(spark, [str(tmp_path / "arm1/eval/summary.json"), str(tmp_path / "gone/eval/summary.json")])
    assert [(r.arm, r.clean_auc) for r in s.collect()] == [("arm1", 0.5)] and manifests.summaries(spark, []).count() == 0
    members = spark.createDataFrame([("d/x.jpg", 5), ("d/y.jpg", 6), ("d/z.jpg", 7)], "name string, size bigint")
    got = manifests.wanted_members(members, spark.createDataFrame([("x.jpg",), ("y.jpg",)], "name string"), spark.createDataFrame([("x.jpg", 1)], "name string, size bigint"))
    assert [r.name for r in got.collect()] == ["d/y.jpg"]
    assert [r.name for r in manifests.missing_members(members, spark.createDataFrame([("d/x.jpg", 5), ("d/y.jpg", 1)], "name string, size bigint")).orderBy("name").collect()] == ["d/y.jpg", "d/z.jpg"]
    shards = [r.shard for r in manifests.shard_numbers(spark).collect()]
    assert len(shards) == 30 and shards[-1] == 394 and manifests.training_shards(spark).groupBy("download").count().orderBy("download").collect()[1]["count"] == 16
    assert [r.shard for r in manifests.shard_numbers(spark, 2, 20, 22, 70).collect()] == [0, 1, 20, 42, 64]


def test_frames(spark):
    a, b = b"\xff\xd8one\xff\xd9", b"\xff\xd8two\xff\xd9"
    assert list(frames.split_frames(b"junk" + a + b"gap" + b + b"\xff\xd8cut")) == [(0, a), (1, b)]
    assert list(frames.split_frames(None)) == []
    frames.register(spark)
    spark.createDataFrame([(a + b,), (None,)], "data binary").createOrReplaceTempView("clips")
    got = spark.sql("select f.frame, f.content from clips, lateral frames(data) f").collect()
    assert sorted((r.frame, bytes(r.content)) for r in got) == [(0, a), (1, b)]


def test_strings(spark):
    df = spark.createDataFrame([("", "./../a/B.JPG", "x#y#12"), ("jpeg:30|blur:1.0|crop:0.8", "/a.tar.gz", "none")], "plan string, path string, pointer string")
    r = df.select(S.plan_steps(F.col("plan")).alias("s"), S.strip_leading(F.col("path")).alias("p"), S.extension(F.col("path")).alias("e"), S.shard_of(F.col("pointer")).alias("h"), S.row_of(F.col("pointer")).alias("n")).collect()
    assert r[0].s == [] and [(x.family, x.level) for x in r[1].s] == [("jpeg", 30.0), ("blur", 1.0), ("crop", 0.8)]
    assert (r[0].p, r[0].e, r[0].h, r[0].n) == ("a/B.JPG", "jpg", "x#y", 12) and (r[1].e, r[1].n) == ("gz", None)
    assert df.select(S.plan_text(S.plan_steps(F.col("plan"))).alias("t")).collect()[1].t == "jpeg:30.0|blur:1.0|crop:0.8"


H = "pos int, path string, content_hash string"


def test_leakage_and_keep_first(spark):
    df = spark.createDataFrame([(0, "a", "X"), (1, "b", None), (2, "c", "x"), (3, "d", None), (4, "e", "y")], H)
    assert [r.pos for r in leakage.keep_first(df, "content_hash", ["pos"]).orderBy("pos").collect()] == [0, 1, 4]
    excl = leakage.exclusion_list(df.filter("pos in (1, 2)"))
    assert [r.content_hash for r in excl.collect()] == ["x"]
    assert [r.pos for r in leakage.without_leaks(df, excl).orderBy("pos").collect()] == [1, 3, 4]
    with pytest.raises(leakage.LeakageError, match="'a', 'c'"):
        leakage.assert_no_leak(df, excl)
    leakage.assert_no_leak(df.filter("pos = 4"), excl)
    with pytest.raises(leakage.LeakageError, match="empty"):
        leakage.assert_no_leak(df.filter("pos = 4"), excl.limit(0))


def test_exclusion_list_that_is_missing_or_empty_is_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        leakage.read_exclusion(spark, str(tmp_path / "none"))
    (tmp_path / "empty").write_text("\n \n")
    with pytest.raises(leakage.LeakageError):
        leakage.read_exclusion(spark, str(tmp_path / "empty"))
    (tmp_path / "list").write_text("ab\ncd\n")
    assert sorted(r.content_hash for r in leakage.read_exclusion(spark, str(tmp_path / "list")).collect()) == ["ab", "cd"]


def test_names_digests_and_problems(spark):
    df = spark.createDataFrame([("ok_1", 5, bytearray(b"abc"), ["a"], ["b", "a"]), ("Bad id", 0, None, None, ["c"])], "id string, n int, body binary, x array<string>, y array<string>")
    r = df.select(S.is_clip_id(F.col("id")).alias("id"), S.file_digest(F.col("body")).alias("d"), S.cache_key(F.col("id"), F.col("n").cast("string")).alias("k"), S.all_names(F.col("x"), F.col("y")).alias("u"), S.head_map(["p", "q"], [F.col("n"), F.col("n") + 1]).alias("m"), S.problems([(F.col("n") < 1, F.lit("few")), (~S.is_clip_id(F.col("id")), F.lit("bad id"))]).alias("why")).collect()
    assert [x.id for x in r] == [True, False] and r[0].d.startswith("ba7816bf") and r[1].d is None and len(r[0].k) == 10
    assert r[0].u == ["a", "b"] and r[1].u == ["c"] and r[0].m == {"p": 5, "q": 6} and [x.why for x in r] == [None, "few, bad id"]
    assert spark.range(1).select(S.class_ratio(F.lit(1), F.lit(1234567))).first()[0] == "1:1234567.00"


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert manifests.read_config(str(tmp_path / "c.json")) == {"a": {"b": 1}}
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a:\n  b: [1, 2]\n")
    assert manifests.read_config(str(tmp_path / "c.yaml")) == {"a": {"b": [1, 2]}}


def test_sampling(spark):
    df = spark.createDataFrame([(f"p{i}", int(i % 4 == 0), f"g{i // 10}") for i in range(400)], "path string, label int, grp string")
    a = {r.path for r in sampling.seeded_sample(df, 50, 1).collect()}
    more = df.unionByName(spark.createDataFrame([("new", 0, "g")], df.schema))
    assert len(a) == 50 and len(a & {r.path for r in sampling.seeded_sample(more, 50, 1).collect()}) >= 49  # a new row moves no other draw
    n = {r.label: r["count"] for r in sampling.stratified_sample(df, 101, 2).groupBy("label").count().collect()}
    assert n == {0: 76, 1: 25}
    assert sampling.stratified_sample(df, 10_000, 2).count() == 400
    split = sampling.grouped_split(df, "grp", 5)
    assert split.select("grp", "part").distinct().count() == 40 and split.filter("part = 'test'").select("grp").distinct().count() == 13  # the first third, exactly
    assert sampling.grouped_split(df.limit(0), "grp", 5).count() == 0
    drawn = sampling.weighted_draws(df.join(sampling.class_weights(df).select("label", "weight"), "label"), 4000, 1).groupBy("label").agg(F.sum("draws").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert all(abs(r.n - 2000) < 200 for r in drawn) and {r.label: r.rows for r in drawn}[1] == 100
    many = sampling.weighted_draws(df.limit(2).withColumn("weight", F.lit(1.0)), 201, 1).collect()
    assert all(r.draws in (100, 101) for r in many)
    assert {r.label: r.weight for r in sampling.class_weights(df).collect()} == {0: 1 / 300, 1: 1 / 100}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5), ("a", -0.2), ("c", None)], "path string, p double")
    assert sinks.write_predictions(df, str(tmp_path / "pred.json")) == (2, 1)
    assert json.load(open(tmp_path / "pred.json")) == [{"image_path": "a", "pred": 0.0}, {"image_path": "b", "pred": 1.0}]
    assert sinks.write_list(df, "path", str(tmp_path / "list")) == 3
    assert [r.value for r in spark.read.text(str(tmp_path / "list")).collect()] == ["a", "b", "c"]
    sinks.write_table(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 3
    assert sinks.markdown(df.orderBy("path"), ["path", "gone", "p"]).splitlines() == ["| path | p |", "|---|---|", "| a | -0.2000 |", "| b | 1.5000 |", "| c |  |"]
    sinks.save_head(spark, [(0, [0.0], 0.0), (1, [1.0], 0.5)], "h", 3, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).first().head[1].bias == 0.5
    assert sinks.write_predictions(df, str(tmp_path / "parts"), parts=True) == (2, 1) and spark.read.json(str(tmp_path / "parts")).count() == 2
    assert sinks.write_predictions(df.limit(0), str(tmp_path / "none.json")) == (0, 0) and json.load(open(tmp_path / "none.json")) == []
    best = [sinks.save_best_head(spark, [(0, [0.0], 0.0), (1, [float(i)], 0.0)], "h", i, v, str(tmp_path / "best")) for i, v in enumerate([0.7, 0.7, 0.6, 0.9])]
    assert best == [True, False, False, True] and sinks.read_head(spark, str(tmp_path / "best")) == ([[0.0], [3.0]], [0.0, 0.0])


def test_feature_store(spark, tmp_path):
    m = spark.createDataFrame([("a", 1), ("b", 0)], "path string, label int")
    calls = []

    def extract(d):
        calls.append(1)
        return d.select("path", F.array(F.lit(1.0)).alias("feats"))

    store = sinks.FeatureStore(str(tmp_path / "store"))
    for frame, want in ((m, 1), (m.orderBy("label"), 1), (m.limit(1), 2)):
        assert store.get_or_extract(frame, "stub", "clean", extract).count() == frame.count() and len(calls) == want
    assert store.one(spark, "clean").count() == 1
    with pytest.raises(FileNotFoundError):
        store.read(spark, "jpeg_90")
