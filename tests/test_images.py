"""Picture operators: what each must keep and what it must change, on pictures made here."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.functions import images as I


def _checker(h, w, size=4, low=40, high=210):
    y, x = np.mgrid[:h, :w]
    return np.where(((y // size + x // size) % 2)[..., None] > 0, high, low).astype(np.uint8).repeat(3, -1)


def _random(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def _miss(a, b):
    return np.abs(a.astype(float) - np.asarray(b, float)).mean()


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 24), st.integers(1, 24), st.integers(0, 255))
def test_flat_pictures_stay_flat(h, w, grey):
    flat = np.full((h, w, 3), grey, np.uint8)
    for f in (lambda x: I.blur(x, 1.5), lambda x: I.resize_down_up(x, 0.5), lambda x: I.squish(x, 7), lambda x: I.crop(x, 0.8)):
        assert _miss(f(flat), grey) == 0
    assert _miss(I.jpeg(flat, 90), grey) <= 2


def test_blur_keeps_the_mean_and_spreads():
    x = _checker(64, 64)
    assert abs(I.blur(x, 2.0).mean() - x.mean()) < 0.6
    spread = [I.blur(x, s).astype(float).std() for s in (0.5, 1.0, 2.0)]
    assert spread[0] > spread[1] > spread[2]
    dot = np.zeros((21, 21, 3), np.uint8)
    dot[10, 10] = 255
    assert np.array_equal(I.blur(dot, 1.0), I.flip(I.blur(dot, 1.0)))


def test_jpeg_error_follows_quality_and_colour_is_coarser():
    x = I.blur(_random(64, 48, 1), 2.0)
    miss = [_miss(I.jpeg(x, q), x) for q in (95, 75, 40, 10)]
    assert miss == sorted(miss) and miss[0] < 3
    red = np.zeros((32, 32, 3), np.uint8)
    red[:, ::2, 0] = 200  # colour changes from pixel to pixel: half the resolution cannot hold it
    assert _miss(I.jpeg(red, 100), red) > 10 * _miss(I.jpeg(_checker(32, 32, 1), 100), _checker(32, 32, 1))
    assert I.jpeg(_random(13, 9), 50).shape == (13, 9, 3)
    assert np.array_equal(I.jpeg(x, 50, codec=lambda img, q: img + q), x + 50)
    assert np.array_equal(I.harmonized(x), I.jpeg(x, 90))


def test_resizing():
    x = _random(30, 50, 2)
    assert np.array_equal(I.resize(x, 30, 50), x) and np.array_equal(I.resize(x, 30, 50, I.cubic), x)
    assert I.squish(x, 11).shape == (11, 11, 3)
    ramp = np.linspace(0, 255, 64).astype(np.uint8)[None, :, None].repeat(8, 0).repeat(3, -1)
    assert _miss(I.resize(ramp, 8, 32), ramp.reshape(8, 32, 2, 3).mean(2)) < 1.5
    edge = np.zeros((1, 16, 3), np.uint8)
    edge[:, 8:] = 200
    up = I.resize(edge, 1, 64, I.cubic).astype(int)[0, :, 0]
    assert up.max() > 200 and (np.diff(I.resize(edge, 1, 64).astype(int)[0, :, 0]) >= 0).all()  # the cubic kernel overshoots, the triangle does not
    assert [I.resize_down_up(_random(3, 2), f).shape for f in (0.5, 0.25, 0.01)] == [(3, 2, 3)] * 3


def test_noise_and_colour_belong_to_their_seed():
    x = np.full((128, 128, 3), 120, np.uint8)
    for sigma in (0.02, 0.1):
        assert abs((I.noise(x, sigma, 5) / 255).std() / sigma - 1) < 0.05
    for f in (lambda s: I.noise(x, 0.1, s), lambda s: I.color(_random(8, 8), 0.2, s)):
        assert np.array_equal(f(1), f(1)) and not np.array_equal(f(1), f(2))
    grey = I.color(x, 0.2, 3)
    assert (grey[..., 0] == grey[..., 2]).all() and 0.8 * 120 - 1 <= grey[0, 0, 0] <= 1.2 * 120 + 1


def test_crop_flip_tensor_hash():
    x = _random(25, 40, 3)
    assert np.array_equal(I.crop(x, 0.8), x[2:22, 4:36]) and np.array_equal(I.flip(x)[:, 0], x[:, -1])
    t = I.tensor(x)
    assert t.shape == (3, 25, 40) and np.allclose((t.transpose(1, 2, 0) * 0.5 + 0.5) * 255, x, atol=1e-3)
    assert I.content_hash(x) == I.content_hash(x.copy()) != I.content_hash(x[:, :-1])


def test_conditions_are_those_of_the_registry():
    x = _checker(40, 40, 3)
    assert I.under_condition(x, "clean") is x
    assert sum(len(f.levels) for f in I.FAMILIES.values()) == 14
    assert all(not np.array_equal(I.under_condition(x, name, v, 1), x) for name, f in I.FAMILIES.items() for v in f.levels)
    with pytest.raises(KeyError):
        I.under_condition(x, "sepia", 1)


def test_plans_follow_their_rule():
    plans = [I.plan_of(3, f"row {i}", 0.75) for i in range(4000)]
    assert abs(sum(not p for p in plans) / 4000 - 0.25) < 0.03
    sizes = np.bincount([len(p) for p in plans if p], minlength=4)[1:] / sum(map(bool, plans))
    assert np.abs(sizes - 1 / 3).max() < 0.04
    drawn = np.bincount([list(I.FAMILIES).index(f) for p in plans for f, _ in p]) / sum(map(len, plans))
    assert np.abs(drawn - 1 / 6).max() < 0.02
    levels = [v for p in plans for f, v in p if f == "jpeg"]
    assert all(abs(levels.count(v) / len(levels) - 0.25) < 0.06 for v in I.FAMILIES["jpeg"].levels)
    assert I.plan_of(3, "row 7", 0.75) == plans[7] and I.plan_of(4, "row 7", 1.0) != I.plan_of(5, "row 7", 1.0) and I.plan_of(1, "x", 0.0) == []
    x = _random(12, 12)
    assert np.array_equal(I.degraded(x, 1, "k", prob=0.0, hflip=0.0), x) and np.array_equal(I.degraded(x, 1, "k", prob=0.0, hflip=1.0), I.flip(x))
    assert np.array_equal(I.degraded(x, 1, "k"), I.degraded(x, 1, "k"))


def _png(channels, kind, rows, w, h, palette=None):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
    return head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_round_trip_filters_and_kinds():
    x = _random(9, 14, 4)
    data = I.encode_png(x)
    assert np.array_equal(I.decode_png(data), x)
    for bad in (b"", b"nonsense", data[:60], data.replace(b"IDAT", b"JDAT")):
        with pytest.raises(ValueError):
            I.decode_png(bad)
    assert I.decode_png(_png(1, 0, b"\0\5\6", 2, 1)).tolist() == [[[5, 5, 5], [6, 6, 6]]]
    assert I.decode_png(_png(1, 3, b"\0\1\0", 2, 1, bytes([1, 2, 3, 9, 8, 7]))).tolist() == [[[9, 8, 7], [1, 2, 3]]]
    assert I.decode_png(_png(4, 6, b"\0" + bytes([1, 2, 3, 128]), 1, 1)).tolist() == [[[1, 2, 3]]]
    # the five filters, of grey pictures: 10 20 30 over 11 22 33
    rows = {0: [11, 22, 33], 1: [11, 11, 11], 2: [1, 2, 3], 3: [6, 7, 7], 4: [1, 2, 3]}
    for f, line in rows.items():
        assert I.decode_png(_png(1, 0, bytes([0, 10, 20, 30, f, *line]), 3, 2))[1, :, 0].tolist() == [11, 22, 33], f


def test_udfs_and_failures(spark):
    p = _random(16, 20)
    rows = [("a", 20, 16, bytearray(p.tobytes())), ("b", 20, 16, bytearray(b"short")), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "path string, width int, height int, rgb binary").withColumn("picture", F.struct("width", "height", "rgb"))
    got = {r.path: r for r in df.select("path", I.condition_udf("crop", 0.5)("picture", "path").alias("x"), I.content_hash_udf("picture").alias("h"), I.stub_features("picture").alias("f"), I.plan_udf(1)("path").alias("plan"), I.degrade_udf(1)("picture", "path").alias("d"), I.encode_udf("picture").alias("png"), I.harmonize_udf("picture", F.lit(True)).alias("hz")).collect()}
    assert (got["a"].x.width, got["a"].x.height) == (10, 8) and bytes(got["a"].x.rgb) == np.ascontiguousarray(I.crop(p, 0.5)).tobytes()
    assert got["a"].h == I.content_hash(p) and len(got["a"].f) == 8 and got["b"].h is None and got["c"].f is None and got["b"].x.rgb is None
    assert bytes(got["a"].hz.rgb) == I.jpeg(p, 90).tobytes() and got["c"].png is None
    back = spark.createDataFrame([(bytearray(got["a"].png),), (bytearray(b"no"),), (None,)], "png binary").select(I.decode_udf("png").alias("x")).collect()
    assert bytes(back[0].x.rgb) == p.tobytes() and back[1].x.rgb is None and back[2].x.width is None
    ok = F.col("h").isNotNull()
    d = df.select("path", I.content_hash_udf("picture").alias("h")).withColumn("v", F.lit(1)).persist()
    assert I.on_failure(d, ok, "drop").count() == 1
    assert {r.path: r.h for r in I.on_failure(d, ok, "placeholder", h="black").collect()}["b"] == "black"
    with pytest.raises(Exception, match="could not be read"):
        I.on_failure(d, ok, "fail").collect()
    with pytest.raises(ValueError):
        I.on_failure(d, ok, "other")
