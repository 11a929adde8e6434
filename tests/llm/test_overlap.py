import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import overlap

SAMPLES = "sample_id bigint, path string, split string, content_hash string, phash string, source string, label int, key string, item string"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=9).map(lambda b: bytes(3 + x % 3 for x in b)), min_size=1, max_size=30), st.lists(st.binary(max_size=6).map(lambda b: bytes(1 + x % 5 for x in b)), max_size=20))
def test_backward_search_counts_and_maximal_matches(keys, patterns):
    text = b"\x01" + b"\x01".join(sorted(keys)) + b"\x01\x00"
    length = np.array([len(p) for p in patterns], dtype=np.int64)
    index = overlap.TextIndex.from_bytes(overlap.TextIndex(list(keys)).to_bytes())
    matched, times = index.search(np.frombuffer(b"".join(patterns), np.uint8), np.cumsum(length), length)
    for p, m, n in zip(patterns, matched, times):
        longest = max(n for n in range(len(p) + 1) if p[len(p) - n :] in text)
        assert m == longest
        assert n == (sum(text.startswith(p[len(p) - m :], i) for i in range(len(text))) if m else 0)


def test_suffixes_of_repetitive_text():
    rng = random.Random(2)
    for text in (b"ab" * 400, b"a" * 300, bytes(rng.choice(b"xyz") for _ in range(2000)), b"q"):
        order = overlap.suffix_order(np.frombuffer(text + b"\x00", np.uint8))
        assert order.tolist() == sorted(range(len(text) + 1), key=lambda i: text[i:] + b"\x00")


def test_index_is_smaller_than_its_text():
    rng = random.Random(1)
    keys = [f"p:data/wild/images/{rng.choice(['real', 'fake'])}/img_{i:09d}".encode() for i in range(20_000)] + [f"h:{rng.getrandbits(160):040x}".encode() for _ in range(20_000)]
    index = overlap.TextIndex(keys)
    assert index.size < 0.9 * sum(len(k) + 1 for k in keys)
    asked = [*keys[::100], *(k + b"0" for k in keys[::100]), *(k[:-1] for k in keys[::100])]
    flat, end, length = overlap._patterns(asked)
    matched, times = index.search(flat, end, length)
    assert ((matched == length) & (times == 1)).tolist() == [True] * 400 + [False] * 800


@pytest.mark.parametrize("shard_bytes,rows_each", [(16_000_000, 200_000), (300, 40)])
def test_streamed_keys_are_those_of_the_other_side(spark, shard_bytes, rows_each):
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("ab\x01\x02/é") for _ in range(rng.randrange(6)))
    rows = [(i, name(), i % 3 > 0) for i in range(900)]
    held = {k for _, k, t in rows if not t}
    got = overlap.stream_through_index(spark.createDataFrame(rows, "item bigint, key string, train boolean"), shard_bytes, rows_each).collect()
    assert sorted((r.item, r.key) for r in got) == sorted((i, k) for i, k, t in rows if t and k in held)


@pytest.mark.parametrize("path", ["data/a/IMG_1.jpg", "./data/a/img_1.PNG", ".//data//a/./img_1.webp", "DATA\\A\\IMG_1.JPEG", "d%61ta/x/../a/img%5F1.bmp", "/data/a/img_1.jpg", "d%2561ta/a/img_1.jpg", "../data/a/img_1.jpg"])
def test_spellings_of_one_file(spark, path):
    assert spark.createDataFrame([(path,)], "path string").select(overlap.file_key("path")).first()[0] == "data/a/img_1"


@pytest.mark.parametrize("layers", [4, 5, 12])
def test_every_layer_of_encoding_is_undone(spark, layers):
    path = "d%" + "25" * (layers - 1) + "61ta/a/100%/img_1.jpg"
    assert spark.createDataFrame([(path,)], "path string").select(overlap.file_key("path")).first()[0] == "data/a/100%/img_1"


def test_other_files(spark):
    paths = ["data/a/img_1.gif", "data/a/img_2.jpg", "s.parquet#12", "s.parquet#1", "100%.jpg", "a+b.jpg", "a b.jpg", None]
    keys = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "path string").select(overlap.file_key("path")).collect()]
    assert keys == ["data/a/img_1.gif", "data/a/img_2", "s.parquet#12", "s.parquet#1", "100%", "a+b", "a b", None]


def _flip(h, bits):
    return f"{int(h, 16) ^ sum(1 << b for b in bits):032x}"


def _brute(rows):
    t = [(r, int(r[4], 16)) for r in rows if r[2].strip().lower() == "train" and r[4] and int(r[4], 16)]
    o = [(r, int(r[4], 16)) for r in rows if r[2].strip().lower() != "train" and r[4] and int(r[4], 16)]
    return {(a[0], b[0]) for a, x in t for b, y in o if (x ^ y).bit_count() <= 10}


def test_near_pictures_match_brute_force(spark):
    rng = random.Random(4)
    base = [f"{rng.getrandbits(128):032x}" for _ in range(150)]
    rows = []
    for i in range(900):
        h = _flip(rng.choice(base), rng.sample(range(128), rng.randrange(14)))
        rows.append((i, f"p{i}", rng.choice(["train", " Train", "val", "test"]), None, h.upper() if i % 5 == 0 else h, "s", 0, "k", "i"))
    rows += [(5000 + i, f"q{i}", "train", None, "0" * 32, "s", 0, "k", "i") for i in range(5)] + [(6000, "z", "val", None, "0" * 32, "s", 0, "k", "i"), (6001, "z1", "val", None, "zz", "s", 0, "k", "i")]
    got = overlap.cross_split_pairs(spark.createDataFrame(rows + rows[:40], SAMPLES)).collect()
    assert {(r.train_id, r.other_id) for r in got} == _brute([r for r in rows if r[4] != "zz"])
    assert all(r.near_picture and not r.same_file and not r.same_pixels for r in got)


def test_hot_buckets_are_salted(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_BUCKET", 20)
    rng = random.Random(5)
    centre = rng.getrandbits(128)
    rows = [(f"{centre ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(9))):032x}", i % 2 == 0) for i in range(300)]
    got = {(r.eval_hash, r.train_hash) for r in overlap.near_phashes(spark.createDataFrame(rows, "phash string, train boolean")).collect()}
    want = {(e, t) for t, x in rows if x for e, y in rows if not y and (int(e, 16) ^ int(t, 16)).bit_count() <= 10}
    assert got == want


def _hashes(values):
    return [v.to_bytes(16, "big") for v in values]


def _near_by_rows(a, b):
    (ah, al), (bh, bl) = overlap._words(a), overlap._words(b)
    return {(int(i), j) for j in range(len(b)) for i in np.flatnonzero(np.bitwise_count(ah ^ bh[j]) + np.bitwise_count(al ^ bl[j]) <= 10)}


def test_hot_segment_needs_little_memory():
    rng = random.Random(6)
    a = [(0xABCDE << 108) | rng.getrandbits(108) for _ in range(20_000)]
    b = [(0xABCDE << 108) | rng.getrandbits(108) for _ in range(19_600)] + [a[i] ^ sum(1 << t for t in rng.sample(range(108), 1 + i % 12)) for i in range(400)]
    a, b = _hashes(a), _hashes(b)
    tracemalloc.start()
    i, j, bits = overlap.near_hashes(a, b, np.zeros(len(a), int), np.zeros(len(b), int))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6
    assert set(zip(i.tolist(), j.tolist())) == _near_by_rows(a, b) and bits.max() == 10


@pytest.mark.parametrize("shared", [20, 60, 100])
def test_hot_segments_cut_by_further_digits_lose_no_pair(monkeypatch, shared):
    monkeypatch.setattr(overlap, "HOT_PAIRS", 300)
    monkeypatch.setattr(overlap, "PAIRS", 1000)
    rng = random.Random(shared)
    head = rng.getrandbits(shared) << (128 - shared)
    base = [head | rng.getrandbits(128 - shared) for _ in range(30)]
    a, b = ([rng.choice(base) ^ sum(1 << t for t in rng.sample(range(108), rng.randrange(8))) for _ in range(400)] for _ in range(2))
    a, b = _hashes(a), _hashes(b)
    i, j, _ = overlap.near_hashes(a, b, np.zeros(len(a), int), np.zeros(len(b), int))
    assert set(zip(i.tolist(), j.tolist())) == _near_by_rows(a, b)


def test_kinds_nulls_and_report(spark):
    rows = [(1, "d/a.jpg", "train", "AB", None, "s", 0, "", ""), (2, "d\\A.png", "val", None, None, " S ", 1, "", ""), (3, None, "test", "ab", None, None, None, "", ""), (4, "d/a.jpg", None, "ab", None, "s", 0, "", ""), (5, "x", "train", None, None, "s", 0, "", ""), (6, None, "val", None, None, "s", 0, "", ""), (None, "d/a.jpg", "val", "ab", None, "s", 0, "", "")]
    df = spark.createDataFrame(rows + rows[:2], SAMPLES)
    got = {(r.train_id, r.other_id, r.same_file, r.same_pixels) for r in overlap.cross_split_pairs(df).collect()}
    assert got == {(1, 2, True, False), (1, 3, False, True)}
    rep = {(r.split, r.source): (r.records, r.overlapping, r.same_file) for r in overlap.overlap_report(df).collect()}
    assert rep == {("val", "s"): (2, 1, 1), ("test", None): (1, 1, 0)}


def test_empty_and_one_sided(spark):
    none = spark.createDataFrame([], SAMPLES)
    assert overlap.cross_split_pairs(none).count() == 0 and overlap.overlap_report(none).count() == 0
    only = spark.createDataFrame([(1, "a", "train", "x", "1" * 32, "s", 0, "", "")], SAMPLES)
    assert overlap.cross_split_pairs(only).count() == 0
