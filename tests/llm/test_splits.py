import random
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugeworks import storage
from gaugeworks.llm import splits

SAMPLES = "sample_id bigint, source string, meta map<string,string>, component string, split string, key string"


def _components(links):
    """Smallest member of each item's component, by union of sets."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for item, key in links:
        a, b = find(("i", item)), find(("k", key))
        root[a] = b
    groups = defaultdict(set)
    for item, _ in links:
        groups[find(("i", item))].add(item)
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("keys", [30, 400, 2000])
def test_components_match_union_find(spark, keys):
    rng = random.Random(keys)
    links = [(rng.randrange(10_000), f"k{rng.randrange(keys)}") for _ in range(1200)]
    links += [(20_000 + i, f"c{i + j}") for i in range(300) for j in (0, 1)]  # a chain
    links += [(40_000 + i, "hot") for i in range(2000)]
    members, table, _ = splits.link_components(spark.createDataFrame(links + links[:100], "item bigint, key string"))
    want = _components(links)
    assert {r.item: r.component for r in members.collect()} == want
    assert {r.key: r.component for r in table.collect()} == {k: want[i] for i, k in links}


def test_hot_keys_take_the_other_path(spark, monkeypatch):
    monkeypatch.setattr(splits, "HOT_LEAST", 50)
    links = [(i, "hot") for i in range(500)] + [(i, f"k{i % 40}") for i in range(400, 700)]
    members = splits.link_components(spark.createDataFrame(links, "item bigint, key string"))[0]
    assert {r.item: r.component for r in members.collect()} == _components(links)


def test_links_of_records(spark):
    rows = [(1, "val:wildfake:A", {"author": " Jo  Doe"}, "", "", ""), (2, "x", {"Creator": "JO DOE\t"}, "", "", ""), (3, None, {"photographer": "jo doe", "img_id": "p1"}, "", "", ""), (4, "external:wildfake:a ", {"img_id": "P9"}, "", "", ""), (5, "wildfake:a", {"img_id": "p9 "}, "", "", ""),
            (6, "wildfake:b", {"img_id": "p9"}, "", "", ""), (7, "s", {"author": "N/A"}, "", "", ""), (8, "s", {"author": "unknown"}, "", "", ""), (9, "s", None, "", "", ""), (10, "s", {}, "", "", ""), (11, "s", {"author": None}, "", "", ""), (None, "s", {"author": "jo doe"}, "", "", ""), (12, None, {"img_id": "p1"}, "", "", "")]
    df = spark.createDataFrame(rows + rows[:3], SAMPLES)
    assert {tuple(r) for r in splits.linked_records(df).collect()} == {(1, 2), (1, 3), (4, 5)}


TARGETS = [("train", 8.0), ("val", 1.0), ("test", 1.0)]


def test_shares_and_related_records(spark):
    rng = random.Random(1)
    rows = [(i, "s", {"author": f"a{rng.randrange(700)}"} if i % 3 else {}, "", "", "") for i in range(4000)] + [(9000 + i, "s", {"author": "hot"}, "", "", "") for i in range(1500)]
    df = spark.createDataFrame(rows, SAMPLES)
    targets = spark.createDataFrame(TARGETS, "split string, share double")
    got, _, comps = splits.assign_splits(df, targets)
    rows_ = got.collect()
    assert len(rows_) == 5500 == len({r.sample_id for r in rows_})
    assert all(len({r.split for r in rows_ if r.component == c}) == 1 for c in {r.component for r in rows_ if r.component % 50 == 0})
    share = {r.split: r.share for r in splits.split_report(got).collect()}
    assert share["train"] == pytest.approx(0.8, abs=0.01) and share["val"] == pytest.approx(0.1, abs=0.01) and share["test"] == pytest.approx(0.1, abs=0.01)
    assert comps.agg(F.sum("records")).first()[0] == 5500


def test_later_records_keep_splits_and_conflicts_are_quarantined(spark):
    targets = spark.createDataFrame(TARGETS, "split string, share double")
    first = spark.createDataFrame([(i, "s", {"author": f"a{i // 4}"}, "", "", "") for i in range(400)], SAMPLES)
    one, keys, comps = splits.assign_splits(first, targets)
    of = {r.sample_id: r.split for r in one.collect()}
    a = next(i for i in of if of[i] == "train") // 4
    b = next(i for i in of if of[i] == "test") // 4
    later = [(1000, "s", {"author": f"a{a}"}, "", "", ""), (1001, "s", {"author": f"a{b}", "img_id": "x"}, "", "", ""), (1002, "s", {"author": "new"}, "", "", "")]
    two, keys2, comps2 = splits.assign_splits(spark.createDataFrame(later, SAMPLES), targets, (keys, comps))
    got = {r.sample_id: r.split for r in two.collect()}
    assert got[1000] == "train" and got[1001] == "test" and got[1002] in ("train", "val", "test")
    clash = spark.createDataFrame([(2000, "s", {"author": f"a{a}", "img_id": "x"}, "", "", "")], SAMPLES)
    three, _, comps3 = splits.assign_splits(clash, targets, (keys2, comps2))
    assert three.first().split == splits.QUARANTINE
    final = {r.component: (r.records, r.split) for r in comps3.collect()}
    assert final[min(4 * a, 4 * b)] == (11, splits.QUARANTINE) and sum(n for n, _ in final.values()) == 404


def test_components_are_kept_between_runs(spark, tmp_path, monkeypatch):
    meta = "sample_id bigint, source string, meta map<string,string>"
    rows = lambda ids: spark.createDataFrame([(i, "s", {"author": f"name {i % 20}"}) for i in ids], meta)
    first = spark.createDataFrame([("train", 0.5), ("val", 0.5)], "split string, share double")
    later = spark.createDataFrame([("train", 1.0)], "split string, share double")
    path, scratch = str(tmp_path / "kept"), tmp_path / "scratch"
    assert splits.kept_components(spark, path) is None
    with monkeypatch.context() as m:
        m.setattr(storage, "shared_folder", lambda s: f"file://{scratch}")
        before = {r.sample_id: r.split for r in splits.assign_kept(rows(range(100)), first, path).collect()}
    shutil.rmtree(scratch)  # as at the driver's exit
    (tmp_path / "kept" / "7" / "keys").mkdir(parents=True)  # not finished
    after = {r.sample_id: r.split for r in splits.assign_kept(rows(range(100, 140)), later, path).collect()}
    assert set(before.values()) == {"train", "val"} and len(after) == 40
    assert all(after[i] == before[i % 20] for i in after)
    assert splits.kept_components(spark, path)[1].agg(F.sum("records")).first()[0] == 140


def test_versions_hold_only_changes_and_follow_merges(spark, tmp_path):
    """Random batches: the kept components are those of all records at once, and every version is as small as its batch."""
    rng = random.Random(11)
    targets = spark.createDataFrame(TARGETS, "split string, share double")
    path = str(tmp_path / "kept")
    rows = [(i, f"s{rng.randrange(3)}", {"author": f"a{rng.randrange(90)}", "img_id": f"m{rng.randrange(400)}"} if rng.random() < 0.8 else None, "", "", "") for i in rng.sample(range(10_000), 600)]
    seen, quarantined = {}, set()
    for k, (a, b) in enumerate([(0, 300), (300, 330), (330, 331), (331, 600)], 1):
        for r in splits.assign_kept(spark.createDataFrame(rows[a:b], SAMPLES), targets, path).collect():
            seen[r.sample_id] = r.split
        assert spark.read.parquet(f"{path}/{k}/keys").count() <= 2 * (b - a) and spark.read.parquet(f"{path}/{k}/components").count() <= b - a
    df = spark.createDataFrame(rows, SAMPLES)
    whole = {r.component: r.records for r in splits.assign_splits(df, targets)[2].collect()}
    keys, comps = splits.kept_components(spark, path)
    assert {r.component: r.records for r in comps.collect()} == whole
    at_once = {r.key: r.component for r in splits.assign_splits(df, targets)[1].collect()}
    assert {r.key: r.component for r in keys.collect()} == at_once


def test_hot_roots_give_the_same_components(spark, monkeypatch):
    rng = random.Random(12)
    edges = [(0, i) for i in range(1, 400)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(300)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    plain = {tuple(r) for r in splits.contract(df).collect()}
    monkeypatch.setattr(splits, "ONE_TASK", 10)
    monkeypatch.setattr(splits, "HOT_SHARE", 0.05)
    assert {tuple(r) for r in splits.contract(df).collect()} == plain


def test_empty(spark):
    none = spark.createDataFrame([], SAMPLES)
    targets = spark.createDataFrame(TARGETS, "split string, share double")
    assert splits.linked_records(none).count() == 0
    assert splits.assign_splits(none, targets)[0].count() == 0
    one = spark.createDataFrame([(1, None, None, "", "", "")], SAMPLES)
    assert splits.assign_splits(one, targets.limit(0))[0].first().split == splits.QUARANTINE
