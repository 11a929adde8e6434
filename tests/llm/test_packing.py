import math
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import packing

SPECS = "spec_id int, spec string, capacity bigint"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_is_a_partition_within_capacity(sizes):
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= math.ceil(1.7 * sum(sizes) / 50) + 1


def _check(spark, items, specs, **kw):
    rows = packing.pack(spark.createDataFrame(items, "item bigint, tokens bigint, container string"), spark.createDataFrame(specs, SPECS), **kw).collect()
    for spec, _, capacity in specs:
        own = [r for r in rows if r.spec_id == spec]
        fill, pieces = defaultdict(int), defaultdict(list)
        for r in own:
            if r.container is not None:
                fill[r.container] += r.tokens
                pieces[r.item].append(r)
        assert all(f <= capacity for f in fill.values())
        for item, tokens, _ in set(items):
            assert sum(r.tokens for r in pieces[item]) == (tokens or 0)
            if (tokens or 0) <= capacity:
                assert len(pieces[item]) <= 1  # only what is larger is cut
            assert sorted(r.piece for r in pieces[item]) == list(range(len(pieces[item])))
        assert {r.item for r in own} == {i for i, *_ in items}
        yield len(fill), sum(t or 0 for _, t, _ in set(items)) / capacity


def test_levels_merge_and_little_is_wasted(spark):
    rng = random.Random(2)
    items = [(i, int(rng.lognormvariate(5, 1)), "x") for i in range(3000)]
    for used, least in _check(spark, items + items[:100], [(1, "a", 256), (2, "b", 1024)], rows_each=200, fan_in=4):
        assert used <= 1.03 * least + 2


def test_items_that_never_fit_together(spark):
    used, _ = next(_check(spark, [(i, 60, None) for i in range(500)] + [(1000, 1, None)], [(1, "a", 100)], rows_each=50))
    assert used == 500


def test_halves_of_different_buckets_meet(spark):
    sizes = [(i, 60, None) for i in range(1500)] + [(10_000 + i, 40, None) for i in range(1500)]
    used, least = next(_check(spark, sizes, [(1, "a", 100)], rows_each=100))
    assert least == 1500 and used <= 1502


def test_many_underfull_bins_are_never_set_aside(spark):
    rng = random.Random(7)
    items = [(i, rng.choice([51, 52, 53]), None) for i in range(2000)] + [(10_000 + i, rng.choice([44, 45, 46]), None) for i in range(2000)]
    used, least = next(_check(spark, items, [(1, "a", 100)], rows_each=400, fan_in=2))
    assert used <= 1.03 * 2000  # 2000 pairs would do


def test_nulls_empty_and_huge(spark):
    list(_check(spark, [(1, None, None), (2, 0, None), (3, 1000, None), (4, 10, None), (5, 20, None)], [(1, "a", 10)]))
    specs = spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "c", 0)], SPECS)
    empty = spark.createDataFrame([], "item bigint, tokens bigint")
    assert packing.pack(empty, specs).count() == 0
    assert packing.pack(empty, specs.limit(0)).count() == 0
