from collections import defaultdict

import pytest

from gaugeworks.llm import mixing

ITEMS = "item bigint, source string, tokens bigint, repeats string"
TARGETS = "mix_id int, source string, weight double, max_repeats int, budget_tokens bigint, item int"


def test_shares_and_caps(spark):
    items = [(i, " Big\t" if i % 3 else "BIG", 10 + i % 7, "x") for i in range(3000)] + [(10_000 + i, "small", 20, "x") for i in range(10)] + [(20_000, None, 50, "x"), (20_001, "small", None, "x"), (20_002, "small", 0, "x")]
    items += items[:500]
    targets = [(1, "big", 3.0, 1, 20_000, 1), (1, "small", 1.0, 4, 20_000, 1), (1, "none", 1.0, 4, 20_000, 1), (2, "small", 1.0, 8, 1250, 1)]
    choice, report = mixing.mix(spark.createDataFrame(items, ITEMS), spark.createDataFrame(targets, TARGETS), rows_each=100)
    r = {(x.mix_id, x.source): x for x in report.collect()}
    assert r[1, "big"].target_tokens == 12_000 and abs(r[1, "big"].reached_tokens - 12_000) <= 8
    assert r[1, "small"].reached_tokens == 800 == r[1, "small"].max_repeats * r[1, "small"].available_tokens
    assert r[2, "small"].reached_tokens in (1240, 1260)
    assert r[1, "none"].reached_tokens == 0
    assert abs(sum(x.reached_share for x in report.collect() if x.mix_id == 1) - 1) < 1e-9
    got = defaultdict(int)
    for c in choice.collect():
        assert c.repeats <= {(1, "big"): 1, (1, "small"): 4, (2, "small"): 8}[c.mix_id, c.source]
        got[c.mix_id, c.source] += c.tokens * c.repeats
    assert got == {k: v.reached_tokens for k, v in r.items() if v.reached_tokens}
    assert {(x.mix_id, x.source) for x in mixing.short_sources(report).collect()} == {(1, "small"), (1, "none")}


def test_same_seed_same_choice_and_empty(spark):
    items = spark.createDataFrame([(i, "a", 5, "") for i in range(200)], ITEMS)
    targets = spark.createDataFrame([(1, "a", 1.0, 1, 500, 1)], TARGETS)
    a, b = (sorted(map(tuple, mixing.mix(items.repartition(p), targets, 3)[0].collect())) for p in (1, 7))
    assert a == b and sum(x[3] for x in a) == pytest.approx(500, abs=5)
    choice, report = mixing.mix(items.limit(0), targets)
    assert choice.count() == 0 and report.first().reached_tokens == 0
    assert mixing.mix(items, targets.limit(0))[1].count() == 0
