from collections import Counter

import numpy as np
import pandas as pd
import pytest

from gaugeworks.llm import drawing

RECORDS = "item bigint, source string, label int, draw_id int, p double, h string"
TARGETS = "draw_id int, source string, label int, share double, min_rows bigint, n_rows bigint, item int"


def test_calibration_meets_overlapping_margins():
    counts = np.array([500.0, 300.0, 200.0, 1000.0])
    member = np.array([[1, 1, 0, 0], [0, 0, 1, 1], [1, 0, 1, 0]], dtype=float)  # two sources, one label
    targets = np.array([120.0, 180.0, 150.0])
    p = drawing.calibrate(counts, member, targets, 0.15)
    assert np.allclose(member @ (counts * p), targets, atol=1e-5) and (p > 0).all() and (p <= 1).all()
    # exponential tilting keeps the odds structure: log p is additive in the constraints
    assert np.isclose(np.log(p[0] / p[1]), np.log(p[2] / p[3]), atol=1e-5)


def test_aims_keep_floors_take_short_cells_whole_and_meet_the_size():
    have, share, floor = np.array([1000.0, 500.0, 40.0, 0.0, 3000.0]), np.array([0.4, 0.2, 0.3, 0.1, 0.001]), np.array([0.0, 0.0, 0.0, 5.0, 20.0])
    a = drawing.aims(have, share, floor, 400)
    assert a.sum() == pytest.approx(400) and a[2] == pytest.approx(40) and a[3] == 0 and a[4] == pytest.approx(20) and a[0] == pytest.approx(2 * a[1])
    assert drawing.aims(have, share, floor, 1e9).tolist() == have.tolist()
    assert drawing.aims(have, share, floor, 10).tolist() == [0, 0, 0, 0, 20]
    assert drawing.aims(have, np.zeros(5), floor, 400).tolist() == [0, 0, 0, 0, 20]
    assert drawing.aims(np.array([90.0, 10.0]), np.array([0.5, 0.5]), np.zeros(2), 100) == pytest.approx([90, 10])


def test_units_far_apart_are_drawn_independently():
    """Through the function that production runs: two units 32 or 64 places apart come together about as often as chance has it."""
    rng = np.random.default_rng(1)
    together = {32: 0, 64: 0, 100: 0}
    for _ in range(12):
        h = np.sort(rng.integers(-(2**63), 2**63, 20_000))
        got = drawing._duel(pd.DataFrame({"draw_id": 1, "source": "s", "label": 0, "item": np.arange(20_000), "p": 0.02, "h": h}))
        taken = np.zeros(20_000, bool)
        taken[got.loc[got["p"] == 1, "item"].to_numpy()] = True
        for d in together:
            together[d] += (taken[d:] & taken[:-d]).sum()
    assert all(60 <= n <= 135 for n in together.values()), together  # 96 by chance


def test_pivotal_keeps_sums_and_expectation():
    cell = np.repeat([0, 1, 2], [40, 25, 1])
    start = np.r_[np.full(40, 0.3), np.full(25, 0.1), 0.4]
    rng = np.random.default_rng(0)
    total = np.zeros(66)
    for _ in range(3000):
        p = drawing.pivotal(cell, start, rng)
        assert ((p > 0) & (p < 1)).sum() <= 2 and p[:40].sum() == pytest.approx(12) and p[40:65].sum() == pytest.approx(2.5)
        total += p
    assert np.abs(total / 3000 - start).max() < 0.05


def test_draws_meet_targets_floors_and_report_gaps(spark):
    rows = [(i, ["big ", "BIG"][i % 2], i % 3, 0, 0.0, "") for i in range(6000)] + [(10_000 + i, "small", 0, 0, 0.0, "") for i in range(7)] + [(20_000, None, 1, 0, 0.0, ""), (20_001, "big", None, 0, 0.0, "")]
    targets = [(1, "big", 0, 0.5, 0, 400, 1), (1, "big", 1, 0.25, 0, 400, 1), (1, "small", 0, 0.001, 5, 400, 1), (2, "small", 0, 0.1, 2, 400, 1), (2, "none", 1, 0.1, 0, 400, 1), (2, "big", 1, 0.10025, 0, 400, 1)]
    df = spark.createDataFrame(rows + rows[:900], RECORDS)
    sample, report = drawing.draw(df, spark.createDataFrame(targets, TARGETS), seed=3, rows_each=500)
    got = sample.collect()
    assert len(got) == len({(r.draw_id, r.item) for r in got})
    n = Counter((r.draw_id, r.source, r.label) for r in got)
    assert n[1, "big", 0] in (263, 264) and n[1, "big", 1] in (131, 132) and n[1, "small", 0] == 5 and n[2, "small", 0] == 7 and n[2, "big", 1] == 393
    gaps = {(r.draw_id, r.source, r.label): r.gap for r in report.collect()}
    assert gaps[2, "small", 0] == pytest.approx(33) and gaps[2, "none", 1] == pytest.approx(40) and sum(g > 0 for g in gaps.values()) == 2
    again = drawing.draw(df.repartition(3), spark.createDataFrame(targets, TARGETS), seed=3, rows_each=500)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got}
    assert {tuple(r) for r in drawing.draw(df, spark.createDataFrame(targets, TARGETS), seed=4, rows_each=500)[0].collect()} != {tuple(r) for r in got}


def test_empty(spark):
    none, targets = spark.createDataFrame([], RECORDS), spark.createDataFrame([(1, "a", 0, 0.5, None, 10, 1)], TARGETS)
    sample, report = drawing.draw(none, targets)
    assert sample.count() == 0 and report.first().gap == 5
    assert drawing.draw(none, targets.limit(0))[1].count() == 0
