import random

from gaugeworks.llm import topn
from pyspark.sql import functions as F

SCHEMA = "err_id bigint, arm string, path string, score double, label int, condition string, rank int, _row string"
CONDITIONS = [(0, "clean", None, "clean"), (1, "jpeg", "90", "jpeg_90"), (2, "noise", "0.1", "noise_0.1")]


def _conditions(spark):
    return spark.createDataFrame(CONDITIONS, "ord int, transform string, level string, tag string")


def _brute(rows, n):
    best = {}
    for r in set(rows):
        best.setdefault((r[1], r[5], r[4]), []).append(((-r[3] if r[4] == 0 else r[3]), r[2], r[0]))
    return {(k, i) for k, v in best.items() for *_, i in sorted(v)[:n]}


def test_matches_brute_force_with_ties_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), f"p{rng.randrange(9)}", rng.choice([0.1, 0.2, 0.9]), rng.randrange(2), rng.choice(["clean", "jpeg_90"]), None, None) for i in range(400)]
    rows += rows[:50] + rows[:20] * 12  # some rows stand often: heaps fill with copies
    got = topn.top_errors(spark.createDataFrame(rows, SCHEMA), _conditions(spark), 5)
    assert {((r.arm, r.condition, r.label), r.err_id) for r in got.collect()} == _brute(rows, 5)


def test_spellings_nulls_and_bad_scores(spark):
    rows = [(1, "a", "p", 0.5, 0, " JPEG@90.0", 1, "x"), (2, "a", "p", 0.6, 0, "jpeg_90", 1, "x"), (3, "a", "p", float("nan"), 0, "jpeg_90", 1, "x"), (4, "a", "p", None, 0, "jpeg_90", 1, "x"),
            (5, "a", "p", 1.5, 0, "jpeg_90", 1, "x"), (6, "a", "p", 0.5, None, "jpeg_90", 1, "x"), (7, None, None, 0.5, 1, None, 1, "x"), (8, "a", "p", 0.3, 1, "Noise_0.10\t", 1, "x"), (9, "a", "p", 0.3, 1, "odd", 1, "x")]
    got = {(r.arm, r.condition, r.label, r.rank): r.err_id for r in topn.top_errors(spark.createDataFrame(rows, SCHEMA), _conditions(spark), 2).collect()}
    assert got == {("a", "jpeg_90", 0, 1): 2, ("a", "jpeg_90", 0, 2): 1, (None, None, 1, 1): 7, ("a", "noise_0.1", 1, 1): 8, ("a", "odd", 1, 1): 9}


def test_empty(spark):
    assert topn.top_errors(spark.createDataFrame([], SCHEMA), _conditions(spark)).count() == 0


def test_general_groups(spark):
    df = spark.range(1000).select(F.col("id").alias("rank"), (F.col("id") % 3).alias("g"))
    got = topn.top_per_group(df, ["g"], [F.col("rank")], ["rank"], 2).toDF("g", "item", "place")
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1), (0, 3, 2), (1, 1, 1), (1, 4, 2), (2, 2, 1), (2, 5, 2)]
