"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import pandas as pd
import pytest

from gaugeworks.plans import catalogue

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return c


def _text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def _rows(df):
    return sorted(tuple(_text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, con, name):
    got, want = catalogue.queries()[name](spark, FOLDER).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry_has_llm_queries_only_if_there():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_never_imports_the_optional_part():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "gaugeworks")
    for at, _, names in os.walk(root):
        if os.sep + "llm" in at:
            continue
        for n in names:
            if n.endswith(".py"):
                assert "llm" not in open(os.path.join(at, n)).read(), n


def test_every_arm_has_its_curve(spark):
    from gaugeworks.plans import tables

    scored = tables.scored(spark, FOLDER)
    arms = {r.arm for r in scored.select("arm").distinct().collect()}
    assert len(arms) > 1
    for name in ("roc_curve_by_arm", "roc_vertices_by_arm", "operating_points_by_arm", "contact_sheet_order_by_arm"):
        assert {r.arm for r in catalogue.queries()[name](spark, FOLDER).select("arm").distinct().collect()} == arms, name
    assert catalogue.queries()["contact_sheet_order_by_arm"](spark, FOLDER).count() == scored.count()


def test_every_evaluation_split_is_expanded(spark):
    got = catalogue.queries()["condition_expansion"](spark, FOLDER)
    assert {r.split for r in got.select("split").distinct().collect()} == {"val", "alt_real", "test"}
