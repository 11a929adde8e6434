import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import lookalike


@pytest.fixture(scope="module")
def visible_form(spark):
    return lambda text, fold_case=False: lookalike.visible_form(spark, text, fold_case)


SAME = [
    ("ｆｕｌｌ　１２", "full 12"), ("ﬁne eﬀort ﬄ", "fine effort ffl"), ("a​b﻿­c⁠", "abc"), ("x y z w", "x y z w"), ("résumé", "résumé"),
    ("раураl", "paypal"), ("ӓ", "ä"), ("21 K", "21 K"), ("well‑known", "well-known"), ("5 µm", "5 μm"), ("ở", "ở"), ("a\r\nb", "a\nb"), ("ΑΒ", "AB"), ("սօո", "uon"), ("ᎪᎬᎷ", "AEM"), ("ꓐꓳꓧ", "BOH"), ("ⲞⲢⲤ", "OPC"), ("𝐀𝑏", "Ab"), ("e\u0308", "\u0451")]
DIFFERENT = [("x²", "x2"), ("H₂O", "H2O"), ("resume", "résumé"), ("Word", "word"), ("①", "1"), ("½", "1/2"), ("l", "1"), ("O", "0"), ("й", "и"), ("straße", "strasse"), ("a b", "ab"), ("", " "), ("г", "r"), ("α", "a"), ("σ", "o"), ("З", "3"), ("Д", "Л")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_to_a_reader(visible_form, a, b):
    assert visible_form(a) == visible_form(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_visibly_different(visible_form, a, b):
    assert visible_form(a) != visible_form(b)


def test_idempotent_and_composed(visible_form):
    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=40))
    def check(s):
        f = visible_form(s)
        assert visible_form(f) == f and unicodedata.normalize("NFC", f) == f
        assert visible_form(unicodedata.normalize("NFD", s)) == f

    check()


def test_letters_of_many_scripts_come_from_the_public_table(spark):
    table = lookalike._confusable(spark)
    assert len(table) > 150 and table["Ꭺ"] == "A" and table["ꓧ"] == "H" and table["𐊐"] == "X"
    assert not any(unicodedata.name(c).startswith(lookalike.LISTED) for c in table)
    assert all(a.isascii() and a.isalpha() for a in table.values())


def test_case_folding_is_an_option(visible_form):
    assert visible_form("STRASSE", fold_case=True) == visible_form("straße", fold_case=True)


TEXTS = "item bigint, text string, form string"


def test_pairs_and_classes(spark):
    rows = [(1, "abc", "x"), (2, "аbc", "x"), (3, "abc", "x"), (4, "abd", "x"), (5, None, "x"), (6, "", "x"), (7, "​", "x"), (8, "a​bc", "x"), (8, "a​bc", "x"), (9, None, "x"), (10, "long " * 50_000, "x"), (11, "long " * 50_000, "x")]
    df = spark.createDataFrame(rows, TEXTS)
    pairs = {tuple(r) for r in lookalike.look_alike_pairs(df).collect()}
    assert pairs == {(1, 2), (2, 3), (1, 8), (3, 8), (2, 8), (6, 7), (10, 11)}
    classes = {r.item: (r.class_id, r["items"], r.spellings) for r in lookalike.look_alike_classes(df).collect()}
    assert classes[3] == (1, 4, 3) and classes[7] == (6, 2, 2) and classes[4] == (4, 1, 1) and 5 not in classes
    forms = {r.item: (r.form, r.changed) for r in lookalike.forms(df).collect()}
    assert forms[2] == ("abc", True) and forms[1] == ("abc", False) and forms[5] == (None, None)


def test_hot_text_and_empty(spark):
    rows = [(i, "the same", "") for i in range(5000)] + [(9999, "the same", "")]
    assert lookalike.look_alike_pairs(spark.createDataFrame(rows, TEXTS)).count() == 5000
    assert lookalike.look_alike_pairs(spark.createDataFrame([], TEXTS)).count() == 0
    assert lookalike.look_alike_classes(spark.createDataFrame([], TEXTS)).count() == 0
