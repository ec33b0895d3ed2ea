import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkloom.llm import lookalike
from inkloom.llm.lookalike import Lookalikes, UnionFind, equal_looking, learn, standard

SAME = [
    ("בס\"ד", "בס''ד"), ("בס\"ד", "בס״ד"), ("צה'ל", "צה׳ל"), ("צה'ל", "צה’ל"), ("שלום", "‏ש͏ל­ו⁠ם﻿"),
    ("a b", " a 　\t b "), ("a-b", "a–b"), ("a-b", "a־b"), ("a...", "a…"), ("Expo 12", "Еxрο １２"), ("naïve", "naïve"),
    ("שׁ", "שׁ"), ("מים", "מיﬦ"), ("אוי", "אױ"), ("אבג", "ℵℶℷ"), ("שּׁ", "שּׁ"), ("(a)", "（a）"),
]
UNLIKE = [("מים", "מימ"), ("שלום", "שָׁלוֹם"), ("OK", "ok"), ("a b", "b a"), ("ab", "a b"), ("12", "13"), ("café", "cafe"), ("a\nb", "a b"), ("O", "0")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look_same_form(a, b):
    f = standard(True).rewrite
    assert f(a) == f(b) != ""


@pytest.mark.parametrize("a,b", UNLIKE)
def test_visible_differences_stay(a, b):
    f = standard(True).rewrite
    assert f(a) != f(b)


def test_line_ends():
    f = standard(True).rewrite
    assert f("a \r\n  b\n\n") == f("a\nb") == "a\nb"
    assert standard(False).rewrite("a\nb") == "a b"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'\"`׳״.… ‏\n\rוױיײ-–А́Ａ", max_size=30))
def test_rewriting_ends_in_one_form(t):
    f = standard(True).rewrite
    assert f(f(t)) == f(t)


def test_the_corpus_chooses_the_representative():
    c = Lookalikes("a־-", {"־": 9, "-": 2}, True)
    assert c.rewrite("a-a") == "a־a"


def test_union_find_is_transitive():
    u = UnionFind()
    u.union("a", "b")
    u.union("c", "d")
    u.union("b", "c")
    assert u.classes() == [["a", "b", "c", "d"]]


def test_equal_looking_pairs_and_odd_rows(spark):
    rows = [("b", "a–c"), ("a", "a-c"), ("a", "a-c"), ("c", "a-c"), ("d", None), ("e", " "), ("f", "‏"), ("g", "x" * 5000 + "-"), ("h", "x" * 5000 + "–"), (None, "a־c"), ("i", "A-c")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "k string, t string, form string")
    got = {tuple(r) for r in equal_looking(spark, [(df, "k", "t")], learn([(df, "t")])).collect()}
    assert got == {("a", "b"), ("b", "c"), ("g", "h")}
    empty = df.limit(0)
    assert equal_looking(spark, [(empty, "k", "t")], learn([(empty, "t")])).count() == 0


def test_forms_keep_null_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a…", "z")], "id int, t string, symbol string")
    got = {r.id: (r.form, r.symbol) for r in lookalike.with_form(spark, df, standard(False), "t").collect()}
    assert got == {1: (None, "x"), 2: ("", "y"), 3: ("a...", "z")}


def test_many_pairs_of_one_form(spark):
    # a hot form: half of all rows in one spelling, and one in another
    df = spark.createDataFrame([(i, "a-b" if i % 2 else f"t{i}") for i in range(2000)] + [(5000, "a–b")], "k int, t string")
    assert equal_looking(spark, [(df, "k", "t")], standard(False)).count() == 1000


def test_ids_of_hot_spellings_are_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "PIECE", 7)
    df = spark.createDataFrame([(i, "a-b" if i < 60 else "a–b" if i < 100 else "a־b") for i in range(110)], "k int, t string")
    got = {tuple(r) for r in equal_looking(spark, [(df, "k", "t")], standard(False)).collect()}
    group = lambda i: 0 if i < 60 else 1 if i < 100 else 2
    assert got == {(i, j) for i in range(110) for j in range(i + 1, 110) if group(i) != group(j)}


def test_long_runs_of_blanks_end_in_one(spark):
    assert standard(False).rewrite("a" + "  " * 200_000 + "b") == "a b"


def test_tables_are_not_paired_with_each_other(spark):
    one, two = spark.createDataFrame([("a", "x-y"), ("b", "x–y")], "k string, t string"), spark.createDataFrame([("c", "x-y"), ("d", "x־y"), ("a", "x־y")], "i string, s string")
    got = {tuple(r) for r in equal_looking(spark, [(one, "k", "t"), (two, "i", "s")], standard(False)).collect()}
    assert got == {("a", "b"), ("c", "d"), ("a", "c")}
