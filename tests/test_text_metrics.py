import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkloom.functions import metrics, text


def normal(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.n for r in df.select("i", text.normalize(F.col("t")).alias("n")).orderBy("i").collect()]


def test_scoring_form(spark):
    got = normal(spark, 'בס"ד', "בס''ד", "בס״ד", "צה׳ל", "צה’ל", "‏שלום‎", "  a \t\n b  ", "מים", "שָׁלוֹם", None, "", "  ", "‎", "a—b", "a–b", "a־b", "a…", "é", "a　\x1c b")
    assert got[:3] == ['בס"ד'] * 3 and got[3] == got[4] == "צה'ל" and got[5] == "שלום" and got[6] == "a b"
    assert got[7] == "מים" and got[8] != "שלום" and got[9:13] == [""] * 4 and got[13:16] == ["a-b"] * 3 and got[16] == "a..." and got[17] == "é" and got[18] == "a b"


def test_usable_and_sentences(spark):
    df = spark.createDataFrame([("שלום",), ("ש",), ("abc ש",), ("שלום abc",), ("",)], "t string")
    assert [r[0] for r in df.select(text.usable(F.col("t"))).collect()] == [True, False, False, True, False]
    row = spark.createDataFrame([("שלום עולם טוב. abc!\nקצר",)], "t string").select(text.sentences(F.col("t")).alias("s")).first()
    assert row.s == ["שלום עולם טוב", "", "קצר"]
    ok = spark.createDataFrame([("שלום עולם טוב",), ("קצר",), ("abcdefghijklmn",)], "t string").select(text.good_sentence(F.col("t"))).collect()
    assert [r[0] for r in ok] == [True, False, False]


def pair_scores(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, ref string, hyp string")
    return metrics.scored(df).orderBy("i").collect()


def test_rates_and_coverage(spark):
    rows = pair_scores(spark, [("abcd", "abed"), ("abcd", ""), ("ab", "abababab"), ("", ""), ("", "x"), ("a b c", "c a b"), ("a a", "a"), ("a a", "a a a"), ("a a b", "a b b")])
    assert [r.cer for r in rows[:5]] == [0.25, 1.0, 3.0, 0.0, 1.0]
    assert [(r.hit, r.words) for r in rows[5:]] == [(3, 3), (1, 2), (2, 2), (2, 3)]
    df = spark.createDataFrame([("a b", "b")], "r string, h string")
    w = lambda c: text.split_words(F.col(c))
    assert df.select(metrics.coverage(w("r"), w("h")), metrics.cer(F.col("r"), F.col("h"))).first()[:] == (0.5, 2 / 3)


@pytest.mark.parametrize("n", [1, 2, 5, 9, 20, 225])
def test_quartiles_are_exact(spark, n):
    v = np.random.default_rng(n).random(n)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    got = df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0]
    assert np.allclose(got, np.percentile(v, [25, 50, 75]))


def report(spark, pairs):
    df = spark.createDataFrame(pairs, "ref string, hyp string")
    return metrics.scored(df).agg(*metrics.line_report()).first()


def test_blanks_in_reports(spark):
    r = report(spark, [("aaaa", "aaaa"), ("bbbb", ""), ("cccc", "cccc")])
    assert (r.n_total, r.n_scored, r.n_blank, r.cer_median) == (3, 2, 1, 0.0)
    r = report(spark, [("aaaa", "")] * 3)
    assert r.cer_median is None and r.cer_median_nodrop == 1.0 and r.wcov_micro is None
    r = report(spark, [("aaaa", "aaaa")] + [("bbbb", "")] * 9)
    assert (r.cer_median, r.cer_median_nodrop, r.n_blank) == (0.0, 1.0, 9)
    df = spark.createDataFrame([("a b", "a b"), ("c d", "")], "ref string, hyp string")
    p = metrics.scored(df).agg(*metrics.page_report()).first()
    assert (p.n_pages, p.n_scored, p.n_blank, p.cer_micro) == (2, 1, 1, 0.0)
    empty = metrics.scored(df.limit(0)).agg(*metrics.line_report()).first()
    assert empty.n_total == 0 and empty.cer_median is None


def test_page_order_costs_characters_but_not_coverage(spark):
    a, b = pair_scores(spark, [("one two\nthree".replace("\n", " "), "one two three"), ("one two three", "three one two")])
    assert a.hit == b.hit == 3 and a.cer == 0 < b.cer


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=100, deadline=None)
@given(st.text("abאב", max_size=9), st.text("abאב", max_size=9))
def test_distance_in_sql(a, b):
    import duckdb

    sql = f"with {metrics.sql_scored(f'select {text.quote(a)} as ref, {text.quote(b)} as hyp')} select d from scored"
    assert duckdb.connect().execute(sql).fetchone()[0] == edit_distance(a, b)
