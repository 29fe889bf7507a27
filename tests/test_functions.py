import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import numbers as N
from lodestone.functions import text as T


def ask(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        (None, []),
        ("", []),
        ("  \t　", []),
        ("，。!?", []),
        ("Foo v1.2 foo", ["foo", "v1.2", "foo", "#1", "#2"]),
        ("退款", ["退", "退款", "款"]),
        ("充7天", ["充", "充7", "7", "7天", "天", "#7"]),
        ("USB线", ["u", "us", "s", "sb", "b", "b线", "线"]),
        ("我退", ["我退", "退"]),  # the stopword goes, the pair it begins stays
        ("这个", ["个"]),  # the pair is a stopword as well, its second character is none
    ],
)
def test_tokenize(spark, text, tokens):
    assert ask(spark, text, T.tokenize) == tokens


def test_stopwords_are_kept_on_demand(spark):
    assert ask(spark, "我的", lambda c: T.tokenize(c, keep_stopwords=True)) == ["我", "我的", "的"]
    assert len(T.STOPWORDS) == len(set(T.STOPWORDS)) == 57


@pytest.mark.parametrize(("text", "grams"), [(None, []), ("", []), ("A", ["A"]), ("Ab", ["Ab"]), ("a-Bc", ["aB", "Bc"]), ("é😀x", ["é😀", "😀x"])])
def test_char_ngrams(spark, text, grams):
    assert ask(spark, text, T.char_ngrams) == grams


def test_longer_ngrams(spark):
    assert ask(spark, "abcd", lambda c: T.char_ngrams(c, 3)) == ["abc", "bcd"]
    assert ask(spark, "ab", lambda c: T.char_ngrams(c, 3)) == ["ab"]


@pytest.mark.parametrize(
    ("query", "parts"),
    [
        ("但是坏了", None),  # nothing before
        ("好的但坏", None),  # one character after
        ("灯亮，但是充不进", ("灯亮，", "充不进")),
        ("可能不过也但是这样吧", ("可能不过也", "这样吧")),  # the list's order counts, not the place
        ("没有转折词", None),
        (None, None),
    ],
)
def test_contrast(spark, query, parts):
    got = ask(spark, query, T.contrast)
    assert (None if got is None else (got["head"], got["tail"])) == parts


def test_replace_first(spark):
    assert ask(spark, "aXbXc", lambda c: T.replace_first(c, "X", "__")) == "a__bXc"
    assert ask(spark, "abc", lambda c: T.replace_first(c, "X", "__")) == "abc"


def test_token_f1(spark):
    rows = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "c"]), ([], ["a"]), (["x"], ["y"])], "p array<string>, g array<string>")
    got = [r[0] for r in rows.select(T.token_f1(F.col("p"), F.col("g"))).collect()]
    assert got == pytest.approx([2 / 3, 0, 0])


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],)], "v array<double>")
    assert [r[0] for r in rows.select(N.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], []]
    assert [r[0] for r in rows.select(N.dot(F.col("v"), F.col("v"))).collect()] == [25.0, 0.0, 0.0]
    p = spark.createDataFrame([([1000.0, 1000.0],)], "z array<double>").select(N.softmax(F.col("z"))).first()[0]
    assert p == [0.5, 0.5]


@pytest.mark.parametrize(("success", "total", "low", "high"), [(0, 0, 0.0, 1.0), (13, 16, 0.5699, 0.9341), (15, 16, 0.7167, 0.9889), (0, 5, 0.0, None), (5, 5, None, 1.0)])
def test_wilson(spark, success, total, low, high):
    got = spark.createDataFrame([(success, total)], "s int, n int").select(N.wilson(F.col("s"), F.col("n")).alias("c")).first()["c"]
    assert low is None or got["low"] == pytest.approx(low)
    assert high is None or got["high"] == pytest.approx(high)
    assert 0 <= got["low"] <= got["high"] <= 1


def test_rounding_goes_half_up_on_both_sides_of_zero(spark):
    got = spark.createDataFrame([(0.00005,), (-0.00004,)], "x double").select(N.rounded(F.col("x"))).collect()
    assert [r[0] for r in got] == [0.0001, 0.0]
    assert math.isclose(got[0][0], 1e-4)
