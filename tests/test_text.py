"""Text functions on single values."""

import time

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T


def on(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("COVID-19 and SARS-CoV-2 affect ACE2 (see http://x.co)", "covid19 and sarscov2 affect ace2 see"),
        ("interleukin-6", "interleukin6"), ("SpO2 and PaO2", "spo2 and pao2"), ("1,000.25 mg", "100025 mg"), ("a-b-c–d", "abcd"), ("@handle ok", "ok"), ("", ""), (None, ""), (" \t", ""),
    ],
)
def test_clean(spark, text, wanted):
    assert on(spark, text, T.clean_text) == wanted


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 200_000, "1" * 200_000, "a-" * 100_000, "a:" * 100_000])
def test_long_odd_texts_take_no_time(spark, text):
    start = time.perf_counter()
    on(spark, text, T.preprocess)
    assert time.perf_counter() - start < 20


def test_tokens(spark):
    assert on(spark, "12345 678", T.preprocess) == ["12345", "678"]
    assert on(spark, "a 5 b", T.preprocess) == []
    assert on(spark, "The patients cannot be without no oxygen oxygen", T.preprocess) == ["patients", "not", "without", "no", "oxygen", "oxygen"]
    assert on(spark, "No covid19 2020", T.old_chain) == ["covid"]
    assert on(spark, None, T.preprocess) == []
    with pytest.raises(ValueError):
        T.preprocess(F.col("x"), least=0)


def test_bigrams(spark):
    tokens = lambda c: T.with_bigrams(F.split(c, " "))
    assert on(spark, "a b c", tokens) == ["a", "b", "c", "a b", "b c"]
    assert on(spark, "a", tokens) == ["a"]


def test_ids(spark):
    assert on(spark, "ctri 2021 05 033883", T.normalize_id) == on(spark, "CTRI/2021/05/033883", T.normalize_id) == "CTRI202105033883"
    assert on(spark, "NCT01", lambda c: T.looks_like_id(c)) is False
    assert on(spark, "NCT012", lambda c: T.looks_like_id(c)) is True


def test_truncated(spark):
    assert on(spark, "abc def", lambda c: T.truncated(c, 4)) == "abc..."
    assert on(spark, "abc", lambda c: T.truncated(c, 3)) == "abc"


def test_sql_functions(spark):
    T.register(spark)
    assert spark.sql("SELECT corvane_clean_text('COVID-19 (x)') a, corvane_normalize_id('n-1') b, corvane_preprocess('the lungs cannot') c").first().asDict() == {"a": "covid19 x", "b": "N1", "c": ["lungs", "not"]}
