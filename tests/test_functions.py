"""Cleaning methods, numbers and the normal distribution on literal rows."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tabwright.functions.normal import f_upper_tail, log_upper_tail, normal_quantile
from tabwright.functions.numbers import clean_numeric, to_numeric
from tabwright.functions.text import clean_text, markers_to_null


def values(spark, texts, fn):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_to_numeric(spark):
    texts = ["1", " 2 ", "1e3", "+5", ".5", "5.", "-", "", "1_000", "1,000", "1.0d", "0x1F", "NaN", "inf", "1-2", "1.2.3", "٣", None]
    wanted = [1.0, 2.0, 1000.0, 5.0, 0.5, 5.0] + [None] * 12
    assert values(spark, texts, to_numeric) == wanted


@pytest.mark.parametrize(
    "method, text, wanted",
    [
        ("extract_numbers", "about 12.5 kg", 12.5),
        ("extract_numbers", "1e3", 13.0),
        ("extract_numbers", "1-2", None),
        ("remove_currency", "$1,234.50", 1234.5),
        ("remove_currency", "₹7", 7.0),
        ("remove_currency", "7 EUR", None),
        ("remove_percentage", "12.5%", 0.125),
        ("remove_units", "24 km/h", 24.0),
        ("remove_units", "-3°C", -3.0),
        ("remove_commas", "1,234.50", 1234.5),
        ("trim_whitespace", "\t 5 ", 5.0),
        ("smart_convert", " 12% ", 12.0),
        ("smart_convert", None, None),
    ],
)
def test_clean_numeric(spark, method, text, wanted):
    assert values(spark, [text], lambda c: clean_numeric(c, method)) == [wanted]


@pytest.mark.parametrize(
    "method, text, wanted",
    [
        ("remove_special_chars", " a_b-c! é ", "abc é"),
        ("remove_special_chars", "!@#$%^&*()_+=[]{};:'\".,<>?/\\|`~-", ""),
        ("trim_whitespace", "\t a b  ", "a b"),
        ("lowercase", " AbÉ ", "abé"),
        ("remove_duplicates_spaces", "  a   b ", "a b"),
        ("standardize", "  A   B ", "a b"),
        ("remove_numbers", " a1b22 ", "ab"),
        ("remove_non_word", "Iechä, Grüße_日本!", "Iechä Grüße_日本"),
        ("standardize_strict", " A  B! ", "a b"),
        ("standardize_strict", "A !", "a "),
        ("keep_marker", "N/A", "N/A"),
        ("standardize", None, None),
    ],
)
def test_clean_text(spark, method, text, wanted):
    assert values(spark, [text], lambda c: clean_text(c, method)) == [wanted]


def test_markers(spark):
    texts = ["N/A", " none ", "-", "banana", "x-y", "unknown", "", None]
    assert values(spark, texts, markers_to_null) == [None, None, None, "banana", "x-y", None, "", None]
    assert values(spark, ["banana", "x-y", "?"], lambda c: markers_to_null(c, True)) == ["ba", "xy", None]


def test_normal_distribution(spark):
    p = [1e-12, 0.001, 0.3, 0.5, 0.925, 1 - 1e-9]
    df = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile("p").alias("q"))
    for row in df.collect():
        assert row.q == pytest.approx(NormalDist().inv_cdf(row.p), abs=1e-13)
    df = spark.createDataFrame([(x,) for x in (-8.0, -1.0, 0.0, 2.5, 7.5)], "z double").select("z", log_upper_tail("z").alias("t"))
    for row in df.collect():
        assert row.t == pytest.approx(math.log(math.erfc(row.z / math.sqrt(2)) / 2), rel=1e-8)


def test_f_tail():
    assert f_upper_tail(4.10282, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_upper_tail(3.09839, 3, 20) == pytest.approx(0.05, abs=1e-6)
    assert f_upper_tail(0, 3, 20) == 1.0
