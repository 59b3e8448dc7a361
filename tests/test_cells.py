"""Parse tests on single texts, and column classes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import cells
from plumbline.functions.cells import date_like, numeric_like
from plumbline.operators import profile

DATES = [
    "2025", "1678", "2262", "991231", "20250101", "2024.5", "2024-Q1", "2024Q1", "1Q2024",
    "Jan 2024", "January 2024", "2024 Jan", "5 Jan 2024", "Jan 5, 2024", "5th January 2024",
    "Mon, 05 Jan 2024 10:00:00 GMT", "31.12.2024", "12.5.2024", "13/01/2024", "1/13/24", "5-1-24",
    "2024-01", "2024/01", "01/2024", "10-2024", "2024-1-5", "2024-01-05T10:00:00Z",
    "2024-01-05 10:00", "2024-01-05T10:00:00+03:00", "20240105T101500", "1677-09-22",
    "2262-04-11", "99-12-31", " 2025 ", "2024 / 01 / 05", "sep-2024", "170101",
]
NOT_DATES = [
    "1446", "1677", "2263", "3000", "999", "12", "14727", "199912", "2025.0", "1500.0", "29%",
    "2020G", "may", "-", "now", "today", "12:30", "2024-13", "20251301", "2024-02-30",
    "32/01/2024", "2024-31-01", "13/2024", "12/31", "Jan-24", "Jan 5", "1,173,910", "6.55",
    "68423.46", "true", "5-LOW", "2023-2024", "1677-09-21", "2262-04-12", "", "Not Available",
    "غير متاح", "May 2024 report", "2024 Q1", "1700000000", "201301",
]


def judge(spark, texts, test):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r.t: r.ok for r in df.select("t", test(F.col("t")).alias("ok")).collect()}


def test_digits_alone_need_no_rule(spark, monkeypatch):
    texts = ["2025", "1677", "2262", "991231", "170101", "201301", "313131", "120131", "000101", "20250101", "16770921",
             "16770922", "202501011200", "20241301101500", "20240230", "14727", "123456789012345", "1"]
    monkeypatch.setattr(cells, "_rewrite", lambda text, rules: F.raise_error(F.lit("a rule was tried")))
    got = judge(spark, texts, date_like)
    assert {t for t, ok in got.items() if ok} == {
        "2025", "2262", "991231", "170101", "120131", "20250101", "16770922", "202501011200"
    }


def test_dates(spark):
    assert [t for t, ok in judge(spark, DATES, date_like).items() if not ok] == []


def test_not_dates(spark):
    assert [t for t, ok in judge(spark, NOT_DATES, date_like).items() if ok] == []


def test_null_is_not_a_date(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(date_like(F.col("t")).alias("ok")).first().ok is False


def test_numbers(spark):
    good = ["1", "-1.5", "+3", ".5", "5.", "1e5", "1.5E-3", " 7 ", "inf", "-Infinity"]
    bad = ["", "5d", "1,000", "NaN", "0x1F", "1_000", "29%", "-", "e5", "1 2"]
    got = judge(spark, good + bad, numeric_like)
    assert [t for t in good if not got[t]] == [] and [t for t in bad if got[t]] == []


@pytest.fixture(scope="module")
def classes(spark):
    rows = [
        (
            i,
            2000 + i % 20,
            1440 + i % 5,
            f"free text number {i} of some length",
            "group" + str(i % 3),
            i % 2 == 0,
            None,
            dt.datetime(2024, 1, 1),
            f"{i % 28 + 1}/02/2024" if i % 10 else "n.d.",
            i * 1.5,
        )
        for i in range(100)
    ]
    df = spark.createDataFrame(
        rows,
        "id long, year long, lunar long, note string, grp string, flag boolean, void string, "
        "at timestamp, day string, x double",
    )
    table = profile.column_classes(df, "id")
    return {r.col_name: r for r in table.collect()}


@pytest.mark.parametrize(
    "column, kind",
    [
        ("year", "date"),
        ("lunar", "numeric"),
        ("note", "freetext"),
        ("grp", "categorical"),
        ("flag", "numeric"),
        ("void", "numeric"),
        ("at", "date"),
        ("day", "date"),
        ("x", "numeric"),
    ],
)
def test_classes(classes, column, kind):
    assert classes[column]["class"] == kind


def test_date_share_looks_at_the_first_rows_only(spark):
    rows = [(i, "2024-01-01" if i < 50 else "text") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, d string").repartition(7)
    shares = profile.date_share(profile.long_cells(df, None, ["d"], "id"), 50)
    assert shares.first().date_share == 1.0


def test_distinct_counts_are_exact_for_long_texts(spark):
    rows = [("k", "x" * 100 + str(i % 37)) for i in range(500)] + [("k", "short")] * 5
    df = spark.createDataFrame(rows, "k string, t string")
    counted = profile.distinct_texts(profile.long_cells(df, "k", ["t"]))
    assert counted.first().n_distinct == 38


def test_long_texts_can_be_dates(spark):
    texts = {
        " " * 60 + "2024-01-05" + " " * 60: True,
        "Wednesday, 17 September 2025 10:15:30.123456789+03:00 ": True,
        "1" * 200_000: False,
        "may " * 50_000 + "1": False,
        "Tues 5 March 2024": True,
        "Thursday, 4 July 2024": True,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.d for r in df.select("t", cells.date_like(F.col("t")).alias("d")).collect()}
    assert got == texts


def test_row_keys_at_any_width(spark):
    rows = spark.sql(
        "SELECT timestamp_micros(id div 2) ts, id % 3 n, array(timestamp_micros(id div 4)) a, "
        "double(0) * (CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END) z, 'a:1' s, string(null) e FROM range(40)"
    )
    wide = rows.selectExpr("*", *[f"n + {i} AS c{i}" for i in range(40)])
    for df in (rows, wide):
        keys = cells.row_keys([(f.name, f.dataType) for f in df.schema.fields])
        assert df.select(*keys).distinct().count() == rows.selectExpr("ts", "n", "a").distinct().count()
    pair = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "-"), ("-", None)], "x string, y string")
    keys = cells.row_keys([(f.name, f.dataType) for f in pair.schema.fields])
    assert pair.select(*keys).distinct().count() == 4


def test_long_texts_are_told_by_their_first_characters(spark):
    gaps = [f"5 september 2024{' ' * k}12:30" for k in range(1, 80)]
    words = [f"{'2024-01-05 10:00'}{' ' * k}january" for k in range(40, 60)]
    texts = [*gaps, *words, "2024-01-05 " * 20, "1" * 70, "x" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t for r in df.where(date_like(F.col("t"))).collect()}
    assert found == set(gaps)
    assert "left(trim(t), 64)" in str(date_like(F.col("t")))
