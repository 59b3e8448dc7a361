"""Tiny frames with answers worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scoring
from plumbline.operators import dimensions, profile


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def single(result, column):
    return result.first()[column]


def completeness(df, **kw):
    datasets, columns = dimensions.completeness(df, **kw)
    return single(datasets, "completeness"), {
        r.col_name: r.completeness for r in columns.collect()
    }


@pytest.mark.parametrize(
    "rows, score, per_column",
    [
        ([(1, "x"), (2, "y"), (3, "z")], 1.0, {"a": 1.0, "b": 1.0}),
        ([(None, None), (None, None)], 0.0, {"a": 0.0, "b": 0.0}),
        ([(1, None), (None, "4")], 0.5, {"a": 0.5, "b": 0.5}),
        ([(1, "1"), (2, "2"), (3, "3"), (None, "4")], 0.875, {"a": 0.75, "b": 1.0}),
    ],
)
def test_completeness(spark, rows, score, per_column):
    assert completeness(frame(spark, "a long, b string", *rows)) == (score, per_column)


def test_completeness_of_nothing(spark):
    score, columns = completeness(frame(spark, "a long"))
    assert score == 0.0 and columns.get("a", 0.0) == 0.0


def test_nan_is_null_but_infinity_and_blank_are_values(spark):
    df = frame(spark, "a double, b string", (float("nan"), ""), (float("inf"), " "), (1.0, None))
    _, columns = completeness(df)
    assert columns == {"a": pytest.approx(2 / 3), "b": pytest.approx(2 / 3)}


@pytest.mark.parametrize(
    "rows, score, repeats",
    [
        ([(1, 4), (2, 5), (3, 6)], 1.0, 0),
        ([(1, 4), (2, 5), (3, 6), (1, 4)], 0.75, 1),
        ([(1, 2), (1, 2), (1, 2)], 1 / 3, 2),
        ([(None, 1), (None, 1), (1, None)], 2 / 3, 1),
    ],
)
def test_uniqueness(spark, rows, score, repeats):
    row = dimensions.uniqueness(frame(spark, "a long, b long", *rows)).first()
    assert (row.uniqueness, row.duplicate_rows) == (pytest.approx(score), repeats)


def test_uniqueness_of_nothing(spark):
    row = dimensions.uniqueness(frame(spark, "a long")).first()
    assert (row.uniqueness, row.duplicate_rows, row.total_rows) == (0.0, 0, 0)


def test_uniqueness_merges_nan_null_and_signed_zero(spark):
    df = frame(spark, "a double", (float("nan"),), (None,), (0.0,), (-0.0,))
    assert dimensions.uniqueness(df).first().duplicate_rows == 2


def test_uniqueness_keeps_column_boundaries(spark):
    df = frame(spark, "a string, b string", ("x", None), (None, "x"), ('x","c1":"y', None))
    assert dimensions.uniqueness(df).first().uniqueness == 1.0


def consistency(df, **kw):
    datasets, columns = dimensions.consistency(df, **kw)
    return single(datasets, "consistency"), {r.col_name: r.conformance for r in columns.collect()}


def test_consistency_numeric(spark):
    assert consistency(frame(spark, "a long", (1,), (2,), (3,), (4,)))[0] == 1.0


def test_consistency_clean_text(spark):
    assert consistency(frame(spark, "n long, c string", (1, "x"), (2, "y")))[0] == 1.0


def test_consistency_sentinels(spark):
    df = frame(spark, "a string", ("real",), ("N/A",), ("N/A",), ("N/A",))
    assert consistency(df) == (0.0, {"a": 0.25})


def test_consistency_is_lenient_about_mixed_text(spark):
    df = frame(spark, "a string", *[(str(i),) for i in range(18)], ("oops",), ("bad",))
    assert consistency(df)[1] == {"a": 1.0}


def test_consistency_with_sentinels_that_parse(spark):
    df = frame(spark, "a string", ("-999",), ("-999",), ("7",), ("x",))
    assert consistency(df, sentinels=["-999"])[1] == {"a": 0.75}
    assert consistency(df, sentinels=["x"])[1] == {"a": 0.75}


def test_consistency_half(spark):
    assert consistency(frame(spark, "a string", ("a",), ("N/A",), ("b",), ("N/A",)))[1] == {
        "a": 0.5
    }


def test_consistency_exact_membership(spark):
    df = frame(spark, "a string", (" -",), ("n/A",), ("",), ("غير متاح",))
    assert consistency(df)[1] == {"a": 0.5}


def test_all_null_column_counts_as_numeric_unless_empty(spark):
    assert consistency(frame(spark, "a string", (None,), (None,)))[0] == 1.0
    assert consistency(frame(spark, "a string"))[0] == 0.0


def test_empty_dataset_keeps_its_row(spark):
    df = frame(spark, "k string, a long", ("x", 1), ("x", None))
    keys = frame(spark, "dataset_id string", ("x",), ("void",))
    for result, column in (
        (dimensions.completeness(df, "k", None, keys)[0], "completeness"),
        (dimensions.uniqueness(df, "k", None, keys), "uniqueness"),
        (dimensions.consistency(df, "k", None, keys)[0], "consistency"),
    ):
        got = {r.dataset_id: r[column] for r in result.collect()}
        assert got["void"] == 0.0 and got["x"] > 0


def test_wide_frames_are_batched(spark):
    names = [f"c{i}" for i in range(320)]
    df = spark.range(5).select(*[F.lit(i).alias(n) for i, n in enumerate(names)])
    stats = profile.column_stats(df)
    assert stats.count() == 320 and single(stats.agg(F.sum("n_rows").alias("s")), "s") == 1600


AUDIT = "2026-06-03"


@pytest.mark.parametrize(
    "lag, frequency, score, stale",
    [
        (0, 365, 1.0, False),
        (365, 365, 0.5, False),
        (730, 365, 0.0, False),
        (731, 365, 0.0, True),
        (1095, 365, 0.0, True),
        (100, None, 1 - 100 / 730, False),
        (-5, 365, 1.0, False),
    ],
)
def test_timeliness(spark, lag, frequency, score, stale):
    updated = dt.datetime(2026, 6, 3) - dt.timedelta(days=lag)
    updates = frame(spark, "dataset_id string, last_update timestamp", ("a", updated))
    row = dimensions.timeliness(updates, AUDIT, frequency).first()
    assert row.timeliness == pytest.approx(score)
    assert (row.days_lag, row.stale) == (max(lag, 0), stale)
    assert row.stated_frequency_days == 365


def test_timeliness_counts_elapsed_days_not_calendar_borders(spark):
    updated = dt.datetime(2026, 6, 1, 23, 0)
    updates = frame(spark, "dataset_id string, last_update timestamp", ("a", updated))
    assert dimensions.timeliness(updates, "2026-06-03").first().days_lag == 1


def test_timeliness_unknown(spark):
    updates = frame(spark, "dataset_id string, last_update timestamp", ("a", None))
    row = dimensions.timeliness(updates, AUDIT).first()
    assert (row.timeliness, row.days_lag, row.stale) == (0.0, None, True)


@pytest.mark.parametrize(
    "values, weights, expected",
    [
        ((1.0, 0.0), None, 0.5),
        ((1.0, None, 0.5), None, 0.75),
        ((None, None), None, 0.0),
        ((0.8, 0.4), {"s0": 3.0, "s1": 1.0}, 0.7),
        ((0.8, 0.4), {"s0": 0.0}, 0.0),
        ((float("nan"), 0.4), None, 0.4),
    ],
)
def test_composite(spark, values, weights, expected):
    scores = {f"s{i}": F.lit(v).cast("double") for i, v in enumerate(values)}
    row = spark.range(1).select(scoring.weighted_mean(scores, weights).alias("c")).first()
    assert row.c == pytest.approx(expected)


@pytest.mark.parametrize(
    "score, band",
    [(1.0, "A"), (0.85, "A"), (0.84, "B"), (0.70, "B"), (0.69, "C"), (0.0, "C")]
    + [(float("nan"), "C"), (None, "C")],
)
def test_bands(spark, score, band):
    column = scoring.readiness_band(F.lit(score).cast("double"))
    assert spark.range(1).select(column.alias("b")).first().b == f"Band {band}"


@pytest.mark.parametrize(
    "value, threshold, expected",
    [
        (0.95, 0.95, "pass"),
        (0.949, 0.95, "borderline"),
        (0.95 - 0.05, 0.95, "borderline"),
        (0.8999, 0.95, "fail"),
        (None, 0.95, "n/a"),
        (float("nan"), 0.95, "n/a"),
    ],
)
def test_verdicts(spark, value, threshold, expected):
    column = scoring.verdict(F.lit(value).cast("double"), F.lit(threshold))
    assert spark.range(1).select(column.alias("v")).first().v == expected


@pytest.mark.parametrize(
    "kappa, label",
    [(None, "n/a"), (-0.1, "poor"), (0.0, "slight"), (0.2, "fair"), (0.4, "moderate")]
    + [(0.6, "substantial"), (0.8, "almost perfect"), (1.0, "almost perfect")],
)
def test_kappa_labels(spark, kappa, label):
    column = scoring.kappa_label(F.lit(kappa).cast("double"))
    assert spark.range(1).select(column.alias("l")).first().l == label


@pytest.mark.parametrize(
    "text, expected",
    [("True", True), ("1", True), (" False ", False), ("0", False), ("", False), ("nan", False)]
    + [("None", False), ("x", True), (None, False)],
)
def test_truthy(spark, text, expected):
    column = scoring.truthy(F.lit(text).cast("string"))
    assert spark.range(1).select(column.alias("t")).first().t is expected
