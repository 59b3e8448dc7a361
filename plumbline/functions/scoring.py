"""Column expressions that turn measures into scores, bands and verdicts.

All of them treat NaN as null first: Spark orders NaN above every number, so
an unguarded ``NaN >= 0.85`` would be true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.defaults import BAND_CUTS, UPDATE_FREQUENCY_DAYS, VERDICT_WINDOW


def _real(value: Column) -> Column:
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """``part / whole`` as double, ``empty`` where the denominator is 0."""
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(
        F.try_divide(part.cast("double"), whole.cast("double"))
    )


def weighted_mean(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the scores that are present.

    Weights default to 1 each; a score missing from ``weights`` weighs 0. With
    nothing to average the result is 0.0.
    """
    total, mass = F.lit(0.0), F.lit(0.0)
    for name, score in scores.items():
        weight = F.lit(float(1.0 if weights is None else weights.get(name, 0.0)))
        score = _real(score)
        total = total + F.coalesce(score * weight, F.lit(0.0))
        mass = mass + F.when(score.isNotNull(), weight).otherwise(F.lit(0.0))
    return ratio(total, mass)


def present_mean(scores: list[Column]) -> Column:
    """Plain mean of the scores that are present, null when none is."""
    scores = [_real(s) for s in scores]
    held = F.array_compact(F.array(*scores))
    total = F.aggregate(held, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(held) > 0, total / F.size(held))


def readiness_band(score: Column, cuts: tuple[float, float] = BAND_CUTS) -> Column:
    score = _real(score)
    return (
        F.when(score >= F.lit(cuts[0]), "Band A")
        .when(score >= F.lit(cuts[1]), "Band B")
        .otherwise("Band C")
    )


def verdict(value: Column, threshold: Column, window: float = VERDICT_WINDOW) -> Column:
    """pass / borderline / fail against a threshold, n/a without a value."""
    value, threshold = _real(value), threshold.cast("double")
    return (
        F.when(value.isNull(), "n/a")
        .when(value >= threshold, "pass")
        .when(value < threshold - F.lit(float(window)), "fail")
        .otherwise("borderline")
    )


def verdict_weight(text: Column) -> Column:
    """Heat value of a verdict text: pass 1, fail 0, everything else one half."""
    word = F.lower(F.trim(text))
    return F.when(word == "pass", 1.0).when(word == "fail", 0.0).otherwise(0.5)


def truthy(value: Column) -> Column:
    """Text truthiness; only false, nan, none, 0 and blank count as false."""
    word = F.lower(F.trim(value.cast("string")))
    return F.coalesce(~word.isin("false", "nan", "none", "0", ""), F.lit(False))


def kappa_label(kappa: Column) -> Column:
    """Verbal strength of an agreement coefficient; undefined stays n/a."""
    kappa = _real(kappa)
    return (
        F.when(kappa.isNull(), "n/a")
        .when(kappa < 0, "poor")
        .when(kappa < 0.20, "slight")
        .when(kappa < 0.40, "fair")
        .when(kappa < 0.60, "moderate")
        .when(kappa < 0.80, "substantial")
        .otherwise("almost perfect")
    )


def traffic_light(value: Column, green: Column | float, amber: Column | float) -> Column:
    """green at or above one cut, amber at or above the other, else red."""
    value = _real(value)
    green = green if isinstance(green, Column) else F.lit(float(green))
    amber = amber if isinstance(amber, Column) else F.lit(float(amber))
    return F.when(value >= green, "green").when(value >= amber, "amber").otherwise("red")


def days_behind(last_update: Column, audit_date: Column) -> Column:
    """Whole elapsed days from the last update to the audit, at least 0; null if unknown."""
    elapsed = F.timestamp_diff("DAY", last_update.cast("timestamp"), audit_date.cast("timestamp"))
    return F.when(elapsed >= 0, elapsed).when(elapsed < 0, F.lit(0).cast("long"))


def freshness(lag_days: Column, frequency_days: Column | None = None) -> Column:
    """1 for data updated today, falling to 0 at two update periods."""
    period = F.lit(UPDATE_FREQUENCY_DAYS) if frequency_days is None else frequency_days
    period = F.coalesce(period, F.lit(UPDATE_FREQUENCY_DAYS))
    used = F.least(F.lit(1.0), lag_days / (2 * period))
    return F.when(lag_days.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - used))
