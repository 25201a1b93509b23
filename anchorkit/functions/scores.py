"""Banded scores; the thresholds are data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (threshold, score), tested in order.
RATIO_BELOW = [(100, 4), (200, 3), (300, 2), (400, 1)]
BILIRUBIN_AT_LEAST = [(12.0, 4), (6.0, 3), (2.0, 2), (1.2, 1)]
PLATELETS_BELOW = [(20, 4), (50, 3), (100, 2), (150, 1)]
COMA_BELOW = [(6, 4), (10, 3), (13, 2), (15, 1)]
CREATININE_AT_LEAST = [(5.0, 4), (3.5, 3), (2.0, 2), (1.2, 1)]
URINE_BELOW = [(200, 4), (500, 3)]
SATURATION_LIMIT = 97
SATURATION_INTERCEPT, SATURATION_SLOPE = 64.0, 0.84
PRESSURE_BELOW = 70


def score_below(value: Column, bands: list[tuple[float, int]]) -> Column:
    """Score of the first band whose threshold exceeds ``value``; 0 otherwise and for NULL."""
    out = F.lit(0)
    for limit, score in reversed(bands):
        out = F.when(value < limit, score).otherwise(out)
    return out


def score_at_least(value: Column, bands: list[tuple[float, int]]) -> Column:
    out = F.lit(0)
    for limit, score in reversed(bands):
        out = F.when(value >= limit, score).otherwise(out)
    return out


def oxygen_ratio(pao2: Column, spo2: Column, fio2: Column) -> Column:
    """Measured PaO2/FiO2, else estimated from a saturation of at most 97; NULL without FiO2.

    FiO2 above 1 is a percentage.
    """
    fraction = F.when(fio2 > 1.0, fio2 / 100.0).otherwise(fio2)
    safe = F.when(fraction != 0, fraction)
    estimate = F.when(spo2 <= SATURATION_LIMIT, (spo2 / safe - SATURATION_INTERCEPT) / SATURATION_SLOPE)
    return F.when(pao2.isNotNull(), pao2 / safe).otherwise(estimate)


def respiratory(pao2: Column, spo2: Column, fio2: Column) -> Column:
    return score_below(oxygen_ratio(pao2, spo2, fio2), RATIO_BELOW)


def cardiovascular(dopamine: Column, epinephrine: Column, norepinephrine: Column,
                   vasopressin: Column, pressure: Column) -> Column:
    """Drug rates first, then mean pressure; a missing rate never satisfies a test."""
    return (
        F.when((dopamine > 15) | (epinephrine > 0.1) | (norepinephrine > 0.1), 4)
        .when((dopamine > 5) | (epinephrine <= 0.1) | (norepinephrine <= 0.1), 3)
        .when((dopamine <= 5) | (vasopressin == 1), 2)
        .when(pressure < PRESSURE_BELOW, 1)
        .otherwise(0)
    )


def hepatic(bilirubin: Column) -> Column:
    return score_at_least(bilirubin, BILIRUBIN_AT_LEAST)


def coagulation(platelets: Column) -> Column:
    return score_below(platelets, PLATELETS_BELOW)


def renal(creatinine: Column, urine: Column) -> Column:
    """The worse of the two signals."""
    return F.greatest(score_at_least(creatinine, CREATININE_AT_LEAST), score_below(urine, URINE_BELOW))


def neurological(coma: Column) -> Column:
    return score_below(coma, COMA_BELOW)
