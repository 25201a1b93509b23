"""Cohort selection: first rows per entity, deterministic dedup, filters and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorkit.checks import require_columns, to_number
from anchorkit.functions import values as V
from anchorkit.operators.joins import balanced_join


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank.

    ``order`` must be total. The rank filter is planned as a group limit, which keeps ``k`` rows
    per group on the map side, so a group of any size shuffles ``k`` rows per task.
    """
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_k(df, by, order, 1, "_rank").drop("_rank")


def dedup(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per key; which one is settled by all other columns, so reruns agree."""
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in by]
    return keep_first(df, by, rest or [F.col(by[0])])


def select_cohort(stays: DataFrame, patients: DataFrame, *, subject: str = "subject_id", stay: str = "stay_id",
                  start: str = "intime", end: str = "outtime", los: str | None = None,
                  min_age: float = 18, min_hours: float = 4, max_days: float = 30,
                  first_only: bool = True) -> DataFrame:
    """Adult first stays of admissible length, joined to gender and age.

    The stay is ranked before the length and age filters: a subject whose first stay fails a
    filter contributes nothing. ``los`` names a column of lengths in days that replaces the
    computed one. Age is ``anchor_age`` or else ``age`` of ``patients``.
    """
    require_columns(stays, [subject, stay, start, end], "stays")
    age = "anchor_age" if "anchor_age" in patients.columns else "age"
    require_columns(patients, [subject, "gender", age], "patients")
    ranked = (
        top_k(stays, [subject], [F.col(start).asc_nulls_last(), F.col(stay)], 1, "_rank").drop("_rank")
        if first_only else stays
    )
    measured = ranked.withColumn("los_hours", V.hours_between(start, end)).withColumn(
        "los_days", to_number(los) if los else V.days_between(start, end)
    )
    people = patients.select(subject, "gender", F.col(age).alias("age"))
    kept = measured.where((F.col("los_hours") >= min_hours) & (F.col("los_days") <= max_days))
    adults = people.where(to_number("age") >= min_age)
    carried = [c for c in ["hadm_id", "first_careunit", "last_careunit"] if c in stays.columns]
    joined = kept.join(adults, subject) if first_only else balanced_join(kept, adults, [subject])
    return joined.select(
        subject, *[c for c in ["hadm_id"] if c in carried], stay,
        *[c for c in carried if c != "hadm_id"], start, end, "los_hours", "los_days", "gender", "age",
    )


def base_frame(cohort: DataFrame, stay: str = "stay_id") -> DataFrame:
    """Identifier and outcome columns, one row per stay."""
    wanted = [stay, "subject_id", "hadm_id", "los_days", "los_hours", "first_careunit", "intime", "outtime"]
    return dedup(cohort.select(*[c for c in wanted if c in cohort.columns]), [stay])


def add_outcomes(df: DataFrame, days: str = "los_days", short: float = 2, long: float = 7) -> DataFrame:
    """``los_log`` and ``los_class`` from the length in days."""
    numeric = df.withColumn(days, to_number(days))
    return numeric.withColumn("los_log", V.log_target(days)).withColumn(
        "los_class", V.stay_class(days, short, long))


def demographics(cohort: DataFrame, stay: str = "stay_id") -> DataFrame:
    """Numeric age and a male flag; a missing gender is 0."""
    require_columns(cohort, [stay, "age", "gender"], "cohort")
    return cohort.select(stay, to_number("age").alias("age"),
                         V.flag(F.upper(F.col("gender").cast("string")) == "M").alias("gender_male"))
