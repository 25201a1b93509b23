"""Feature tables of the clinical schema, composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorkit.checks import require_columns, require_unique
from anchorkit.functions import scores as S
from anchorkit.operators import cohort as co
from anchorkit.operators.align import band_aligned_min
from anchorkit.operators.encode import administrative
from anchorkit.operators.joins import BROADCAST_MAX_BYTES, measured_bytes
from anchorkit.operators.occupancy import occupancy
from anchorkit.operators.quality import check_signals
from anchorkit.operators.windows import EventSchema, events_in_window, mean_columns, precomputed_means, window_means
from anchorkit.plans import items as I
from anchorkit.session import bucketed, staged

CHART = EventSchema("stay_id", "itemid", "charttime", "valuenum")
LAB = EventSchema("hadm_id", "itemid", "charttime", "valuenum")
OUTPUT = EventSchema("stay_id", "itemid", "charttime", "value")


def vitals(cohort: DataFrame, chartevents: DataFrame | None = None, precomputed: DataFrame | None = None,
           **options) -> DataFrame:
    """Seven vital means of the first 24 hours per stay."""
    if precomputed is not None:
        return precomputed_means(precomputed, I.VITAL_COLUMNS, "stay_id")
    if chartevents is None:
        raise ValueError("give chartevents or a precomputed table")
    return window_means(chartevents, cohort, I.VITALS, CHART, **options)


def labs(cohort: DataFrame, labevents: DataFrame | None = None, precomputed: DataFrame | None = None,
         **options) -> DataFrame:
    """Nineteen laboratory means of the first 24 hours per stay; events are keyed by admission."""
    if precomputed is not None:
        key = "stay_id" if "stay_id" in precomputed.columns else "hadm_id"
        return precomputed_means(precomputed, I.LAB_COLUMNS, key, cohort)
    if labevents is None:
        raise ValueError("give labevents or a precomputed table")
    return window_means(labevents, cohort, I.LABS, LAB, **options)


#: Items of the feature means and of the severity score, by event table.
MEAN_ITEMS = {"chartevents": [it.item for it in I.VITALS], "labevents": [it.item for it in I.LABS]}
SCORE_ITEMS = {
    "chartevents": [I.SPO2, I.FIO2, *I.PRESSURE, I.EYE, I.VERBAL, I.MOTOR],
    "labevents": [I.PAO2, I.BILIRUBIN, I.PLATELETS, I.CREATININE],
    "inputevents": [*I.NOREPINEPHRINE, *I.EPINEPHRINE, *I.DOPAMINE, *I.DOBUTAMINE, *I.VASOPRESSIN],
    "outputevents": I.URINE,
}


def _drug_rates(inputevents: DataFrame, cohort: DataFrame, items: list, **options) -> DataFrame:
    """Drug rows that start inside the window, also those without a rate (any row counts as 'on')."""
    marked = inputevents.withColumn("_given", F.lit(1.0))
    schema = EventSchema("stay_id", "itemid", "starttime", "_given", ("rate",))
    rows = events_in_window(marked, cohort, items, schema, **options)
    return rows.select("stay_id", "item", "time", F.col("rate").cast("double").alias("value"))


def event_store(cohort: DataFrame, tables: Mapping[str, DataFrame], *, means: bool = True, score: bool = True, hours: int = 24,
                max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """(stay_id, item, time, value): the windowed events of all features, written once in buckets of the stay.

    Every event table is read once, for the items of the feature ``means``, of the severity ``score``, or
    of both. Item ids of different tables differ. What is built above the store by stay needs no exchange.
    """
    wanted: dict[str, list] = {}
    for items in ([MEAN_ITEMS] if means else []) + ([SCORE_ITEMS] if score else []):
        for name, ids in items.items():
            wanted[name] = list(dict.fromkeys([*wanted.get(name, []), *ids]))
    options = {"hours": hours, "max_bytes": max_bytes, "anchor_bytes": measured_bytes(cohort.select("stay_id", "hadm_id", "intime"))}
    schemas = {"chartevents": CHART, "labevents": LAB, "outputevents": OUTPUT}
    streams = [
        _drug_rates(tables[name], cohort, ids, **options) if name == "inputevents"
        else events_in_window(tables[name], cohort, ids, schemas[name], **options).select("stay_id", "item", "time", "value")
        for name, ids in wanted.items()]
    return bucketed(reduce(DataFrame.unionByName, streams), "stay_id", "events")


def feature_means(store: DataFrame) -> DataFrame:
    """Vital and laboratory means per stay in one aggregation over the store."""
    return store.where(F.col("item").isin([*MEAN_ITEMS["chartevents"], *MEAN_ITEMS["labevents"]])).groupBy("stay_id").agg(
        *mean_columns(I.VITALS), *mean_columns(I.LABS))


def severity_signals(store: DataFrame) -> DataFrame:
    """All raw signals of the score per stay, in one aggregation over the store."""
    item, value = F.col("item"), F.col("value")

    def pick(items: int | list[int], low: float | None = None, high: float | None = None) -> Column:
        ids = items if isinstance(items, list) else [items]
        ok = item.isin(ids)
        return F.when(ok if low is None else ok & value.between(low, high), value)

    return store.groupBy("stay_id").agg(
        F.min(pick(I.PAO2)).alias("pao2"),
        F.min(pick(I.SPO2, 50, 100)).alias("spo2"),
        F.max(pick(I.FIO2)).alias("fio2"),
        F.avg(pick(I.PRESSURE, 0, 300)).alias("pressure"),
        F.max(pick(I.NOREPINEPHRINE)).alias("norepinephrine"),
        F.max(pick(I.EPINEPHRINE)).alias("epinephrine"),
        F.max(pick(I.DOPAMINE)).alias("dopamine"),
        F.max(F.when(item.isin(I.VASOPRESSIN), 1)).alias("vasopressin"),
        F.max(pick(I.BILIRUBIN)).alias("bilirubin_max"),
        F.min(pick(I.PLATELETS)).alias("platelets_min"),
        F.max(pick(I.CREATININE, 0.1, 20)).alias("creatinine_max"),
        F.sum(pick(I.URINE)).alias("urine_24h"),
    )


def coma_minimum(store: DataFrame, tolerance_seconds: int = 1800) -> DataFrame:
    """Lowest sum of eye, verbal and motor readings taken within 30 minutes of the eye reading."""
    rows = store.where(F.col("item").isin([I.EYE, I.VERBAL, I.MOTOR]))
    return band_aligned_min(rows, entity="stay_id", item="item", time="time", value="value", base=I.EYE,
                            others=[I.VERBAL, I.MOTOR], tolerance_seconds=tolerance_seconds, out="gcs_min")


def severity_from(cohort: DataFrame, store: DataFrame) -> DataFrame:
    """Six organ scores 0..4 and their total for every stay of the cohort; not assessable scores 0.

    ``urine_24h`` and ``bilirubin_max`` stay NULL when nothing was measured.
    """
    signals, coma = severity_signals(store), coma_minimum(store)
    c = F.col
    scored = cohort.select("stay_id").join(signals, "stay_id", "left").join(coma, "stay_id", "left").select(
        "stay_id",
        S.respiratory(c("pao2"), c("spo2"), c("fio2")).alias("sofa_resp"),
        S.cardiovascular(c("dopamine"), c("epinephrine"), c("norepinephrine"), c("vasopressin"),
                         c("pressure")).alias("sofa_cardio"),
        S.hepatic(c("bilirubin_max")).alias("sofa_hepatic"),
        S.coagulation(c("platelets_min")).alias("sofa_coag"),
        S.renal(c("creatinine_max"), c("urine_24h")).alias("sofa_renal"),
        S.neurological(c("gcs_min")).alias("sofa_neuro"),
        "urine_24h", "bilirubin_max",
    )
    total = reduce(lambda a, b: a + b, [c(p) for p in I.SEVERITY_PARTS])
    return scored.select("stay_id", *I.SEVERITY_PARTS, total.alias("sofa_total"), "urine_24h", "bilirubin_max")


def severity_score(cohort: DataFrame, chartevents: DataFrame, labevents: DataFrame, inputevents: DataFrame,
                   outputevents: DataFrame, hours: int = 24, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """:func:`severity_from` a store of the score's items."""
    tables = {"chartevents": chartevents, "labevents": labevents, "inputevents": inputevents, "outputevents": outputevents}
    return severity_from(cohort, event_store(cohort, tables, means=False, hours=hours, max_bytes=max_bytes))


def checked_severity(score: DataFrame, strict: bool = True) -> DataFrame:
    """The score table after the signal check: constant parts or empty raw signals raise (or warn)."""
    check_signals(score, ["sofa_total", *I.SEVERITY_PARTS], ["urine_24h", "bilirubin_max"], strict)
    return score


def base_features(tables: Mapping[str, DataFrame], *, cohort: DataFrame | None = None, min_age: float = 18,
                  min_hours: float = 4, max_days: float = 30, first_only: bool = True, short: float = 2,
                  long: float = 7, top_units: int = 8, los: str | None = None, store: DataFrame | None = None) -> DataFrame:
    """One row per cohort stay: identifiers, demographics, administration, vitals, labs, outcomes.

    ``tables``: icustays, patients, admissions, diagnoses_icd, chartevents, labevents. Cohort, labels and
    events are written in buckets of the stay, so the groups are joined without an exchange; every
    group has one row per stay, so the joins keep the cohort's rows; stays without events have NULLs.
    Pass a stored cohort as ``cohort``, an :func:`event_store` that has the means' items as ``store``.
    """
    people = cohort if cohort is not None else staged(co.select_cohort(
        tables["icustays"], tables["patients"], min_age=min_age, min_hours=min_hours, max_days=max_days,
        first_only=first_only, los=los), "cohort")
    people = bucketed(people, "stay_id", "cohort")
    events = store if store is not None else event_store(people, tables, score=False)
    labels = administrative(people, tables["diagnoses_icd"], tables["admissions"], top_units=top_units,
                            store=lambda df: bucketed(df, "stay_id", "labels"))
    joined = reduce(lambda df, g: df.join(g, "stay_id", "left"), [co.demographics(people), labels, feature_means(events)], co.base_frame(people))
    return co.add_outcomes(joined, "los_days", short, long)


def extended_features(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Base table plus severity (or occupancy) columns by stay."""
    require_columns(base, ["stay_id"], "base features")
    require_unique(extra, "stay_id", "extra features")
    return base.join(extra, "stay_id", "left")


def with_occupancy(base: DataFrame, cohort: DataFrame) -> DataFrame:
    return extended_features(base, occupancy(cohort))
