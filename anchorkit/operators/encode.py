"""Categories to 0/1 columns, top-N grouping, ranked diagnosis chapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorkit.checks import require_columns, to_number
from anchorkit.functions import codes as C
from anchorkit.functions.values import quoted, sql_literal
from anchorkit.operators.cohort import dedup, top_k
from anchorkit.operators.joins import balanced_join
from anchorkit.operators.ranges import range_totals
from anchorkit.session import scratch_path, staged


def top_categories(df: DataFrame, column: str, n: int) -> list[str]:
    """The ``n`` most frequent values, ties by name (eager, ``n`` rows)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return [r[column] for r in counts.orderBy(F.col("_n").desc(), F.col(column)).limit(n).collect()]


def group_rare(df: DataFrame, column: str, n: int, other: str = "Other") -> DataFrame:
    """Keep the ``n`` most frequent values of ``column``; all others become ``other``."""
    keep = top_categories(df, column, n)
    return df.withColumn(column, F.when(F.col(column).isin(keep), F.col(column)).otherwise(other))


#: Columns of a one-hot table; a column of more levels is encoded by :func:`sparse_one_hot`.
MOST_LEVELS = 1000


def levels_of(df: DataFrame, column: str) -> list:
    """Sorted distinct values (eager): each becomes a column of the result, so more than ``MOST_LEVELS`` are an error."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{column} has over {MOST_LEVELS} levels; use sparse_one_hot")
    return sorted(r[0] for r in found)


def level_table(df: DataFrame, column: str) -> DataFrame:
    """(column, level): every value with its number from 0 in ascending order, any number of values (a written table)."""
    known = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1).cast("long"))
    return range_totals(known, [], [column], "_one", "level").select(column, (F.col("level") - 1).alias("level"))


def sparse_one_hot(df: DataFrame, column: str, levels: DataFrame | None = None, *, out: str = "hot", level: str = "level",
                   drop_first: bool = True) -> DataFrame:
    """``df`` plus the number of the row's ``level`` and a sparse 0/1 vector ``out`` over the levels (a written table).

    The numbers come from a level table (:func:`level_table` of ``df``, or a fitted one) that is joined, so
    nothing of the levels reaches the driver but their number. The first level, a missing value and one
    that isn't in the table are the zero vector (without ``drop_first`` the first level has a place).
    """
    if levels is None:
        levels = level_table(df, column)
    n = levels.agg(F.count(F.lit(1))).first()[0]
    first = 1 if drop_first else 0
    width = max(n - first, 0)
    joined = balanced_join(df.drop(level, out), levels.select(column, F.col("level").alias(level)), [column], "left")
    place = (F.col(level) - first).cast("int")
    has = F.coalesce(place >= 0, F.lit(False))
    none_i, none_v = F.array().cast("array<int>"), F.array().cast("array<double>")
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).cast("int").alias("size"),
                      F.when(has, F.array(place)).otherwise(none_i).alias("indices"),
                      F.when(has, F.array(F.lit(1.0))).otherwise(none_v).alias("values"))
    # stored as the fields of a sparse vector and read back as one: no list of levels becomes part of a schema
    path = scratch_path(df.sparkSession, "one-hot")
    joined.withColumn(out, vector).write.parquet(path)
    fields = [*joined.schema.fields, T.StructField(out, VectorUDT())]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def one_hot(column: str, levels: list, prefix: str, drop_first: bool = True) -> list[Column]:
    """0/1 columns ``prefix_level`` for sorted levels, by default without the first."""
    kept = levels[1:] if drop_first else levels
    return [
        F.expr(f"CAST(coalesce({quoted(column)} = {sql_literal(level)}, false) AS INT) AS {quoted(f'{prefix}_{level}')}")
        for level in kept
    ]


def chapter_columns(chapter: str, prefix: str) -> list[Column]:
    """Fixed domain 1..22; chapter 0 has no column, so the columns never depend on the data."""
    return one_hot(chapter, list(range(1, C.N_CHAPTERS + 1)), prefix, drop_first=False)


def top_chapters(diagnoses: DataFrame, *, admission: str = "hadm_id", code: str = "icd_code",
                 version: str = "icd_version", order: str = "seq_num", keep_version: int = 10, subject: str | None = None) -> DataFrame:
    """Chapters of the first two codes of an admission: ([subject,] admission, diag1_chapter, diag2_chapter).

    With ``subject`` the rows are grouped by both keys, as the diagnosis extract is.

    An admission with a single code has NULL as its second chapter. A table that already holds
    both chapter columns passes through.
    """
    keys = [subject, admission] if subject else [admission]
    ready = [*keys, "diag1_chapter", "diag2_chapter"]
    if set(ready) <= set(diagnoses.columns):
        return diagnoses.select(*ready)
    require_columns(diagnoses, [*keys, code, version, order], "diagnoses")
    versioned = diagnoses.where(to_number(version) == keep_version).select(
        *keys, F.col(code).alias("_code"), to_number(order).alias("_order"))
    ranked = top_k(versioned, keys, [F.col("_order").asc_nulls_last(), F.col("_code").asc_nulls_last()], 2, "_rank")
    chapter = C.code_chapter("_code")
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_rank") == 1, chapter)).alias("diag1_chapter"),
        F.max(F.when(F.col("_rank") == 2, chapter)).alias("diag2_chapter"),
    )


def with_admissions(cohort: DataFrame, admissions: DataFrame | None, *, admission: str = "hadm_id") -> DataFrame:
    """Left join of admission type and place, one row per admission; absent columns are 'Unknown'."""
    wanted = ["admission_type", "admission_location"]
    if admissions is None:
        return cohort.select("*", *[F.lit("Unknown").alias(c) for c in wanted if c not in cohort.columns])
    found = [c for c in wanted if c in admissions.columns]
    base = cohort.drop(*wanted)
    if found:
        base = base.join(dedup(admissions.select(admission, *found), [admission]), admission, "left")
    return base.select("*", *[F.lit("Unknown").alias(c) for c in wanted if c not in found])


def administrative(cohort: DataFrame, diagnoses: DataFrame, admissions: DataFrame | None = None, *,
                   stay: str = "stay_id", admission: str = "hadm_id", unit: str = "first_careunit",
                   top_units: int = 8, unit_labels: dict[str, str] | None = None,
                   store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One-hot unit, admission type, admission place and the two diagnosis chapters per stay.

    ``store`` writes the labels (default: as a stage); one that keeps buckets of ``stay`` saves later joins an exchange.

    Column sets of the first three depend on the data (at most ``top_units`` + 1, 4 and 7
    labels, the first of each dropped); the chapter columns are always 44.
    """
    require_columns(cohort, [stay, admission, unit], "cohort")
    carried = [c for c in ["admission_type", "admission_location"] if c in cohort.columns]
    work = with_admissions(cohort.select(stay, admission, unit, *carried), admissions, admission=admission)
    work = work.join(top_chapters(diagnoses, admission=admission), admission, "left")
    # Stored once: the frequent units and the label sets are read from it before the columns are.
    labels = work.select(
        stay,
        C.unit_label(unit, unit_labels).alias("first_careunit"),
        C.admission_type("admission_type").alias("admission_type"),
        C.admission_location("admission_location").alias("admission_location"),
        F.coalesce("diag1_chapter", F.lit(0)).alias("diag1_chapter"),
        F.coalesce("diag2_chapter", F.lit(0)).alias("diag2_chapter"),
    )
    labelled = store(labels) if store else staged(labels, "labels")
    units = top_categories(labelled, "first_careunit", top_units)
    grouped = labelled.withColumn(
        "first_careunit", F.when(F.col("first_careunit").isin(units), F.col("first_careunit")).otherwise("Other"))
    named = ["first_careunit", "admission_type", "admission_location"]
    # One pass for the labels of all three columns, each set bounded by its mapping.
    seen = grouped.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in named]).first()
    return grouped.select(
        stay,
        *[e for c in named for e in one_hot(c, list(seen[c]), c)],
        *chapter_columns("diag1_chapter", "diag1_ch"),
        *chapter_columns("diag2_chapter", "diag2_ch"),
    )
