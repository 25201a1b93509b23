"""Schema contracts and missing-value rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, needed: Iterable[str], what: str) -> None:
    """Raise ``KeyError`` naming the columns ``df`` lacks; reads the schema only."""
    absent = sorted(set(needed) - set(df.columns))
    if absent:
        raise KeyError(f"{what} lacks columns {absent}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value: replace NaN in every float and double column."""
    floats = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns
    ])


def to_number(column: str | Column) -> Column:
    """Numeric coercion: unparsable text and NaN become NULL."""
    value = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_time(column: str | Column) -> Column:
    """Timestamp coercion without zone; unparsable text becomes NULL."""
    return (F.col(column) if isinstance(column, str) else column).try_cast("timestamp_ntz")


def coerce_numeric(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Coerce every column except ``keep`` to double."""
    kept = set(keep)
    return df.select(*[F.col(c) if c in kept else to_number(c).alias(c) for c in df.columns])


def align_columns(df: DataFrame, columns: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """Fitted column order: absent columns become NULL doubles, extra ones are dropped."""
    present = set(df.columns)
    return df.select(*keep, *[
        F.col(c) if c in present else F.lit(None).cast("double").alias(c) for c in columns
    ])


def require_unique(df: DataFrame, key: str, what: str) -> None:
    """Raise when a value of ``key`` occurs more than once (eager, one aggregate); missing keys match nothing and may repeat."""
    twice = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: {key} {twice[0][key]!r} occurs {twice[0]['_n']} times")
