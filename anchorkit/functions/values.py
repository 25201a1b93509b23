"""Scalar column expressions for durations, outcomes, conversions and hash order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_literal(value: int | float | Decimal | str) -> str:
    """A number or text as SQL; doubles keep their type."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, Decimal):
        return f"{value}BD"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, as BIGINT (a sortable key)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _col(ts))


def hours_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(float(MICROS_PER_HOUR))


def days_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(float(MICROS_PER_DAY))


def in_window(ts: str | Column, anchor: str | Column, hours: int) -> Column:
    """Closed at both ends: ``anchor <= ts <= anchor + hours``."""
    return _col(ts).between(_col(anchor), _col(anchor) + F.expr(f"INTERVAL '{int(hours)}' HOUR"))


def log_target(days: str | Column) -> Column:
    return F.log1p(_col(days))


def days_from_log(pred: str | Column) -> Column:
    """Back-transform of the log target, bounded below by zero."""
    return F.greatest(F.lit(0.0), F.expm1(_col(pred)))


def stay_class(days: str | Column, short: float, long: float) -> Column:
    """0 up to ``short`` days, 2 beyond ``long`` days, else 1; a missing length is class 1."""
    d = _col(days)
    return F.when(d <= short, 0).when(d > long, 2).otherwise(1)


def flag(condition: Column) -> Column:
    """0/1 of a predicate; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def percent_change(base: Column, delta: Column) -> Column:
    """``delta`` in percent of ``|base|``; NULL for a zero base."""
    return F.when(base != 0, delta / F.abs(base) * 100.0)


def hash_text(seed: int | str, *keys: str | Column) -> Column:
    """32 hex digits that order rows at random but reproducibly (``md5(seed:key[:key])``)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]))


def hash_bucket(hashed: Column, hex_digits: int = 3) -> Column:
    """Leading digits of :func:`hash_text` as a number: an even, order-keeping bucket."""
    return F.conv(F.substring(hashed, 1, hex_digits), 16, 10).cast("int")


def hash_unit(hashed: Column) -> Column:
    """A number in [0, 1) from the leading 12 hex digits."""
    return F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
