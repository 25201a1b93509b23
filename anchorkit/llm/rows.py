"""Rows as the operators see them: own column names, a row number that survives recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorkit.session import staged

#: White space of all word rules: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def named(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` whatever characters the name has."""
    return df["`" + name.replace("`", "``") + "`"]


def numbered(df: DataFrame, name: str = "rows") -> tuple[DataFrame, str]:
    """``df`` written once below the shared folder with a unique long per row; also the long's column name.

    The number is stored with its row, so later readers and retried tasks see the same one, null or
    repeated keys included.
    """
    row = fresh(df, "row_no")
    return staged(df.withColumn(row, F.monotonically_increasing_id()), name), row


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of ``text``; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)
