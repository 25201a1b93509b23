"""Registration helper and SQL text shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorkit.plans.retail import CHART_READINGS, DRUGS, LAB_READINGS, LOCATIONS, URINE


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(function):
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = sql
            return function
        return add


def r6(column: str | Column, name: str | None = None) -> Column:
    """Rounded to six decimals: sums of doubles depend on their order."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(f"`{c}`"), c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in row) + ")" for row in rows)


def _pick(values: list, index: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"list_extract([{items}], ({index})::INT)"


def _readings(name: str, rows: list[tuple], step: int) -> str:
    indexed = [(i, item, low, span) for i, (item, low, span) in enumerate(rows)]
    return f"""{name} AS (
  SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_orderkey AS stay_id, itemid,
         o_orderdate + to_minutes((l_suppkey * 37 + l_partkey * 11 + i * {step}) % 2160) AS charttime,
         floor((low::DOUBLE + (((l_partkey * (i + 3) + l_quantity::BIGINT) % 51) / 50.0::DOUBLE) * span::DOUBLE) * 1000 + 0.5) / 1000.0::DOUBLE AS valuenum
  FROM keyed, (VALUES {_values(indexed)}) AS v(i, itemid, low, span))"""


#: Common table expressions of the clinical views, as in ``plans.retail``.
CLINICAL_SQL = f"""
keyed AS (SELECT l.*, o_custkey, o_orderdate FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
icustays AS (
  SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderkey AS stay_id, o_orderpriority AS first_careunit,
         o_orderstatus AS last_careunit, o_orderdate AS intime,
         o_orderdate + to_hours(date_diff('day', o_orderdate, ship) % 900) AS outtime
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey) s ON l_orderkey = o_orderkey),
patients AS (
  SELECT c_custkey AS subject_id,
         CASE WHEN c_nationkey % 2 = 0 THEN 'M' WHEN c_nationkey % 7 = 0 THEN NULL ELSE 'f' END AS gender,
         (10 + c_custkey % 80)::INT AS anchor_age
  FROM customer),
admissions AS (
  SELECT o_orderkey AS hadm_id, o_orderpriority AS admission_type,
         {_pick(LOCATIONS, 'o_orderkey % 7 + 1')} AS admission_location
  FROM orders),
diagnoses AS (
  SELECT o_custkey AS subject_id, l_orderkey AS hadm_id,
         chr((65 + l_partkey % 26)::INT) || (l_suppkey % 10)::VARCHAR || (l_partkey % 10)::VARCHAR AS icd_code,
         CASE WHEN l_returnflag = 'A' THEN 9 ELSE 10 END AS icd_version, l_linenumber AS seq_num
  FROM keyed),
{_readings('chartevents', CHART_READINGS, 7)},
{_readings('labevents', LAB_READINGS, 29)},
inputevents AS (
  SELECT l_orderkey AS stay_id, {_pick(DRUGS, f'l_partkey % {len(DRUGS)} + 1')} AS itemid,
         o_orderdate + to_minutes((l_suppkey * 53 + l_partkey) % 2160) AS starttime,
         CASE WHEN l_tax > 0.01 THEN l_discount * l_quantity / 10 END AS rate
  FROM keyed),
outputevents AS (
  SELECT l_orderkey AS stay_id, {_pick(URINE, f'l_suppkey % {len(URINE)} + 1')} AS itemid,
         o_orderdate + to_minutes((l_suppkey * 53 + l_partkey) % 2160) AS charttime, l_quantity * 12 AS value
  FROM keyed),
cohort AS (
  SELECT f.subject_id, hadm_id, stay_id, first_careunit, last_careunit, intime, outtime, los_hours, los_days, gender,
         anchor_age AS age
  FROM (SELECT *, (epoch_us(outtime) - epoch_us(intime)) / 3600000000.0::DOUBLE AS los_hours,
               (epoch_us(outtime) - epoch_us(intime)) / 86400000000.0::DOUBLE AS los_days,
               row_number() OVER (PARTITION BY subject_id ORDER BY intime ASC NULLS LAST, stay_id) AS rn
        FROM icustays) f
  JOIN patients p ON f.subject_id = p.subject_id
  WHERE rn = 1 AND los_hours >= 4 AND los_days <= 30 AND anchor_age >= 18)"""


def clinical(select: str, more: str = "") -> str:
    """A statement over the clinical views, with further table expressions ``more``."""
    return f"WITH {CLINICAL_SQL}{',' + more if more else ''}\n{select}"
