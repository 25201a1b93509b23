"""The clinical schema as views over retail tables: orders are stays, lines are measurements.

Everything is a projection of ``orders``, ``lineitem`` and ``customer``, so the work grows with
those tables. Item ids, times and values are spread by key arithmetic to reach every branch of
the feature builds (in and out of range, inside and outside the window).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (item id, lowest value, span) of the generated readings.
CHART_READINGS = [
    (220045, 10.0, 310.0), (220277, 45.0, 60.0), (220210, 2.0, 62.0), (223761, 80.0, 30.0), (223762, 25.0, 20.0),
    (220739, 1.0, 4.0), (223900, 1.0, 5.0), (223901, 1.0, 6.0), (223835, 0.2, 100.0), (220052, 30.0, 100.0),
    (220181, 30.0, 280.0), (225312, 40.0, 80.0),
]
LAB_READINGS = [
    (50868, 0.0, 45.0), (50882, 2.0, 50.0), (50902, 65.0, 80.0), (50912, 0.0, 8.0), (50931, 30.0, 600.0),
    (50983, 95.0, 90.0), (50960, 0.2, 5.0), (50971, 1.0, 9.0), (50970, 0.2, 10.0), (51006, 0.0, 160.0),
    (51221, 4.0, 62.0), (51222, 1.0, 22.0), (51248, 12.0, 35.0), (51249, 18.0, 28.0), (51250, 45.0, 90.0),
    (51277, 8.0, 28.0), (51279, 0.5, 10.0), (51301, 0.0, 82.0), (51265, 1.0, 400.0), (50885, 0.1, 15.0),
    (50821, 40.0, 120.0),
]
DRUGS = [221906, 221289, 221662, 221653, 222315, 225158]
URINE = [226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558, 227488, 227489]
LOCATIONS = [
    "EMERGENCY ROOM", "TRANSFER FROM SKILLED NURSING", "TRANSFER FROM HOSPITAL", "CLINIC REFERRAL",
    "PHYSICIAN REFERRAL", "WALK-IN/SELF REFERRAL", "INFORMATION NOT AVAILABLE",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan has fewer splits than cores (one small file, say).

    A scan of many splits passes unchanged: nothing is shuffled for balance at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _readings(lines: DataFrame, readings: list[tuple], step: int) -> DataFrame:
    """One row per line and reading."""
    rows = ", ".join(f"named_struct('i', {i}, 'itemid', {item}, 'low', {low}D, 'span', {span}D)"
                     for i, (item, low, span) in enumerate(readings))
    return lines.selectExpr("*", f"inline(array({rows}))").selectExpr(
        "o_custkey AS subject_id", "l_orderkey AS hadm_id", "l_orderkey AS stay_id", "itemid",
        f"o_orderdate + make_dt_interval(0, 0, CAST((l_suppkey * 37 + l_partkey * 11 + i * {step}) % 2160 AS INT)) AS charttime",
        "floor((low + ((l_partkey * (i + 3) + CAST(l_quantity AS BIGINT)) % 51) / 50D * span) * 1000D + 0.5D) / 1000D AS valuenum")


def _pick(values: list, index: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"element_at(array({items}), CAST({index} % {len(values)} + 1 AS INT))"


_STARTED = "o_orderdate + make_dt_interval(0, 0, CAST((l_suppkey * 53 + l_partkey) % 2160 AS INT))"


class ClinicalViews(Mapping):
    """Table name to DataFrame; a view is planned when it is first asked for."""

    NAMES = ["icustays", "patients", "admissions", "diagnoses_icd", "chartevents", "labevents", "inputevents", "outputevents"]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        if name not in self._built:
            self._built[name] = getattr(self, "_" + name)()
        return self._built[name]

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)

    def _lines(self) -> DataFrame:
        if "lines" not in self._built:
            orders = table(self.spark, self.sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey", "o_orderdate")
            self._built["lines"] = spread(table(self.spark, self.sf_dir, "lineitem")).join(orders, "l_orderkey")
        return self._built["lines"]

    def _icustays(self) -> DataFrame:
        ends = table(self.spark, self.sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("_ship"))
        # Shipping delays of up to years are scaled to stays of up to about five weeks.
        return table(self.spark, self.sf_dir, "orders").join(ends, "o_orderkey").selectExpr(
            "o_custkey AS subject_id", "o_orderkey AS hadm_id", "o_orderkey AS stay_id", "o_orderpriority AS first_careunit",
            "o_orderstatus AS last_careunit", "o_orderdate AS intime",
            "o_orderdate + make_dt_interval(0, CAST(datediff(_ship, o_orderdate) % 900 AS INT)) AS outtime")

    def _patients(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "customer").selectExpr(
            "c_custkey AS subject_id",
            "CASE WHEN c_nationkey % 2 = 0 THEN 'M' WHEN c_nationkey % 7 = 0 THEN NULL ELSE 'f' END AS gender",
            "CAST(10 + c_custkey % 80 AS INT) AS anchor_age")

    def _admissions(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "orders").selectExpr(
            "o_orderkey AS hadm_id", "o_orderpriority AS admission_type", f"{_pick(LOCATIONS, 'o_orderkey')} AS admission_location")

    def _diagnoses_icd(self) -> DataFrame:
        return self._lines().selectExpr(
            "o_custkey AS subject_id", "l_orderkey AS hadm_id",
            "char(65 + l_partkey % 26) || CAST(l_suppkey % 10 AS STRING) || CAST(l_partkey % 10 AS STRING) AS icd_code",
            "CASE WHEN l_returnflag = 'A' THEN 9 ELSE 10 END AS icd_version", "l_linenumber AS seq_num")

    def _chartevents(self) -> DataFrame:
        return _readings(self._lines(), CHART_READINGS, 7)

    def _labevents(self) -> DataFrame:
        return _readings(self._lines(), LAB_READINGS, 29)

    def _inputevents(self) -> DataFrame:
        return self._lines().selectExpr(
            "l_orderkey AS stay_id", f"{_pick(DRUGS, 'l_partkey')} AS itemid", f"{_STARTED} AS starttime",
            "CASE WHEN l_tax > 0.01D THEN l_discount * l_quantity / 10D END AS rate")

    def _outputevents(self) -> DataFrame:
        return self._lines().selectExpr(
            "l_orderkey AS stay_id", f"{_pick(URINE, 'l_suppkey')} AS itemid", f"{_STARTED} AS charttime", "l_quantity * 12 AS value")


def clinical_views(spark: SparkSession, sf_dir: str) -> ClinicalViews:
    return ClinicalViews(spark, sf_dir)
