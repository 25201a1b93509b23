"""Named-table loading from CSV, Parquet or JDBC, and SQL over loaded tables."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorkit.session import shuffle_width, staged
from anchorkit.sources import files
from anchorkit.sources.schemas import HOSPITAL_TABLES, TABLE_TYPES

SOURCES = ("csv", "parquet", "postgresql")
#: Whole-number columns over which large tables are read in ranges.
TABLE_KEYS = {"icustays": "stay_id", "chartevents": "stay_id", "inputevents": "stay_id", "outputevents": "stay_id",
              "labevents": "subject_id", "diagnoses_icd": "subject_id", "admissions": "hadm_id", "patients": "subject_id"}


def source_of(config: dict[str, Any], table: str) -> str:
    """Source of one table: its own override or the default; an unknown source is an error."""
    data = config["data"]
    source = str(data.get("table_sources", {}).get(table, data.get("source", "parquet"))).lower()
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r} for {table}")
    return source


def load_table(spark: SparkSession, config: dict[str, Any], table: str, columns: list[str] | None = None) -> DataFrame:
    """One table by name; ``columns`` prunes at the scan."""
    source = source_of(config, table)
    if source == "csv":
        df = read_csv(spark, csv_path(spark, config, table), TABLE_TYPES.get(table, {}))
    elif source == "parquet":
        df = read_parquet(spark, config, table)
    else:
        df = spark.read.format("jdbc").options(**with_bounds(spark, config, table, jdbc_options(config, table, shuffle_width(spark)))).load()
    return df.select(*columns) if columns else df


def load_tables(spark: SparkSession, config: dict[str, Any], names: list[str]) -> dict[str, DataFrame]:
    return {name: load_table(spark, config, name) for name in names}


def read_parquet(spark: SparkSession, config: dict[str, Any], table: str) -> DataFrame:
    section = config["data"]["parquet"]
    path = f"{section['base_path'].rstrip('/')}/{section.get('files', {}).get(table, table + '.parquet')}"
    if not files.exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def csv_path(spark: SparkSession, config: dict[str, Any], table: str) -> str:
    """The configured file, or the same name with ``.gz``."""
    section = config["data"]["csv"]
    if table not in section["files"]:
        raise KeyError(f"no CSV file configured for {table}")
    path = f"{section['base_path'].rstrip('/')}/{section['files'][table]}"
    for candidate in (path, path + ".gz"):
        if files.exists(spark, candidate):
            return candidate
    raise FileNotFoundError(path)


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """Header-driven CSV: columns are matched by name, known ones are cast, unknown ones stay text.

    No inference pass. Unparsable values become NULL. One gzip file is one task, so its rows are
    redistributed at once; land such a table as parquet (``ingest.load_by_header``) before use.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    types = types or {}
    cols = []
    for name in raw.columns:
        clean = name.strip()
        cast = F.col(f"`{name}`").try_cast(types[clean]) if clean in types else F.col(f"`{name}`")
        cols.append(cast.alias(clean))
    typed = raw.select(*cols)
    return typed.repartition(shuffle_width(spark)) if path.endswith(".gz") else typed


def jdbc_options(config: dict[str, Any], table: str, partitions: int = 8) -> dict[str, str]:
    """Reader options: schema by table, parallel ranges when a partition column is configured."""
    pg = config["data"]["postgresql"]
    schema = pg["schema_hosp"] if table in HOSPITAL_TABLES else pg["schema_icu"]
    options = {
        "url": f"jdbc:postgresql://{pg['host']}:{pg['port']}/{pg['dbname']}",
        "dbtable": f"{schema}.{table}", "user": pg["user"], "password": pg.get("password", ""),
        "driver": pg.get("driver", "org.postgresql.Driver"), "fetchsize": str(pg.get("fetchsize", 50_000)),
    }
    split = pg.get("partitioning", {}).get(table)
    if split:
        options.update(partitionColumn=split["column"], lowerBound=str(split["lower"]), upperBound=str(split["upper"]),
                       numPartitions=str(split.get("partitions", partitions)))
    return options


def with_bounds(spark: SparkSession, config: dict[str, Any], table: str, options: dict[str, str]) -> dict[str, str]:
    """Options with parallel ranges over the table's key, from its least and greatest value, unless ranges are configured."""
    key = TABLE_KEYS.get(table)
    if "partitionColumn" in options or key is None:
        return options
    plain = {k: v for k, v in options.items() if k != "dbtable"}
    asked = f"(SELECT min({key}) AS low, max({key}) AS high FROM {options['dbtable']}) AS bounds"
    row = spark.read.format("jdbc").options(**plain, dbtable=asked).load().first()
    return ranged(options, key, row["low"], row["high"], shuffle_width(spark))


def ranged(options: dict[str, str], key: str, low: int | None, high: int | None, partitions: int) -> dict[str, str]:
    """Options that read ``partitions`` ranges of ``key``; an empty table is read as it is."""
    if low is None:
        return options
    return {**options, "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}


def render_schemas(text: str, names: dict[str, str]) -> str:
    """Replace schema qualifiers (``old.table`` to ``new.table``); an empty new name drops it."""
    for old, new in names.items():
        text = re.sub(rf"\b{re.escape(old)}\.", f"{new}." if new else "", text)
    return text


def run_sql(spark: SparkSession, text: str, params: dict[str, Any] | None = None,
            tables: dict[str, DataFrame] | None = None, schemas: dict[str, str] | None = None) -> DataFrame:
    """Spark SQL with named parameters over the given tables (temp views)."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(render_schemas(text, schemas or {}), args=params or {})


def run_sql_file(spark: SparkSession, path: str, **options) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).collect()
    return run_sql(spark, rows[0]["value"], **options)


def run_sql_with_cohort(spark: SparkSession, text: str, cohort: DataFrame, **options) -> DataFrame:
    """SQL that reads ``base_cohort``; the cohort is stored once, not derived per extract."""
    tables = {**options.pop("tables", {}), "base_cohort": staged(cohort, "base_cohort")}
    return run_sql(spark, text, tables=tables, **options)
