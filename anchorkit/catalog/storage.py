"""Sources and sinks: what is written comes back equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorkit.catalog.cohorts import stored_cohort
from anchorkit.catalog.registry import Register, clinical, r6, round_doubles
from anchorkit.functions import values as V
from anchorkit.operators import prep as pr
from anchorkit.plans.retail import clinical_views, table
from anchorkit.session import scratch_path
from anchorkit.sources import ingest, sinks, tables

REGISTER = Register()
ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_note": "string"}


@REGISTER("csv_gz_round_trip", """
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice AS price, l_returnflag, epoch_us(l_shipdate) AS ship_us FROM lineitem""")
def csv_gz_round_trip(spark, sf):
    path = scratch_path(spark, "lines")
    sinks.save_csv(table(spark, sf, "lineitem"), path, "gzip")
    back = tables.read_csv(spark, path, {"l_orderkey": "bigint", "l_partkey": "bigint", "l_linenumber": "int",
                                         "l_extendedprice": "double", "l_shipdate": "timestamp_ntz"})
    return back.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").alias("price"), "l_returnflag",
                       V.micros("l_shipdate").alias("ship_us"))


@REGISTER("named_tables", """
SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus""")
def named_tables(spark, sf):
    """Parquet by default, one table overridden to CSV that exists only as ``.gz``; columns are chosen at the scan."""
    folder = scratch_path(spark, "raw")
    sinks.save_csv(table(spark, sf, "orders"), f"{folder}/orders.csv.gz", "gzip")
    config = {"data": {"source": "parquet", "table_sources": {"orders": "csv"}, "parquet": {"base_path": sf},
                       "csv": {"base_path": folder, "files": {"orders": "orders.csv"}}}}
    orders = tables.load_table(spark, config, "orders", ["o_orderkey", "o_orderstatus"])
    lines = tables.load_table(spark, config, "lineitem", ["l_orderkey", "l_quantity"])
    joined = lines.join(orders.withColumn("l_orderkey", F.col("o_orderkey").cast("long")), "l_orderkey")
    return round_doubles(joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))


@REGISTER("header_driven_load", """
SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, epoch_us(o_orderdate) AS order_us, NULL::VARCHAR AS o_note, o_orderstatus FROM orders""")
def header_driven_load(spark, sf):
    """Columns by header name: an absent one is NULL, an unlisted one is kept as text."""
    source, target = scratch_path(spark, "orders_csv"), scratch_path(spark, "orders")
    sinks.save_csv(table(spark, sf, "orders").select("o_orderstatus", "o_totalprice", "o_orderdate", "o_custkey", "o_orderkey"), source)
    loaded = ingest.load_by_header(spark, source, target, ORDER_TYPES)
    return loaded.select("o_orderkey", "o_custkey", r6("o_totalprice"), V.micros("o_orderdate").alias("order_us"), "o_note", "o_orderstatus")


@REGISTER("item_append", """
SELECT event_type, event_id, CASE WHEN event_type IN ('error', 'view') THEN value * 2 ELSE value END AS value
FROM events WHERE event_type <> 'click'""")
def item_append(spark, sf):
    """Listed items are replaced (a repeated call changes nothing), the others stay."""
    target = scratch_path(spark, "events_by_type")
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    sinks.save_parquet(events, target, ["event_type"])
    fresh = events.where(F.col("event_type") != "click").withColumn("value", F.col("value") * 2)
    for _ in range(2):
        out = ingest.append_items(fresh, target, ["error", "view", "click"], "event_type")
    return out.select("event_type", "event_id", "value")


@REGISTER("cohort_statement", clinical("""
SELECT c.first_careunit, count(*) AS n, round(avg(c.los_days), 6) AS mean_days FROM cohort c
JOIN admissions a ON a.hadm_id = c.hadm_id WHERE c.age >= 30 GROUP BY c.first_careunit"""))
def cohort_statement(spark, sf):
    """Parameterised SQL over the stored cohort, schema names rendered away."""
    views = clinical_views(spark, sf)
    from anchorkit.operators.cohort import select_cohort

    text = """SELECT c.first_careunit, count(*) AS n, avg(c.los_days) AS mean_days FROM base_cohort c
              JOIN hospital.admissions a ON a.hadm_id = c.hadm_id WHERE c.age >= :least GROUP BY c.first_careunit"""
    out = tables.run_sql_with_cohort(
        spark, text, select_cohort(views["icustays"], views["patients"]), tables={"admissions": views["admissions"]},
        params={"least": 30}, schemas={"hospital": ""})
    return round_doubles(out)


@REGISTER("cached_table", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def cached_table(spark, sf):
    """Built once; the second call reads the finished table."""
    path = scratch_path(spark, "cached")
    sinks.cached(spark, path, lambda: table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")))
    return sinks.cached(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("must not build twice")))


@REGISTER("cached_by_settings", """
SELECT 2 AS builds, l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 30 GROUP BY l_returnflag""")
def cached_by_settings(spark, sf):
    """The same settings and files read the stored table, another setting builds it again."""
    path, lines, built = scratch_path(spark, "cached"), table(spark, sf, "lineitem"), []

    def counts(least):
        def build():
            built.append(least)
            return lines.where(F.col("l_quantity") >= least).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
        return sinks.cached(spark, path, build, {"least": least}, [lines])

    for least in (10, 10, 30):
        counts(least)
    return counts(30).select(F.lit(len(built)).alias("builds"), "l_returnflag", "n")


@REGISTER("prediction_pairs", """
SELECT 'line_mean' AS model, l_orderkey AS stay_id, round(sum(l_quantity), 6) AS y_true, round(avg(l_extendedprice), 6) AS baseline,
  round(max(l_extendedprice), 6) AS candidate FROM lineitem GROUP BY l_orderkey""")
def prediction_pairs(spark, sf):
    """Both runs of a model side by side, joined by key instead of row position."""
    path = scratch_path(spark, "predictions")
    by_order = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("stay_id")).agg(
        F.sum("l_quantity").alias("y_true"), F.avg("l_extendedprice").alias("b"), F.max("l_extendedprice").alias("c"))
    for run, col in (("baseline", "b"), ("extended", "c"), ("extended", "c")):
        sinks.save_predictions(by_order.select("stay_id", "y_true", F.col(col).alias("y_pred")), path, run, "line_mean", "stage2")
    return round_doubles(sinks.prediction_pair(spark.read.parquet(path)))


@REGISTER("stored_split", """
SELECT split, count(*) AS n FROM (
  SELECT CASE WHEN rank <= floor(n * 0.2::DOUBLE + 0.5) THEN 'test'
    WHEN rank <= floor(n * 0.2::DOUBLE + 0.5) + floor((n - floor(n * 0.2::DOUBLE + 0.5)) * 0.1::DOUBLE + 0.5) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rank,
               count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)) GROUP BY split""")
def stored_split(spark, sf):
    path = scratch_path(spark, "split")
    orders = table(spark, sf, "orders")
    sinks.save_splits(pr.stratified_split(orders, key="o_orderkey", label="o_orderstatus"), path, "o_orderkey")
    return sinks.load_splits(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@REGISTER("saved_extracts", clinical("""
SELECT 'cohort' AS extract, count(*) AS n FROM cohort """ + " ".join(
    f"UNION ALL SELECT '{t}', count(*) FROM {t}" for t in ("patients", "admissions", "chartevents", "labevents", "inputevents"))))
def saved_extracts(spark, sf):
    cohort, views = stored_cohort(spark, sf)
    names = ["patients", "admissions", "chartevents", "labevents", "inputevents"]
    stored = sinks.save_extracts({"cohort": cohort, **{t: views[t] for t in names}}, scratch_path(spark, "extracts"))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("extract"), "n") for name, df in stored.items()]
    return reduce(DataFrame.unionByName, parts)
