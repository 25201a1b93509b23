"""Counts, missing rates, signal checks, summaries and exact quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorkit.catalog.cohorts import stored_cohort
from anchorkit.catalog.registry import Register, clinical, round_doubles
from anchorkit.operators import cohort as co
from anchorkit.operators import quality as qu
from anchorkit.operators.quantiles import exact_quantiles
from anchorkit.plans.retail import table

REGISTER = Register()

NULLED = {"a": "nullif(l_linenumber, 3)", "b": "nullif(l_discount, 0.05)", "c": "CASE WHEN l_tax > 0.02 THEN l_tax END",
          "d": "l_returnflag", "e": "CASE WHEN l_quantity > 1000 THEN l_quantity END", "f": "CASE WHEN l_quantity > 0 THEN 1.0 END"}


def _nulled(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in NULLED.items()])


_NULLED_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in NULLED.items()) + " FROM lineitem"


@REGISTER("missing_rates", f"WITH t AS ({_NULLED_SQL}) " + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(avg(({n} IS NULL)::INT), 6) AS missing_rate, avg(({n} IS NULL)::INT) > 0.5 AS high_missing FROM t"
    for n in NULLED))
def missing_rates(spark, sf):
    return round_doubles(qu.missing_rates(_nulled(spark, sf)))


@REGISTER("validated_features", clinical("""
SELECT feature, round(rate, 6) AS missing_rate, rate > 0.5 AS high_missing FROM (
  UNPIVOT (SELECT avg((gender IS NULL)::INT)::DOUBLE AS gender, avg((age IS NULL)::INT)::DOUBLE AS age,
                  avg((los_days IS NULL)::INT)::DOUBLE AS los_days FROM cohort)
  ON gender, age, los_days INTO NAME feature VALUE rate)"""))
def validated_features(spark, sf):
    """Cohort size, lengths and class balance are logged; the rates of missing values come back."""
    cohort, _ = stored_cohort(spark, sf)
    return round_doubles(qu.validate_features(cohort.select("gender", "age", "los_days")))


@REGISTER("signal_profile", f"WITH t AS ({_NULLED_SQL}) " + " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, count(try_cast({n} AS DOUBLE)) AS n_valid, count(DISTINCT try_cast({n} AS DOUBLE)) = 1 AS is_constant,
        count(try_cast({n} AS DOUBLE)) = 0 AS is_empty FROM t""" for n in NULLED)
    + " UNION ALL SELECT 'absent', 0, false, true")
def signal_profile(spark, sf):
    return qu.signal_profile(_nulled(spark, sf), [*NULLED, "absent"])


@REGISTER("dead_signals", f"WITH t AS ({_NULLED_SQL}) " + " UNION ALL ".join(
    [f"SELECT '{c}: all missing' AS dead FROM t HAVING count({c}) = 0" for c in "abfe"]
    + [f"SELECT '{c}: constant' FROM t HAVING count(DISTINCT {c}) = 1" for c in "abf"] + ["SELECT 'absent: absent'"]))
def dead_signals(spark, sf):
    """Columns without any signal, by name and reason."""
    dead = qu.check_signals(_nulled(spark, sf), ["a", "b", "f"], ["e", "absent"], strict=False)
    return spark.createDataFrame([(d,) for d in dead], "dead string")


@REGISTER("class_balance", clinical("""
SELECT los_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM (SELECT CASE WHEN los_days <= 2 THEN 0 WHEN los_days > 7 THEN 2 ELSE 1 END AS los_class FROM cohort) GROUP BY los_class"""))
def class_balance(spark, sf):
    cohort, _ = stored_cohort(spark, sf)
    return round_doubles(qu.value_counts(co.add_outcomes(cohort), "los_class"))


GROUPS = {"low": [0, 1, 2, 3], "mid": [10, 11], "none": [-5], "high": [40, 41, 42]}


@REGISTER("item_counts", " UNION ALL ".join(
    f"SELECT '{g}' AS label, count(*) AS n FROM lineitem WHERE l_suppkey IN ({', '.join(map(str, m))})" for g, m in GROUPS.items()))
def item_counts(spark, sf):
    return qu.labelled_counts(table(spark, sf, "lineitem"), "l_suppkey", GROUPS)


_SUMMARY = """SELECT {key} AS cohort, '{v}' AS variable, count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS sd,
  round(sum({v}), 6)::DOUBLE AS total FROM t {group}"""
_PEOPLE = """
t AS (SELECT age, los_days, CASE WHEN upper(gender) = 'M' THEN 1 ELSE 0 END AS gender_male,
             CASE WHEN los_days <= 2 THEN 0 WHEN los_days > 7 THEN 2 ELSE 1 END AS los_class FROM cohort)"""


@REGISTER("cohort_summary", clinical(" UNION ALL ".join(
    _SUMMARY.format(key=k, v=v, group=g) for v in ("age", "los_days", "gender_male")
    for k, g in (("'all'", ""), ("los_class::VARCHAR", "GROUP BY los_class"))), _PEOPLE))
def cohort_summary(spark, sf):
    cohort, _ = stored_cohort(spark, sf)
    people = co.add_outcomes(cohort).drop("age").join(co.demographics(cohort), "stay_id")
    return round_doubles(qu.cohort_stats(people, "los_class", ["age", "los_days"], ["gender_male"]))


def _cell(v: str, where: str) -> str:
    if v == "gender_male":
        return f"format('{{:d}} ({{:.1f}}%)', sum({v}) FILTER ({where})::BIGINT, avg({v}) FILTER ({where}) * 100)"
    return f"format('{{:.2f}} +/- {{:.2f}}', avg({v}) FILTER ({where}), stddev_samp({v}) FILTER ({where}))"


@REGISTER("cohort_table", clinical(" UNION ALL ".join(
    f"SELECT '{v}' AS variable, " + ", ".join(
        f'{_cell(v, w)} AS "{name}"' for name, w in (("Full cohort", "WHERE true"), ("Short-LOS", "WHERE los_class = 0"),
                                                     ("Medium-LOS", "WHERE los_class = 1"), ("Long-LOS", "WHERE los_class = 2")))
    + " FROM t" for v in ("age", "los_days", "gender_male")), _PEOPLE))
def cohort_table(spark, sf):
    cohort, _ = stored_cohort(spark, sf)
    people = co.add_outcomes(cohort).drop("age").join(co.demographics(cohort), "stay_id")
    return qu.cohort_table(people)


PROBS = [0.0, 0.33, 0.5, 0.66, 0.999, 1.0]
MEASURES = ["l_extendedprice", "l_quantity", "l_discount"]


@REGISTER("quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p}::DOUBLE AS prob, round(quantile_cont({c}, {p}), 6) AS value, count({c}) AS n FROM lineitem"
    for c in MEASURES for p in PROBS))
def quantiles(spark, sf):
    return round_doubles(exact_quantiles(table(spark, sf, "lineitem"), MEASURES, PROBS))


@REGISTER("grouped_medians", """
SELECT l_returnflag, 'l_extendedprice' AS feature, 0.5::DOUBLE AS prob, round(quantile_cont(l_extendedprice, 0.5), 6) AS value,
       count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def grouped_medians(spark, sf):
    return round_doubles(exact_quantiles(table(spark, sf, "lineitem"), ["l_extendedprice"], [0.5], ["l_returnflag"]))


@REGISTER("medians_per_customer", """
SELECT o_custkey, 'o_totalprice' AS feature, 0.5::DOUBLE AS prob, round(quantile_cont(o_totalprice, 0.5), 6) AS value, count(*) AS n
FROM orders GROUP BY o_custkey""")
def medians_per_customer(spark, sf):
    """As many groups as customers with orders."""
    return round_doubles(exact_quantiles(table(spark, sf, "orders"), ["o_totalprice"], [0.5], ["o_custkey"]))
