"""Row counts, missing rates, dead columns and cohort summaries."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorkit.checks import to_number
from anchorkit.operators.quantiles import exact_medians

LOGGER = logging.getLogger(__name__)

# Plausible cohort sizes.
FULL_COHORT_ROWS = (40_000, 70_000)
DEMO_COHORT_ROWS = (2_000, 5_000)
HIGH_MISSING = 0.50


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share) of every value including NULL."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", (F.col("n") / total).alias("share"))


def labelled_counts(df: DataFrame, column: str, groups: dict[str, list]) -> DataFrame:
    """(label, n) rows whose ``column`` is in each labelled list, zero counts included; one pass."""
    counts = df.agg(*[F.count_if(F.col(column).isin(members)).alias(f"_{i}")
                      for i, members in enumerate(groups.values())])
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"_{i}").alias("n"))
                      for i, label in enumerate(groups)])
    return counts.select(F.inline(pairs))


def missing_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, missing_rate, high_missing) for all columns from one pass; sort at the sink."""
    cols = columns or df.columns
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"_{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("missing_rate"))
                      for i, c in enumerate(cols)])
    return rates.select(F.inline(pairs)).withColumn("high_missing", F.col("missing_rate") > HIGH_MISSING)


def signal_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_valid, is_constant, is_empty) from one pass; no distinct count is needed."""
    num = {c: to_number(c) if c in df.columns else F.lit(None).cast("double") for c in columns}
    stats = df.agg(*[e for i, c in enumerate(columns) for e in (
        F.count(num[c]).alias(f"_n{i}"), F.min(num[c]).alias(f"_a{i}"), F.max(num[c]).alias(f"_b{i}"))])
    rows = F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"_n{i}").alias("n_valid"),
        F.coalesce(F.col(f"_a{i}") == F.col(f"_b{i}"), F.lit(False)).alias("is_constant"),
        (F.col(f"_n{i}") == 0).alias("is_empty")) for i, c in enumerate(columns)])
    return stats.select(F.inline(rows))


def check_signals(df: DataFrame, varying: list[str], present: list[str], strict: bool = True) -> list[str]:
    """Names of dead columns: absent, all NULL, or (for ``varying``) constant.

    Raises ``ValueError`` when ``strict``, otherwise warns.
    """
    dead = []
    for r in signal_profile(df, [*varying, *present]).collect():
        name = r["feature"]
        if name not in df.columns:
            dead.append(f"{name}: absent")
        elif r["is_empty"]:
            dead.append(f"{name}: all missing")
        elif r["is_constant"] and name in varying:
            dead.append(f"{name}: constant")
    if dead:
        text = "columns without signal: " + "; ".join(dead)
        if strict:
            raise ValueError(text)
        LOGGER.warning(text)
    return dead


def cohort_stats(df: DataFrame, group: str, numeric: list[str], flags: list[str]) -> DataFrame:
    """Long numeric summary, overall and per group: (variable, cohort, n, mean, sd, total, share).

    ``cohort`` is 'all' for the total row. The grouping id separates it from a NULL group.
    """
    cols = [*numeric, *flags]
    stats = df.groupingSets([[], [group]], group).agg(
        F.grouping_id().alias("_g"),
        *[e for i, c in enumerate(cols) for e in (
            F.count(to_number(c)).alias(f"_n{i}"), F.avg(to_number(c)).alias(f"_m{i}"),
            F.stddev_samp(to_number(c)).alias(f"_s{i}"), F.sum(to_number(c)).alias(f"_t{i}"))])
    rows = F.array(*[F.struct(
        F.lit(c).alias("variable"), F.col(f"_n{i}").alias("n"), F.col(f"_m{i}").alias("mean"),
        F.col(f"_s{i}").alias("sd"), F.col(f"_t{i}").alias("total")) for i, c in enumerate(cols)])
    cohort = F.when(F.col("_g") == 1, "all").otherwise(F.coalesce(F.col(group).cast("string"), F.lit("missing")))
    return stats.select(cohort.alias("cohort"), F.inline(rows))


def cohort_table(df: DataFrame, *, group: str = "los_class", numeric: tuple[str, ...] = ("age", "los_days"),
                 flags: tuple[str, ...] = ("gender_male",), labels: dict | None = None) -> DataFrame:
    """Printable table: one row per variable, one text column for the cohort and each class."""
    labels = labels or {"0": "Short-LOS", "1": "Medium-LOS", "2": "Long-LOS"}
    numeric_here = [c for c in numeric if c in df.columns]
    flags_here = [c for c in flags if c in df.columns]
    stats = cohort_stats(df, group, numeric_here, flags_here)
    text = F.when(
        F.col("variable").isin(flags_here),
        F.format_string("%d (%.1f%%)", F.col("total").cast("long"), F.col("mean") * 100),
    ).otherwise(F.format_string("%.2f +/- %.2f", F.col("mean"), F.col("sd")))
    pick = {"all": "Full cohort", **labels}
    return stats.withColumn("_text", text).groupBy("variable").agg(*[
        F.max(F.when(F.col("cohort") == key, F.col("_text"))).alias(name) for key, name in pick.items()])


def validate_features(df: DataFrame, days: str = "los_days", label: str = "los_class") -> DataFrame:
    """Log cohort size, length summary and class balance; return the missing-rate table."""
    n = df.count()
    if FULL_COHORT_ROWS[0] <= n <= FULL_COHORT_ROWS[1]:
        LOGGER.info("cohort of %s rows: size of the full data", n)
    elif DEMO_COHORT_ROWS[0] <= n <= DEMO_COHORT_ROWS[1]:
        LOGGER.info("cohort of %s rows: size of a demo extract", n)
    else:
        LOGGER.warning("cohort of %s rows is outside the expected sizes", n)
    if days in df.columns:
        mean = df.agg(F.avg(days)).first()[0]
        LOGGER.info("length: median %s, mean %s days", exact_medians(df, [days])[days], mean)
    if label in df.columns:
        LOGGER.info("class balance: %s", {r[label]: r["share"] for r in value_counts(df, label).collect()})
    rates = missing_rates(df)
    high = [r["feature"] for r in rates.where("high_missing").collect()]
    if high:
        LOGGER.warning("more than half missing: %s", high)
    return rates


def check_prepared(train: DataFrame, test: DataFrame, test_size: float, features: list[str]) -> float:
    """Share of test rows; raises when a feature is still missing or the share is off by over 0.05."""
    empty = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in features])
    both = train.select(empty.alias("bad"), F.lit(0).alias("t")).unionAll(test.select(empty.alias("bad"), F.lit(1).alias("t")))
    row = both.agg(F.count_if("bad").alias("bad"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if row["bad"]:
        raise ValueError("missing values remain after preparation")
    share = row["t"] / row["n"]
    if abs(share - test_size) > 0.05:
        raise ValueError(f"test share {share:.3f} is not {test_size}")
    return share
