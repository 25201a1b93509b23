"""Classification and regression metrics of prediction tables, one row per group (model, say)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorkit.operators.joins import same_join
from anchorkit.operators.quantiles import exact_quantiles
from anchorkit.operators.running import value_ranks

# Class labels and their metric names.
CLASS_NAMES = {0: "Short", 1: "Medium", 2: "Long"}


def confusion_counts(preds: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred",
                     labels: list[int] | None = None) -> DataFrame:
    """(by, y_true, y_pred, n) for the complete label grid, zero cells included."""
    labels = labels or list(CLASS_NAMES)
    cells = [(a, b) for a in labels for b in labels]
    wide = preds.groupBy(*by).agg(*[
        F.count_if((F.col(y) == a) & (F.col(p) == b)).alias(f"_{a}_{b}") for a, b in cells])
    rows = F.array(*[F.struct(F.lit(a).alias("y_true"), F.lit(b).alias("y_pred"), F.col(f"_{a}_{b}").alias("n"))
                     for a, b in cells])
    return wide.select(*by, F.inline(rows))


def _add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def classification_metrics(preds: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred",
                           labels: dict[int, str] | None = None) -> DataFrame:
    """Accuracy, Macro-F1, F1 per class and Cohen's kappa per group.

    Per-class counts are conditional sums of one aggregation; F1 without any support is 0.
    Macro-F1 averages the classes that occur as truth or prediction.
    """
    labels = labels or CLASS_NAMES
    counts = preds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(y) == F.col(p)).alias("_hit"),
        *[e for k in labels for e in (
            F.count_if(F.col(y) == k).alias(f"_t{k}"), F.count_if(F.col(p) == k).alias(f"_p{k}"),
            F.count_if((F.col(y) == k) & (F.col(p) == k)).alias(f"_b{k}"))])
    f1 = {k: F.coalesce(F.try_divide(2.0 * F.col(f"_b{k}"), F.col(f"_t{k}") + F.col(f"_p{k}")), F.lit(0.0)) for k in labels}
    seen = _add([((F.col(f"_t{k}") + F.col(f"_p{k}")) > 0).cast("int") for k in labels])
    observed = F.col("_hit") / F.col("_n")
    chance = _add([(F.col(f"_t{k}") / F.col("_n")) * (F.col(f"_p{k}") / F.col("_n")) for k in labels])
    return counts.select(
        *by, observed.alias("Accuracy"), F.try_divide(_add(list(f1.values())), seen).alias("Macro-F1"),
        *[f1[k].alias(f"{name}-F1") for k, name in labels.items()],
        F.when(chance < 1, (observed - chance) / (1 - chance)).alias("Kappa"),
    )


def class_auc(preds: DataFrame, by: list[str], scores: dict[int, str], y: str = "y_true") -> DataFrame:
    """(by, label, auc) one-vs-rest by the rank formula; NULL when a side is empty.

    Ties share their average rank. Equal scores are counted before the shuffle and ranks come
    from bucketed running totals, so no task sorts a whole model's predictions.
    """
    items = F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).cast("double").alias("score"),
                               (F.col(y) == k).cast("long").alias("pos")) for k, c in scores.items()])
    long = preds.select(*by, F.explode(items).alias("_i")).select(*by, "_i.*").where(F.col("pos").isNotNull())
    ranks = value_ranks(long, [*by, "label"], "score", [F.sum("pos").alias("_pos")])
    sums = ranks.groupBy(*by, "label").agg(
        F.sum(F.col("avg_rank") * F.col("_pos")).alias("_r"), F.sum("_pos").alias("_p"), F.sum("n").alias("_n"))
    p, q = F.col("_p").cast("double"), (F.col("_n") - F.col("_p")).cast("double")
    return sums.select(*by, "label", F.try_divide(F.col("_r") - p * (p + 1) / 2, p * q).alias("auc"))


def macro_auc(preds: DataFrame, by: list[str], scores: dict[int, str], y: str = "y_true") -> DataFrame:
    """(by, AUC): mean one-vs-rest AUC; NULL unless every class has one."""
    per_class = class_auc(preds, by, scores, y)
    return per_class.groupBy(*by).agg(F.when(F.count("auc") == len(scores), F.avg("auc")).alias("AUC"))


def regression_metrics(preds: DataFrame, by: list[str], y: str = "y_true", p: str = "y_pred",
                       median: bool = True) -> DataFrame:
    """MAE, RMSE, R2, MAPE (truth above 0.5 only) and exact MedianAE per group.

    R2 of a constant truth is 1 for a perfect fit, else 0. Errors that are not a number have no median.
    """
    err = F.col(p) - F.col(y)
    sums = preds.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("MAE"), F.sqrt(F.avg(err * err)).alias("RMSE"),
        F.avg(err * err).alias("_mse"), F.var_pop(y).alias("_var"),
        (F.avg(F.when(F.col(y) > 0.5, F.abs(err) / F.abs(F.col(y)))) * 100.0).alias("MAPE"))
    out = sums.select(*by, "MAE", "RMSE", F.when(F.col("_var") == 0, (F.col("_mse") == 0).cast("double")).otherwise(
        1 - F.col("_mse") / F.col("_var")).alias("R2"), "MAPE")
    if not median:
        return out
    errors = preds.select(*by, F.abs(err).alias("_abs"))
    medians = exact_quantiles(errors, ["_abs"], [0.5], by).select(*by, F.col("value").alias("MedianAE"))
    if not by:
        return out.select("*", medians.select("MedianAE").scalar().alias("MedianAE"))
    return same_join(out, medians, by, "left")
