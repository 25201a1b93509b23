"""Comparison of two feature sets: deltas, paired tests, strata, class ablation, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorkit.functions import tails
from anchorkit.functions.values import percent_change
from anchorkit.operators.joins import same_join
from anchorkit.operators.metrics import CLASS_NAMES
from anchorkit.operators.ranges import tie_ranks
from anchorkit.operators.quantiles import exact_quantiles
from anchorkit.operators.running import value_ranks

# Metrics for which lower is better.
LOWER_IS_BETTER = ["MAE", "RMSE", "MAPE", "MedianAE"]


def delta_table(baseline: DataFrame, candidate: DataFrame, metrics: list[str],
                keys: tuple[str, ...] = ("model", "stage")) -> DataFrame:
    """Long table of metric differences for models present in both runs; missing pairs are left out."""
    joined = baseline.select(*keys, *[F.col(m).alias(f"_b_{m}") for m in metrics]).join(
        candidate.select(*keys, *[F.col(m).alias(f"_c_{m}") for m in metrics]), list(keys))
    rows = F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(f"_b_{m}").cast("double").alias("baseline_value"),
        F.col(f"_c_{m}").cast("double").alias("candidate_value")) for m in metrics])
    long = joined.select(*keys, F.inline(rows)).where(
        F.col("baseline_value").isNotNull() & F.col("candidate_value").isNotNull())
    delta = F.col("candidate_value") - F.col("baseline_value")
    better = F.when(F.col("metric").isin(LOWER_IS_BETTER), delta < 0).otherwise(delta > 0)
    return long.select(
        "*", delta.alias("delta"), percent_change(F.col("baseline_value"), delta).alias("delta_pct"),
        F.lit(False).alias("significant"), better.alias("improved"))


def best_common_model(baseline: DataFrame, candidate: DataFrame, metric: str = "MAE") -> DataFrame:
    """One row: the model of both runs with the lowest baseline metric, ties by name."""
    common = baseline.join(candidate.select("model"), "model", "left_semi")
    return common.select("model", metric).orderBy(F.col(metric).asc_nulls_last(), "model").limit(1)


def paired_errors(preds: DataFrame, y: str, baseline: str, candidate: str) -> DataFrame:
    """Rows with absolute errors ``e0`` and ``e1``; the two predictions sit on one row per key."""
    return preds.select(
        "*", F.abs(F.col(y) - F.col(baseline)).alias("e0"), F.abs(F.col(y) - F.col(candidate)).alias("e1"))


def paired_statistics(errors: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of the paired t, Diebold-Mariano and Wilcoxon tests per group.

    The t test and the squared-error test need one aggregation. For the signed ranks equal
    |differences| are counted first and ranked through bucketed running totals.
    """
    d = F.col("e0") - F.col("e1")
    sq = F.col("e1") * F.col("e1") - F.col("e0") * F.col("e0")
    moments = errors.groupBy(*by).agg(
        F.count(d).alias("n"), F.avg("e0").alias("mean_e0"), F.avg("e1").alias("mean_e1"),
        F.avg(d).alias("_md"), F.stddev_samp(d).alias("_sd"),
        F.avg(sq).alias("_mq"), F.stddev_samp(sq).alias("_sq"),
        F.count_if(d == 0).alias("zeros"))
    base = moments.select(
        *by, "n", "mean_e0", "mean_e1", "zeros",
        F.try_divide(F.col("_md") * F.sqrt(F.col("n")), F.col("_sd")).alias("paired_t_stat"),
        F.try_divide(F.col("_mq") * F.sqrt(F.col("n")), F.col("_sq")).alias("dm_stat"))
    moved = errors.select(*by, d.alias("_d")).where(F.col("_d").isNotNull() & (F.col("_d") != 0)).select(
        *by, F.abs("_d").alias("_a"), (F.col("_d") > 0).cast("long").alias("_up"))
    ranks = value_ranks(moved, by, "_a", [F.sum("_up").alias("_pos")])
    t = F.col("n").cast("double")
    sums = ranks.groupBy(*by).agg(
        F.sum(F.col("avg_rank") * F.col("_pos")).alias("_wp"),
        F.sum(F.col("avg_rank") * (F.col("n") - F.col("_pos"))).alias("_wm"),
        F.sum("n").alias("n_nonzero"), F.sum(t * t * t - t).alias("tie_term"))
    signed = sums.select(*by, F.least("_wp", "_wm").alias("wilcoxon_stat"), "n_nonzero", "tie_term")
    if by:
        return same_join(base, signed, by, "left")
    extra = ["wilcoxon_stat", "n_nonzero", "tie_term"]
    one = signed.select(F.struct(*extra).alias("s")).scalar()
    return base.select("*", one.alias("_s")).select(*base.columns, *[F.col(f"_s.{c}").alias(c) for c in extra])


def paired_tests(errors: DataFrame, by: list[str], n_models: int = 1, alpha: float = 0.05, method: str = "normal") -> DataFrame:
    """Test statistics with two-sided p-values, the corrected level and the conclusion.

    The candidate improves when its mean error is lower and the Wilcoxon p is below
    alpha / max(n_models, 1). ``method`` of the Wilcoxon p is ``normal`` (approximation with the tie
    term, at every size) or ``exact`` (null distribution of the rank sums, for untied differences).
    """
    if method not in ("normal", "exact"):
        raise ValueError("method must be 'normal' or 'exact'")
    rank_p = tails.signed_rank_p if method == "normal" else tails.signed_rank_exact_p
    corrected = alpha / max(int(n_models), 1)
    s = paired_statistics(errors, by)
    tested = s.select(
        *by, "n", "mean_e0", "mean_e1", "paired_t_stat",
        tails.student_p("paired_t_stat", (F.col("n") - 1).cast("double")).alias("paired_t_p"),
        "wilcoxon_stat",
        rank_p("wilcoxon_stat", "n_nonzero", "tie_term", "zeros").alias("wilcoxon_p"),
        "dm_stat", tails.normal_p("dm_stat").alias("dm_p_value"), F.lit(corrected).alias("corrected_alpha"))
    improved = (F.col("mean_e1") < F.col("mean_e0")) & (F.coalesce("wilcoxon_p", F.lit(1.0)) < corrected)
    return tested.withColumn(
        "conclusion", F.when(improved, "candidate_improved").otherwise("not_significant"))


def sign_counts(preds: DataFrame, by: list[str], y: str, baseline: str, candidate: str) -> DataFrame:
    """(by, wins, losses): rows only the candidate, or only the baseline, gets right."""
    ok0, ok1 = F.col(baseline) == F.col(y), F.col(candidate) == F.col(y)
    return preds.groupBy(*by).agg(F.count_if(ok1 & ~ok0).alias("wins"), F.count_if(ok0 & ~ok1).alias("losses"))


def class_ablation(preds: DataFrame, y: str, baseline: str, candidate: str, p_values: bool = True) -> DataFrame:
    """Per true class: F1 of both runs on the rows of that class, difference, sign-test p.

    Inside one class precision is 1, so F1 is 2r / (1 + r) of the recall r.
    """
    known = preds.where(F.col(y).isin(list(CLASS_NAMES)))
    counts = sign_counts(known, [y], y, baseline, candidate)
    recall = known.groupBy(y).agg(
        F.avg((F.col(baseline) == F.col(y)).cast("int")).alias("_r0"),
        F.avg((F.col(candidate) == F.col(y)).cast("int")).alias("_r1"))
    label = F.col(y)
    name = F.when(label == 0, CLASS_NAMES[0]).when(label == 1, CLASS_NAMES[1]).otherwise(CLASS_NAMES[2])
    f1 = lambda r: 2 * F.col(r) / (1 + F.col(r))
    out = recall.join(counts, y).select(
        name.alias("class"), f1("_r0").alias("baseline_f1"), f1("_r1").alias("candidate_f1"),
        (f1("_r1") - f1("_r0")).alias("delta_f1"), "wins", "losses")
    if not p_values:
        return out
    return out.withColumn("p_value", tails.sign_p("wins", "losses"))


def stratified_error(preds: DataFrame, stratum: str, y: str, baseline: str, candidate: str,
                     probs: tuple[float, float] = (0.33, 0.66)) -> DataFrame:
    """MAE of both runs below, between (closed) and above two exact quantiles; empty strata are absent."""
    cuts = {r["prob"]: r["value"] for r in exact_quantiles(preds, [stratum], list(probs)).collect()}
    low, high = F.lit(cuts.get(probs[0])).cast("double"), F.lit(cuts.get(probs[1])).cast("double")
    x = F.col(stratum)
    name = F.when(x < low, "Low").when(x.between(low, high), "Medium").when(x > high, "High")
    return (
        paired_errors(preds.withColumn("stratum", name).where(F.col("stratum").isNotNull()), y, baseline, candidate)
        .groupBy("stratum")
        .agg(F.avg("e0").alias("baseline_mae"), F.avg("e1").alias("candidate_mae"), F.count(F.lit(1)).alias("n"))
        .withColumn("delta_mae", F.col("candidate_mae") - F.col("baseline_mae"))
    )


def spearman(df: DataFrame, features: list[str], target: str, p_values: bool = False) -> DataFrame:
    """(feature, spearman_r, n[, p_value]) of each numeric column against ``target``.

    Pairwise complete; features with fewer than 3 pairs or a single value are left out. Equal
    pairs are counted first, then sorted by each side in turn, where ranks are running totals over
    ranges of rows: neither a frequent value nor a long feature lands in one task.
    """
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])
    long = df.select(F.col(target).cast("double").alias("y"), F.explode(items).alias("_i")).select("_i.*", "y")
    known = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    pairs = known.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    with_x = tie_ranks(pairs, ["feature"], "x", ["y"], "w", "rx")
    ranked = tie_ranks(with_x, ["feature"], "y", ["x"], "w", "ry")
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    sums = ranked.groupBy("feature").agg(
        F.sum(w).alias("n"), F.sum(w * rx * rx).alias("_xx"), F.sum(w * ry * ry).alias("_yy"),
        F.sum(w * rx * ry).alias("_xy"))
    # The mean of average ranks is (n + 1) / 2, whatever the ties.
    n = F.col("n").cast("double")
    square = n * ((n + 1) / 2) * ((n + 1) / 2)
    out = sums.where((F.col("n") >= 3) & (F.col("_xx") - square > 1e-9 * square)).select(
        "feature",
        F.try_divide(F.col("_xy") - square, F.sqrt((F.col("_xx") - square) * (F.col("_yy") - square))).alias("spearman_r"),
        "n")
    if not p_values:
        return out
    r, free = F.col("spearman_r"), (F.col("n") - 2).cast("double")
    t = F.when(F.abs(r) < 1, r * F.sqrt(free / (1 - r * r)))
    return out.withColumn("p_value", F.when(F.abs(r) >= 1, 0.0).otherwise(tails.student_p(t, free)))
