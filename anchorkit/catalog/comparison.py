"""Metrics of predictions and the comparison of two feature sets.

Predictions are derived from order lines: the truth is a scaled quantity, both predictors are
arithmetic of the same line, so every line takes part and both engines see equal numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorkit.catalog.registry import Register, round_doubles
from anchorkit.operators import compare as cp
from anchorkit.operators import metrics as me
from anchorkit.plans.retail import table

REGISTER = Register()

PREDS = {
    "model": "l_returnflag", "y": "l_quantity / 5", "base": "l_extendedprice / 10000",
    "cand": "l_extendedprice / 9000 + l_discount", "y_true": "CAST(l_quantity AS INT) % 3",
    "y_base": "(CAST(l_quantity AS INT) + l_linenumber) % 3", "y_cand": "(CAST(l_quantity AS INT) * (l_linenumber % 4)) % 3",
    "p0": "l_discount", "p1": "l_tax + l_discount / 2", "p2": "l_quantity / 50", "severity": "l_suppkey % 25",
}
_P = "p AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PREDS.items()) + " FROM lineitem)"


def _preds(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in PREDS.items()])


def _f1(k: int) -> str:
    return f"coalesce(2.0::DOUBLE * sum((y_true = {k} AND y_base = {k})::INT) / nullif(sum((y_true = {k})::INT) + sum((y_base = {k})::INT), 0), 0)"


@REGISTER("class_metrics", f"""
WITH {_P}, f AS (SELECT model, avg((y_true = y_base)::INT) AS acc, {', '.join(f'{_f1(k)} AS f{k}' for k in range(3))},
  {' + '.join(f'avg((y_true = {k})::INT) * avg((y_base = {k})::INT)' for k in range(3))} AS chance FROM p GROUP BY model)
SELECT model, round(acc, 6) AS "Accuracy", round((f0 + f1 + f2) / 3, 6) AS "Macro-F1", round(f0, 6) AS "Short-F1", round(f1, 6) AS "Medium-F1",
  round(f2, 6) AS "Long-F1", round((acc - chance) / (1 - chance), 6) AS "Kappa" FROM f""")
def class_metrics(spark, sf):
    return round_doubles(me.classification_metrics(_preds(spark, sf), ["model"], "y_true", "y_base"))


@REGISTER("confusion_counts", f"""
WITH {_P} SELECT m.model, a.k AS y_true, b.k AS y_pred, count(p.model) AS n
FROM (SELECT DISTINCT model FROM p) m, (VALUES (0), (1), (2)) a(k), (VALUES (0), (1), (2)) b(k)
LEFT JOIN p ON p.model = m.model AND p.y_true = a.k AND p.y_cand = b.k GROUP BY ALL""")
def confusion_counts(spark, sf):
    return me.confusion_counts(_preds(spark, sf), ["model"], "y_true", "y_cand")


def _auc(k: int) -> str:
    return f"""SELECT model, {k} AS label, (sum(r) FILTER (WHERE pos = 1) - sum(pos)::DOUBLE * (sum(pos) + 1) / 2) / (sum(pos)::DOUBLE * (count(*) - sum(pos))) AS auc
FROM (SELECT model, (y_true = {k})::INT AS pos, rank() OVER (PARTITION BY model ORDER BY p{k}) + (count(*) OVER (PARTITION BY model, p{k}) - 1) / 2.0::DOUBLE AS r FROM p)
GROUP BY model"""


@REGISTER("class_auc", f"WITH {_P}, a AS ({' UNION ALL '.join(_auc(k) for k in range(3))}) SELECT model, label, round(auc, 6) AS auc FROM a")
def class_auc(spark, sf):
    return round_doubles(me.class_auc(_preds(spark, sf), ["model"], {k: f"p{k}" for k in range(3)}))


@REGISTER("macro_auc", f"WITH {_P}, a AS ({' UNION ALL '.join(_auc(k) for k in range(3))}) SELECT model, round(avg(auc), 6) AS \"AUC\" FROM a GROUP BY model")
def macro_auc(spark, sf):
    return round_doubles(me.macro_auc(_preds(spark, sf), ["model"], {k: f"p{k}" for k in range(3)}))


def _reg(pred: str, more: str = "") -> str:
    return f"""SELECT model{more}, round(avg(abs({pred} - y)), 6) AS "MAE", round(sqrt(avg(({pred} - y) ** 2)), 6) AS "RMSE",
  round(1 - avg(({pred} - y) ** 2) / var_pop(y), 6) AS "R2", round(avg(abs({pred} - y) / abs(y)) FILTER (WHERE y > 0.5) * 100, 6) AS "MAPE",
  round(median(abs({pred} - y)), 6) AS "MedianAE" FROM p GROUP BY model"""


@REGISTER("regression_metrics", f"WITH {_P} {_reg('base')}")
def regression_metrics(spark, sf):
    return round_doubles(me.regression_metrics(_preds(spark, sf), ["model"], "y", "base"))


@REGISTER("metrics_with_missing_group", f"WITH {_P.replace('l_returnflag AS model', 'CASE WHEN l_linenumber > 2 THEN l_returnflag END AS model')} {_reg('base')}")
def metrics_with_missing_group(spark, sf):
    """Lines without a model are a group."""
    preds = table(spark, sf, "lineitem").selectExpr(*[
        f"{'CASE WHEN l_linenumber > 2 THEN l_returnflag END' if n == 'model' else e} AS {n}" for n, e in PREDS.items()])
    return round_doubles(me.regression_metrics(preds, ["model"], "y", "base"))


@REGISTER("stacked_metrics", f"WITH {_P}, f AS (SELECT model, avg((y_true = y_base)::INT) AS acc FROM p GROUP BY model) "
          "SELECT model, round(acc, 6) AS \"Accuracy\", NULL::DOUBLE AS \"MAE\" FROM f UNION ALL "
          "SELECT model, NULL, round(avg(abs(base - y)), 6) FROM p GROUP BY model")
def stacked_metrics(spark, sf):
    """Metric tables with different columns in one table; absent ones are empty."""
    preds = _preds(spark, sf)
    classes = me.classification_metrics(preds, ["model"], "y_true", "y_base").select("model", "Accuracy")
    days = me.regression_metrics(preds, ["model"], "y", "base", median=False).select("model", "MAE")
    return round_doubles(classes.unionByName(days, allowMissingColumns=True))


REG = ["MAE", "RMSE", "R2", "MAPE", "MedianAE"]


def _runs(spark, sf):
    preds = _preds(spark, sf)
    one = lambda c: me.regression_metrics(preds, ["model"], "y", c).withColumn("stage", F.lit("stage2"))
    return one("base"), one("cand")


@REGISTER("delta_table", f"""
WITH {_P}, b AS ({_reg('base')}), c AS ({_reg('cand')}), j AS ({' UNION ALL '.join(
    f"SELECT b.model, 'stage2' AS stage, '{m}' AS metric, b.\"{m}\" AS baseline_value, c.\"{m}\" AS candidate_value FROM b JOIN c ON b.model = c.model" for m in REG)})
SELECT *, round(candidate_value - baseline_value, 4) AS delta, false AS significant,
  round((candidate_value - baseline_value) / abs(baseline_value) * 100, 2) AS delta_pct,
  CASE WHEN metric = 'R2' THEN candidate_value > baseline_value ELSE candidate_value < baseline_value END AS improved FROM j""")
def delta_table(spark, sf):
    base, cand = _runs(spark, sf)
    d = round_doubles(cp.delta_table(base, cand, REG))
    return d.withColumns({"delta": F.round(F.col("candidate_value") - F.col("baseline_value"), 4),
                          "delta_pct": F.round("delta_pct", 2)})


@REGISTER("best_common_model", f"""
WITH {_P}, b AS (SELECT model, avg(abs(base - y)) AS mae FROM p GROUP BY model)
SELECT model, round(mae, 6) AS "MAE" FROM b ORDER BY mae, model LIMIT 1""")
def best_common_model(spark, sf):
    base, cand = _runs(spark, sf)
    return round_doubles(cp.best_common_model(base, cand))


_PAIRED = f"""
WITH {_P}, d AS (SELECT model, abs(y - base) AS e0, abs(y - cand) AS e1, abs(y - base) - abs(y - cand) AS d FROM p),
m AS (SELECT model, count(*) AS n, avg(e0) AS mean_e0, avg(e1) AS mean_e1, avg(d) * sqrt(count(*)) / stddev_samp(d) AS t,
        avg(e1 * e1 - e0 * e0) * sqrt(count(*)) / stddev_samp(e1 * e1 - e0 * e0) AS dm, sum((d = 0)::INT)::BIGINT AS zeros FROM d GROUP BY model),
r AS (SELECT model, d, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2.0::DOUBLE AS r,
        count(*) OVER (PARTITION BY model, abs(d)) AS t FROM d WHERE d <> 0),
w AS (SELECT model, least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0)) AS w, count(*) AS nn, sum(t::DOUBLE * t - 1) AS tie FROM r GROUP BY model)"""


@REGISTER("paired_statistics", _PAIRED + """
SELECT m.model, n, round(mean_e0, 6) AS mean_e0, round(mean_e1, 6) AS mean_e1, zeros, round(t, 6) AS paired_t_stat, round(dm, 6) AS dm_stat,
  round(w, 6) AS wilcoxon_stat, nn AS n_nonzero, round(tie, 6) AS tie_term FROM m JOIN w ON m.model = w.model""")
def paired_statistics(spark, sf):
    errors = cp.paired_errors(_preds(spark, sf), "y", "base", "cand")
    return round_doubles(cp.paired_statistics(errors, ["model"]))


#: Simpson's rule over 4,000 steps: ``i`` and its weight.
_GRID = "grid AS (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 12000.0::DOUBLE AS s FROM generate_series(0, 4000) g(i))"


def _normal_p(source: str, z: str) -> str:
    """(model, p): two-sided normal tail, by integrating the density from 0 to |z|."""
    return (f"SELECT model, greatest(0, 1 - 2 * sum(s * exp(-0.5::DOUBLE * (least(abs(z), 12) * i / 4000) ** 2)) * least(abs(z), 12) / sqrt(2 * pi())) AS p "
            f"FROM (SELECT model, {z} AS z FROM {source}), grid GROUP BY model, z")


def _student_p(source: str, key: str, t: str, free: str) -> str:
    """(key, p): two-sided Student tail; with t = sqrt(v) tan(a) the density is a power of cos(a)."""
    return (f"SELECT {key}, greatest(0, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()) * a * sum(s * cos(a * i / 4000) ** (v - 1))) AS p "
            f"FROM (SELECT {key}, ({free})::DOUBLE AS v, atan(abs({t}) / sqrt({free})) AS a FROM {source}), grid GROUP BY {key}, v, a")


@REGISTER("paired_tests", _PAIRED + f""", {_GRID}, pt AS ({_student_p("m", "model", "t", "n - 1")}), pd AS ({_normal_p("m", "dm")}),
pw AS ({_normal_p("w", "(w - nn * (nn + 1) / 4.0::DOUBLE) / sqrt((nn::DOUBLE * (nn + 1) * (2 * nn + 1) - tie / 2) / 24)")})
SELECT m.model, n, round(mean_e0, 6) AS mean_e0, round(mean_e1, 6) AS mean_e1, round(t, 6) AS paired_t_stat, round(pt.p, 6) AS paired_t_p,
  round(w, 6) AS wilcoxon_stat, round(pw.p, 6) AS wilcoxon_p, round(dm, 6) AS dm_stat, round(pd.p, 6) AS dm_p_value,
  round(0.05::DOUBLE / 3, 6) AS corrected_alpha,
  CASE WHEN mean_e1 < mean_e0 AND pw.p < 0.05::DOUBLE / 3 THEN 'candidate_improved' ELSE 'not_significant' END AS conclusion
FROM m JOIN w ON m.model = w.model JOIN pt ON pt.model = m.model JOIN pd ON pd.model = m.model JOIN pw ON pw.model = m.model""")
def paired_tests(spark, sf):
    """With p-values and conclusion."""
    errors = cp.paired_errors(_preds(spark, sf), "y", "base", "cand")
    return round_doubles(cp.paired_tests(errors, ["model"], n_models=3))


@REGISTER("class_ablation", f"""
WITH {_P}, c AS (SELECT y_true, avg((y_base = y_true)::INT) AS r0, avg((y_cand = y_true)::INT) AS r1,
  sum((y_cand = y_true AND y_base <> y_true)::INT)::BIGINT AS wins, sum((y_base = y_true AND y_cand <> y_true)::INT)::BIGINT AS losses FROM p GROUP BY y_true)
SELECT CASE y_true WHEN 0 THEN 'Short' WHEN 1 THEN 'Medium' ELSE 'Long' END AS "class", round(2 * r0 / (1 + r0), 6) AS baseline_f1,
  round(2 * r1 / (1 + r1), 6) AS candidate_f1, round(2 * r1 / (1 + r1) - 2 * r0 / (1 + r0), 6) AS delta_f1, wins, losses FROM c""")
def class_ablation(spark, sf):
    return round_doubles(cp.class_ablation(_preds(spark, sf), "y_true", "y_base", "y_cand", p_values=False))


@REGISTER("class_sign_tests", f"""
WITH {_P}, r AS (SELECT y_true, avg((y_base = y_true)::INT) AS r0, avg((y_cand = y_true)::INT) AS r1,
  count(*) FILTER (y_cand = y_true AND y_base <> y_true) AS wins, count(*) FILTER (y_base = y_true AND y_cand <> y_true) AS losses FROM p GROUP BY y_true),
tails AS (SELECT y_true, least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2)))) AS p
          FROM (SELECT y_true, wins + losses AS n, unnest(range(0, least(wins, losses) + 1)) AS j FROM r) WHERE n > 0 GROUP BY y_true)
SELECT CASE r.y_true WHEN 0 THEN 'Short' WHEN 1 THEN 'Medium' ELSE 'Long' END AS "class", round(2 * r0 / (1 + r0), 6) AS baseline_f1,
  round(2 * r1 / (1 + r1), 6) AS candidate_f1, round(2 * r1 / (1 + r1) - 2 * r0 / (1 + r0), 6) AS delta_f1, wins, losses, round(p, 6) AS p_value
FROM r LEFT JOIN tails ON tails.y_true = r.y_true""")
def class_sign_tests(spark, sf):
    return round_doubles(cp.class_ablation(_preds(spark, sf), "y_true", "y_base", "y_cand"))


@REGISTER("stratified_error", f"""
WITH {_P}, q AS (SELECT quantile_cont(severity, 0.33) AS lo, quantile_cont(severity, 0.66) AS hi FROM p),
s AS (SELECT *, CASE WHEN severity < lo THEN 'Low' WHEN severity <= hi THEN 'Medium' ELSE 'High' END AS stratum FROM p, q)
SELECT stratum, round(avg(abs(y - base)), 6) AS baseline_mae, round(avg(abs(y - cand)), 6) AS candidate_mae,
  round(avg(abs(y - cand)) - avg(abs(y - base)), 6) AS delta_mae, count(*) AS n FROM s GROUP BY stratum""")
def stratified_error(spark, sf):
    return round_doubles(cp.stratified_error(_preds(spark, sf), "severity", "y", "base", "cand"))


FEATURES = ["l_extendedprice", "l_discount", "tax", "l_suppkey", "fixed"]


def _corr(c: str) -> str:
    return f"""SELECT '{c}' AS feature, round(corr(rx, ry), 6) AS spearman_r, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry
  FROM (SELECT {c}::DOUBLE AS x, y FROM l WHERE {c} IS NOT NULL AND y IS NOT NULL))"""


@REGISTER("spearman_table", "WITH l AS (SELECT l_extendedprice, l_discount, CASE WHEN l_tax > 0.02 THEN l_tax END AS tax, l_suppkey, l_quantity AS y FROM lineitem) "
          + " UNION ALL ".join(_corr(c) for c in FEATURES[:-1]))
def spearman_table(spark, sf):
    """A constant feature is left out."""
    lines = table(spark, sf, "lineitem").select(
        "l_extendedprice", "l_discount", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("tax"), "l_suppkey",
        F.lit(1.0).alias("fixed"), F.col("l_quantity").alias("y"))
    return round_doubles(cp.spearman(lines, FEATURES, "y"))


@REGISTER("spearman_ranked", "WITH l AS (SELECT l_extendedprice, l_discount, l_tax, l_suppkey, l_quantity AS y FROM lineitem), c AS ("
          + " UNION ALL ".join(_corr(c).replace("round(corr(rx, ry), 6)", "corr(rx, ry)") for c in ("l_extendedprice", "l_discount", "l_tax", "l_suppkey"))
          + f"), {_GRID}, pt AS ({_student_p('c', 'feature', 'spearman_r * sqrt((n - 2) / (1 - spearman_r * spearman_r))', 'n - 2')}) "
          "SELECT c.feature, round(spearman_r, 6) AS spearman_r, n, round(p, 6) AS p_value FROM c JOIN pt ON pt.feature = c.feature")
def spearman_ranked(spark, sf):
    """With p-values, strongest first."""
    lines = table(spark, sf, "lineitem").select("l_extendedprice", "l_discount", "l_tax", "l_suppkey", F.col("l_quantity").alias("y"))
    found = cp.spearman(lines, ["l_extendedprice", "l_discount", "l_tax", "l_suppkey"], "y", p_values=True)
    return round_doubles(found.orderBy(F.abs("spearman_r").desc(), "feature"))
