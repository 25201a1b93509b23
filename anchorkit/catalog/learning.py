"""Model fits on order features. Iterative fits have no SQL counterpart; closed forms do."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorkit.catalog.registry import Register, round_doubles
from anchorkit.operators import metrics as me
from anchorkit.operators import models as mo
from anchorkit.operators import prep as pr
from anchorkit.plans.retail import table
from anchorkit.session import scratch_path, staged

REGISTER = Register()
FEATURES = ["n_lines", "quantity", "price", "discount", "tax", "urgent"]


def order_features(spark, sf):
    """(o_orderkey, los_class, los_log, features): one row per order with lines, staged once."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    orders = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
        (F.col("o_totalprice") / 50_000).alias("days"))
    joined = orders.join(lines, "o_orderkey").select(
        "o_orderkey", *FEATURES, F.when(F.col("days") <= 2, 0).when(F.col("days") > 7, 2).otherwise(1).alias("los_class"),
        F.log1p("days").alias("los_log"))
    return staged(joined, "order_features")


def _matrices(spark, sf, target):
    """Scaled (key, label, features) frames of train and test."""
    data = order_features(spark, sf)
    splits = staged(pr.stratified_split(data, key="o_orderkey"), "splits")
    frames = pr.prepare_splits(data.drop("los_log" if target == "classification" else "los_class"), splits,
                               pr.Preparation(continuous=FEATURES[:-1]), key="o_orderkey", target=target)
    y = "los_class" if target == "classification" else "los_log"
    return {s: staged(mo.assembled(f.withColumn("label", F.col(y).cast("double")), FEATURES, ["o_orderkey", "label"]), s)
            for s, f in frames.items()}


@REGISTER("linear_fit", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem""")
def linear_fit(spark, sf):
    data = mo.assembled(table(spark, sf, "lineitem").withColumn("label", F.col("l_extendedprice")), ["l_quantity"], ["l_orderkey", "label"])
    model, _ = mo.fit_best("linear_regression", "stage2", data, key="l_orderkey")
    return spark.createDataFrame([(round(float(model.coefficients[0]), 4), round(float(model.intercept), 2))], "slope double, intercept double")


@REGISTER("reloaded_model", """
SELECT l_orderkey, l_linenumber, round(i + s * l_quantity, 2) AS prediction FROM lineitem,
  (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)""")
def reloaded_model(spark, sf):
    """A stored model predicts as it did before."""
    from pyspark.ml.regression import LinearRegressionModel

    data = mo.assembled(table(spark, sf, "lineitem").withColumn("label", F.col("l_extendedprice")), ["l_quantity"],
                        ["l_orderkey", "l_linenumber", "label"])
    model, _ = mo.fit_best("linear_regression", "stage2", data, key="l_orderkey")
    path = scratch_path(spark, "model")
    mo.save_model(model, path)
    back = LinearRegressionModel.load(path).transform(data)
    return back.select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


@REGISTER("ridge_fits", " UNION ALL ".join(f"""
SELECT {a}::DOUBLE AS alpha, round(covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + {a}), 4) AS slope,
  round(avg(l_extendedprice) - avg(l_quantity) * covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + {a}), 2) AS intercept
FROM lineitem""" for a in (0.1, 100.0, 1000000.0)))
def ridge_fits(spark, sf):
    data = staged(mo.assembled(table(spark, sf, "lineitem").withColumn("label", F.col("l_extendedprice")), ["l_quantity"],
                               ["l_orderkey", "label"]), "lines")
    rows, shape = [], mo.data_shape(data)
    for alpha in (0.1, 100.0, 1000000.0):
        model, _ = mo.fit_best("ridge", "stage2", data, key="l_orderkey", grid={"alpha": [alpha]}, shape=shape)
        rows.append((alpha, round(float(model.coefficients[0]), 4), round(float(model.intercept), 2)))
    return spark.createDataFrame(rows, "alpha double, slope double, intercept double")


def _training(parts):
    """Train and validation rows together, as the workflow trains."""
    return staged(parts["train"].unionByName(parts["val"]), "training")


#: The first point of each default grid.
POINTS = {stage: {name: {k: [v[0]] for k, v in grid.items()} for name, grid in grids.items()}
          for stage, grids in (("stage1", mo.STAGE1_GRIDS), ("stage2", mo.STAGE2_GRIDS))}


def _side_by_side(names: Iterable[str], one: Callable[[str], DataFrame], most: int = 2) -> DataFrame:
    """Rows of ``one`` for all names, ``most`` at a time: a fit is many short jobs in a row, two fill each other's gaps.

    More would only share the executors' memory between more cached training rows.
    """
    with ThreadPoolExecutor(most) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, names))


@REGISTER("classifier_scores")
def classifier_scores(spark, sf):
    """Balanced classifiers on the train and validation splits, scored on the test split."""
    parts = _matrices(spark, sf, "classification")
    train = staged(mo.weighted(_training(parts)), "weighted")
    shape = mo.data_shape(train)

    def one(name):
        model, point = mo.fit_best(name, "stage1", train, key="o_orderkey", grid=POINTS["stage1"][name], weight="weight", shape=shape)
        model = mo.with_probabilities(name, model, train, point, key="o_orderkey", weight="weight")
        return mo.class_predictions(model, parts["test"], key="o_orderkey").withColumn("model", F.lit(name))

    preds = staged(_side_by_side(reversed(mo.STAGE1_GRIDS), one), "predictions")  # the long ones first
    scores = me.classification_metrics(preds, ["model"])
    return round_doubles(scores.join(me.macro_auc(preds, ["model"], {k: f"p{k}" for k in range(3)}), "model", "left"))


@REGISTER("regressor_scores")
def regressor_scores(spark, sf):
    """Regressors of the log target, scored in days on the test split."""
    parts = _matrices(spark, sf, "regression")
    train = _training(parts)
    shape = mo.data_shape(train)

    def one(name):
        model, _ = mo.fit_best(name, "stage2", train, key="o_orderkey", grid=POINTS["stage2"][name], shape=shape)
        return mo.day_predictions(model, parts["test"], key="o_orderkey").withColumn("model", F.lit(name))

    preds = staged(_side_by_side(reversed(mo.STAGE2_GRIDS), one), "predictions")  # the long ones first
    return round_doubles(me.regression_metrics(preds, ["model"], "y_true_days", "y_pred_days"))


@REGISTER("grid_search")
def grid_search(spark, sf):
    """Macro-F1 grid over stratified folds; the chosen setting."""
    train = staged(mo.weighted(_training(_matrices(spark, sf, "classification"))), "weighted")
    folds = mo.stage_folds(train, "stage1", key="o_orderkey")
    _, best = mo.fit_best("logistic_regression", "stage1", train, key="o_orderkey", grid=mo.STAGE1_GRIDS["logistic_regression"],
                          folds=folds, weight="weight")
    return spark.createDataFrame([("logistic_regression", float(best["C"]))], "model string, c double")


@REGISTER("fold_scores")
def fold_scores(spark, sf):
    train = _training(_matrices(spark, sf, "regression"))
    folds = mo.stage_folds(train, "stage2", key="o_orderkey")
    return round_doubles(mo.cross_validated(["linear_regression", "ridge"], "stage2", train, folds, key="o_orderkey"))


@REGISTER("tree_importances")
def tree_importances(spark, sf):
    train = _training(_matrices(spark, sf, "regression"))
    model, _ = mo.fit_best("random_forest", "stage2", train, key="o_orderkey", grid=POINTS["stage2"]["random_forest"])
    return round_doubles(mo.importances(model, FEATURES, 20))


@REGISTER("permutation_importances")
def permutation_importances(spark, sf):
    parts = _matrices(spark, sf, "regression")
    model, _ = mo.fit_best("linear_regression", "stage2", _training(parts), key="o_orderkey")
    return round_doubles(mo.permutation_importance(model, parts["test"], FEATURES, key="o_orderkey", focus=["price"]))


@REGISTER("learning_curve")
def learning_curve(spark, sf):
    """Two feature sets over growing training parts."""
    full = _matrices(spark, sf, "regression")["test"]
    from pyspark.ml.feature import VectorSlicer

    narrow = VectorSlicer(inputCol="features", outputCol="part", indices=[0, 1]).transform(full).select(
        "o_orderkey", "label", F.col("part").alias("features"))
    points = mo.learning_curve("linear_regression", {"baseline": narrow, "extended": full}, key="o_orderkey")
    return round_doubles(mo.curve_summary(points))


def _part_data(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_retailprice") + F.col("p_size") * 10).alias("label"))
    return staged(mo.assembled(parts, ["p_size"], ["p_partkey", "label"]), "parts")


#: Parts with their fold, and least squares with a penalty per held-out fold (``f``) and penalty (``a``).
_PARTS_SQL = """
t AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice + p_size * 10 AS y,
             (row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) - 1) % 5 AS fold FROM part),
folds(f) AS (VALUES (0), (1), (2), (3), (4)),
fits AS (SELECT f, a, covar_pop(y, x) * count(*) / (var_pop(x) * count(*) + a) AS s, avg(y) AS my, avg(x) AS mx
         FROM t, folds, penalties WHERE fold <> f GROUP BY f, a),
errors AS (SELECT f, a, avg(abs(my + s * (x - mx) - y)) AS mae, 1 - avg((my + s * (x - mx) - y) ** 2) / var_pop(y) AS r2
           FROM t JOIN fits ON fold = f GROUP BY f, a)"""


@REGISTER("ridge_fold_scores", f"""
WITH penalties(a) AS (VALUES (1.0::DOUBLE)), {_PARTS_SQL}
SELECT 'ridge' AS model, metric, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd
FROM (SELECT 'mae' AS metric, mae AS v FROM errors UNION ALL SELECT 'r2', r2 FROM errors) GROUP BY metric""")
def ridge_fold_scores(spark, sf):
    """Cross-validated scores of a one-feature ridge, which has a closed form."""
    data = _part_data(spark, sf)
    out = mo.cross_validated(["ridge"], "stage2", data, mo.stage_folds(data, "stage2", key="p_partkey"), key="p_partkey")
    return out.select("model", "metric", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@REGISTER("ridge_grid_search", f"""
WITH penalties(a) AS (VALUES (0.1::DOUBLE), (1e5::DOUBLE), (1e7::DOUBLE)), {_PARTS_SQL}
SELECT 'ridge' AS model, arg_min(a, m) AS alpha FROM (SELECT a, avg(mae) AS m FROM errors GROUP BY a)""")
def ridge_grid_search(spark, sf):
    """The penalty with the lowest mean error over the folds."""
    data = _part_data(spark, sf)
    _, best = mo.fit_best("ridge", "stage2", data, key="p_partkey", grid={"alpha": [0.1, 1e5, 1e7]},
                          folds=mo.stage_folds(data, "stage2", key="p_partkey"))
    return spark.createDataFrame([("ridge", float(best["alpha"]))], "model string, alpha double")


@REGISTER("least_squares_curve", f"""
WITH penalties(a) AS (VALUES (0.0::DOUBLE)), {_PARTS_SQL},
shares(share) AS (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)),
ordered AS (SELECT f, x, y, row_number() OVER (PARTITION BY f ORDER BY md5('42:size:' || p_partkey), p_partkey) AS rank,
                   count(*) OVER (PARTITION BY f) AS n FROM t, folds WHERE fold <> f),
lines AS (SELECT share, f, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS n FROM ordered, shares
          WHERE rank <= floor(share * n + 1e-9) GROUP BY share, f)
SELECT 'parts' AS run, share, round(avg(n), 4) AS train_rows, round(avg(mae), 4) AS mae_mean, round(stddev_pop(mae), 4) AS mae_sd
FROM (SELECT share, f, any_value(n) AS n, avg(abs(i + s * x - y)) AS mae FROM t JOIN lines ON fold = f GROUP BY share, f) GROUP BY share""")
def least_squares_curve(spark, sf):
    """A learning curve of one-feature least squares."""
    points = mo.learning_curve("linear_regression", {"parts": _part_data(spark, sf)}, key="p_partkey", shares=(0.1, 0.5, 1.0))
    out = mo.curve_summary(points)
    return out.select("run", "share", *[F.round(c, 4).alias(c) for c in ("train_rows", "mae_mean", "mae_sd")])


@REGISTER("permuted_feature", """
WITH t AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice + p_size * 10 AS y FROM part),
line AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM t),
own AS (SELECT r, y, row_number() OVER (PARTITION BY r ORDER BY md5('42:own:' || r || ':' || p_partkey), p_partkey) AS rank FROM t, range(0, 30) g(r)),
donor AS (SELECT r, x, row_number() OVER (PARTITION BY r ORDER BY md5('42:donor:' || r || ':' || p_partkey), p_partkey) AS rank FROM t, range(0, 30) g(r)),
rises AS (SELECT r, avg(abs(i + s * x - y)) - (SELECT avg(abs(i + s * x - y)) FROM t, line) AS rise FROM own JOIN donor USING (r, rank), line GROUP BY r)
SELECT 'p_size' AS feature, round(avg(rise), 4) AS importance_mean, round(stddev_pop(rise), 4) AS importance_std, true AS is_focus FROM rises""")
def permuted_feature(spark, sf):
    """Rise of the error of one-feature least squares when the feature is shuffled, thirty times."""
    data = _part_data(spark, sf)
    model, _ = mo.fit_best("linear_regression", "stage2", data, key="p_partkey")
    out = mo.permutation_importance(model, data, ["p_size"], key="p_partkey", focus=["p_size"])
    return out.select("feature", F.round("importance_mean", 4).alias("importance_mean"), F.round("importance_std", 4).alias("importance_std"), "is_focus")


@REGISTER("binary_logistic", """
WITH t AS (SELECT (o_orderpriority = '1-URGENT')::INT AS urgent, o_custkey % 3 AS label, o_orderkey FROM orders),
g AS (SELECT urgent, label, count(*) / sum(count(*)) OVER (PARTITION BY urgent) AS share FROM t GROUP BY urgent, label)
SELECT urgent, label::INT AS label, round(share, 2) AS p FROM g""")
def binary_logistic(spark, sf):
    """Weakly regularised, over one binary feature: the probabilities are the shares of the classes in both groups."""
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
                                             (F.col("o_custkey") % 3).cast("double").alias("label"))
    data = staged(mo.assembled(rows, ["urgent"], ["o_orderkey", "label"]), "urgent")
    model, _ = mo.fit_best("logistic_regression", "stage1", data, key="o_orderkey", grid={"C": [1e6]})
    preds = mo.class_predictions(model, data, key="o_orderkey").join(rows.select("o_orderkey", "urgent"), "o_orderkey")
    each = preds.groupBy("urgent").agg(*[F.avg(f"p{k}").alias(f"p{k}") for k in range(3)])
    long = F.array(*[F.struct(F.lit(k).alias("label"), F.round(f"p{k}", 2).alias("p")) for k in range(3)])
    return each.select("urgent", F.inline(long))


_TWO_SQL = """
t AS (SELECT p_size::DOUBLE AS x1, (p_partkey % 17)::DOUBLE AS x2, p_retailprice + p_size * 10 AS y,
             (row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) - 1) % 5 AS fold FROM part),
folds(f) AS (VALUES (0), (1), (2), (3), (4)),
sums AS (SELECT f, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22,
                covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1, covar_pop(x2, y) * count(*) AS s2
         FROM t, folds WHERE fold <> f GROUP BY f),
fits AS (SELECT f, a, m1, m2, my, ((s22 + a) * s1 - s12 * s2) / ((s11 + a) * (s22 + a) - s12 * s12) AS b1,
                ((s11 + a) * s2 - s12 * s1) / ((s11 + a) * (s22 + a) - s12 * s12) AS b2 FROM sums, penalties),
misses AS (SELECT f, a, y, my + b1 * (x1 - m1) + b2 * (x2 - m2) - y AS miss FROM t JOIN fits ON fold = f)"""


@REGISTER("two_feature_folds", f"""
WITH penalties(a) AS (VALUES (0.0::DOUBLE), (10.0::DOUBLE), (1e5::DOUBLE)), {_TWO_SQL}
SELECT a AS alpha, f AS fold, round(avg(abs(miss)), 6) AS mae, round(1 - avg(miss * miss) / var_pop(y), 6) AS r2 FROM misses GROUP BY a, f""")
def two_feature_folds(spark, sf):
    """Every penalty on every fold from the folds' moments: the rows are read once for these and once for the errors."""
    from anchorkit.operators import least_squares as ls

    parts = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 17).alias("rest"),
                                            (F.col("p_retailprice") + F.col("p_size") * 10).alias("label"))
    data = mo.assembled(parts, ["p_size", "rest"], ["p_partkey", "label"])
    alphas = [0.0, 10.0, 1e5]
    folded = staged(data.join(mo.stage_folds(data, "stage2", key="p_partkey"), "p_partkey"), "folds")
    rows = [(a, fold, float(s["mae"]), float(s["r2"])) for a, folds in zip(alphas, ls.fold_scores(folded, alphas)) for fold, s in enumerate(folds)]
    return round_doubles(spark.createDataFrame(rows, "alpha double, fold int, mae double, r2 double"))


def _cells(spark, sf):
    """Orders with two flags that decide class and target: every sound classifier or tree must find them again."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), (F.col("o_orderstatus") == "F").cast("int").alias("filled"))
    kind = F.when(F.col("urgent") == 1, 1.0).when(F.col("filled") == 1, 2.0).otherwise(0.0)
    target = 1 + 2 * F.col("urgent") + 4 * F.col("filled") + F.col("urgent") * F.col("filled")
    return orders.withColumns({"kind": kind, "target": target.cast("double")})


def _cell_data(spark, sf, label):
    rows = _cells(spark, sf).withColumn("label", F.col(label))
    return staged(mo.assembled(rows, ["urgent", "filled"], ["o_orderkey", "label"]), "cells")


def _cell_predictions(spark, sf, scored, *columns):
    flags = _cells(spark, sf).select("o_orderkey", "urgent", "filled")
    return scored.join(flags, "o_orderkey").groupBy("urgent", "filled").agg(F.count(F.lit(1)).alias("n"), *columns)


_CELLS_SQL = """
cells AS (SELECT urgent, filled, count(*) AS n FROM (
  SELECT (o_orderpriority = '1-URGENT')::INT AS urgent, (o_orderstatus = 'F')::INT AS filled FROM orders) GROUP BY urgent, filled)"""
_KIND_SQL = "CASE WHEN urgent = 1 THEN 1 WHEN filled = 1 THEN 2 ELSE 0 END"
_SMALL_GRIDS = {"logistic_regression": {"C": [100.0]}, "random_forest": {"n_estimators": [5], "max_depth": [3], "min_samples_leaf": [1]},
                "boosting": {"n_estimators": [1], "max_depth": [2], "learning_rate": [0.1], "subsample": [1.0]}, "svm": {"C": [0.01]},
                "mlp": {"hidden_layer_sizes": [(6,)]}}


@REGISTER("classifiers_of_cells", f"""
WITH {_CELLS_SQL} SELECT model, urgent, filled, n, {_KIND_SQL} AS lowest, {_KIND_SQL} AS highest, true AS sums_to_one, 1.0::DOUBLE AS auc
FROM cells, (VALUES {", ".join(f"('{m}')" for m in _SMALL_GRIDS)}) AS m(model)""")
def classifiers_of_cells(spark, sf):
    """All five classifiers on classes that two flags decide: right predictions, probabilities and an AUC of one each."""
    data, out, preds = _cell_data(spark, sf, "kind"), None, None
    for name, grid in _SMALL_GRIDS.items():
        model, point = mo.fit_best(name, "stage1", data, key="o_orderkey", grid=grid)
        model = mo.with_probabilities(name, model, data, point, key="o_orderkey")
        scored = staged(mo.class_predictions(model, data, key="o_orderkey").withColumn("model", F.lit(name)), "cell-scores")
        one = _cell_predictions(spark, sf, scored, F.min("y_pred").alias("lowest"), F.max("y_pred").alias("highest"),
                                F.bool_and(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) < 1e-9).alias("sums_to_one")).withColumn("model", F.lit(name))
        out, preds = (one, scored) if out is None else (out.unionByName(one), preds.unionByName(scored))
    auc = me.macro_auc(preds, ["model"], {k: f"p{k}" for k in range(3)}).select("model", F.round("AUC", 6).alias("auc"))
    return out.join(auc, "model")


@REGISTER("trees_of_cells", f"""
WITH {_CELLS_SQL} SELECT model, urgent, filled, n, (1 + 2 * urgent + 4 * filled + urgent * filled)::DOUBLE AS lowest,
  (1 + 2 * urgent + 4 * filled + urgent * filled)::DOUBLE AS highest
FROM cells, (VALUES ('random_forest'), ('boosting'), ('gradient_boosting')) AS m(model)""")
def trees_of_cells(spark, sf):
    """Forest and boosted regressors on a target that two flags decide."""
    data, out = _cell_data(spark, sf, "target"), None
    for name in ("random_forest", "boosting", "gradient_boosting"):
        grid = {**_SMALL_GRIDS, "gradient_boosting": {"n_estimators": [1], "max_depth": [2], "learning_rate": [0.1]}}[name]
        model, _ = mo.fit_best(name, "stage2", data, key="o_orderkey", grid=grid)
        scored = model.transform(data).select("o_orderkey", F.round("prediction", 6).alias("p"))
        one = _cell_predictions(spark, sf, scored, F.min("p").alias("lowest"), F.max("p").alias("highest")).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@REGISTER("boosted_probabilities", f"""
WITH {_CELLS_SQL}, s AS (SELECT 1 / (1 + exp(-2.0::DOUBLE)) AS up, 1 / (1 + exp(2.0::DOUBLE)) AS down)
SELECT urgent, filled, k::INT AS label, round(CASE WHEN k = {_KIND_SQL} THEN up ELSE down END / (up + 2 * down), 6) AS p FROM cells, s, range(3) AS g(k)""")
def boosted_probabilities(spark, sf):
    """One boosting round gives margins of one or minus one; their sigmoids are divided by their sum."""
    data = _cell_data(spark, sf, "kind")
    model, point = mo.fit_best("boosting", "stage1", data, key="o_orderkey", grid=_SMALL_GRIDS["boosting"])
    model = mo.with_probabilities("boosting", model, data, point, key="o_orderkey")
    each = _cell_predictions(spark, sf, mo.class_predictions(model, data, key="o_orderkey"), *[F.avg(f"p{k}").alias(f"p{k}") for k in range(3)])
    return each.select("urgent", "filled", F.inline(F.array(*[F.struct(F.lit(k).alias("label"), F.round(f"p{k}", 6).alias("p")) for k in range(3)])))


@REGISTER("fitted_sigmoids", """
WITH t AS (SELECT (o_orderpriority = '1-URGENT')::INT AS urgent, o_custkey % 3 AS label FROM orders),
sizes AS (SELECT k, count(*) FILTER (label = k) AS hits, count(*) FILTER (label <> k) AS others FROM t, range(3) AS g(k) GROUP BY k)
SELECT urgent, k::INT AS label, round(avg(CASE WHEN t.label = k THEN (hits + 1.0::DOUBLE) / (hits + 2) ELSE 1 / (others + 2.0::DOUBLE) END), 6) AS p
FROM t, sizes GROUP BY urgent, k""")
def fitted_sigmoids(spark, sf):
    """Sigmoids over a margin of two values: the fitted probability of each value is the mean of what is wanted there."""
    from anchorkit.operators.calibrate import fit_sigmoids

    u = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    margin = F.array(u.cast("double"), 2.0 - u, 3.0 * u - 1.0)
    rows = staged(table(spark, sf, "orders").select(u.alias("urgent"), (F.col("o_custkey") % 3).cast("int").alias("label"), margin.alias("margins")), "margins")
    found = fit_sigmoids(rows, 3)
    each = F.array(*[F.struct(F.lit(k).alias("label"), F.round(1 / (1 + F.exp(-(F.lit(a) * F.col("margins")[k] + F.lit(b)))), 6).alias("p"))
                     for k, (a, b) in enumerate(found)])
    return rows.select("urgent", F.inline(each)).distinct()


@REGISTER("leading_importances", """
WITH t AS (SELECT (o_orderpriority = '1-URGENT')::INT AS urgent, (o_orderstatus = 'F')::INT AS filled, (o_custkey % 2)::INT AS even FROM orders),
shares AS (
  SELECT 'urgent' AS feature, var_pop(m) / (SELECT var_pop(urgent) FROM t) AS share FROM (SELECT avg(urgent) OVER (PARTITION BY urgent) AS m FROM t)
  UNION ALL SELECT 'filled', var_pop(m) / (SELECT var_pop(urgent) FROM t) FROM (SELECT avg(urgent) OVER (PARTITION BY filled) AS m FROM t)
  UNION ALL SELECT 'even', var_pop(m) / (SELECT var_pop(urgent) FROM t) FROM (SELECT avg(urgent) OVER (PARTITION BY even) AS m FROM t))
SELECT feature, CASE WHEN share > 0.999999 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance FROM shares ORDER BY importance DESC, feature LIMIT 2""")
def leading_importances(spark, sf):
    """The two leading of three features, of which one decides the target."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), (F.col("o_orderstatus") == "F").cast("int").alias("filled"),
        (F.col("o_custkey") % 2).cast("int").alias("even"), (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("label"))
    names = ["urgent", "filled", "even"]
    model, _ = mo.fit_best("random_forest", "stage2", staged(mo.assembled(orders, names, ["o_orderkey", "label"]), "flags"), key="o_orderkey",
                           grid={"n_estimators": [3], "max_depth": [3], "min_samples_leaf": [1]})
    return round_doubles(mo.importances(model, names, 2))


@REGISTER("huber_conditions", """
SELECT name, 0.0::DOUBLE AS residual FROM (VALUES ('intercept'), ('slope'), ('scale')) AS c(name) WHERE (SELECT count(*) FROM part) > 2""")
def huber_conditions(spark, sf):
    """At the Huber fit the derivatives of its loss vanish: by intercept, by slope (with the penalty), by scale."""
    wave = (F.col("p_partkey") * 37 % 101).cast("double") / 10 + F.when(F.col("p_partkey") % 11 == 0, 400.0).otherwise(0.0)
    parts = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_size") * 3.0 + wave).alias("label"))
    data = staged(mo.assembled(parts, ["p_size"], ["p_partkey", "label"]), "huber")
    rows, spread, width = mo.data_shape(data)
    model, _ = mo.fit_best("huber", "stage2", data, key="p_partkey", grid={"epsilon": [1.35], "alpha": [0.0001]}, shape=(rows, spread, width))
    b, e, s = float(model.coefficients[0]), 1.35, float(model.scale)
    from pyspark.ml.functions import vector_to_array

    x = vector_to_array("features")[0]
    z = (F.col("label") - x * F.lit(b) - F.lit(float(model.intercept))) / F.lit(s)
    pull = F.greatest(F.least(z, F.lit(e)), F.lit(-e))
    found = data.agg(F.avg(pull).alias("intercept"), (F.avg(pull * x) / F.avg(F.abs(x)) - F.lit(0.0001 / rows * b)).alias("slope"),
                     (F.lit(1.0) - F.avg(pull * pull)).alias("scale"))
    long = F.array(*[F.struct(F.lit(c).alias("name"), (F.round(c, 2) + F.lit(0.0)).alias("residual")) for c in ("intercept", "slope", "scale")])
    return found.select(F.inline(long))
