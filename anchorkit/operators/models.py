"""MLlib classifiers and regressors on keyed feature tables: grids, scores, importances."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.errors import IllegalArgumentException
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorkit.functions.values import days_from_log, hash_text
from anchorkit.operators import least_squares as ls
from anchorkit.operators.boosted import BlockGBTClassifier, BlockGBTRegressor
from anchorkit.operators.calibrate import BOOSTED, MarginModel, fit_sigmoids, out_of_fold_margins
from anchorkit.operators.metrics import classification_metrics, regression_metrics
from anchorkit.operators.pairing import permuted_pairs
from anchorkit.operators.perceptron import BlockPerceptron
from anchorkit.operators.prep import balanced_weights, class_folds, fold_weights, plain_folds
from anchorkit.operators.running import hash_ranks
from anchorkit.plans.retail import spread
from anchorkit.session import staged

MAX_DEPTH = 30  # MLlib's deepest tree stands for "no limit"
#: Regressors with a closed form: folds, penalties and growing parts come from moments.
CLOSED_FORM = ("linear_regression", "ridge")

# Default grids.
STAGE1_GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0]},
    "random_forest": {"n_estimators": [100, 300], "max_depth": [5, 10, None], "min_samples_leaf": [1, 5]},
    "boosting": {"n_estimators": [100, 300], "max_depth": [3, 6], "learning_rate": [0.05, 0.1], "subsample": [0.8, 1.0]},
    "svm": {"C": [0.1, 1.0, 10.0]},
    "mlp": {"hidden_layer_sizes": [(64, 32), (128, 64, 32)]},
}
STAGE2_GRIDS = {
    "linear_regression": {},
    "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "huber": {"epsilon": [1.2, 1.35, 1.5], "alpha": [0.0001, 0.001, 0.01]},
    "random_forest": {"n_estimators": [100, 300], "max_depth": [5, 10, None], "min_samples_leaf": [1, 5]},
    "boosting": {"n_estimators": [100, 300], "max_depth": [3, 6], "learning_rate": [0.05, 0.1], "subsample": [0.8, 1.0]},
    "gradient_boosting": {"n_estimators": [100, 300], "max_depth": [3, 5], "learning_rate": [0.05, 0.1]},
}
# Settings used without a grid.
DEFAULTS = {
    "logistic_regression": {"C": 1.0}, "svm": {"C": 1.0}, "mlp": {"hidden_layer_sizes": (128, 64, 32)},
    "random_forest": {"n_estimators": 300, "max_depth": 10, "min_samples_leaf": 5},
    "boosting": {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8},
    "gradient_boosting": {"n_estimators": 300, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.8},
    "linear_regression": {}, "ridge": {"alpha": 1.0}, "huber": {"epsilon": 1.35, "alpha": 0.0001},
}


def assembled(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep, features vector)."""
    vector = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    return vector.transform(df.select(*keep, *features)).select(*keep, "features")


def base_estimator(name: str, stage: str, *, label: str = "label", weight: str | None = None, classes: int = 3,
                   seed: int = 42) -> Estimator:
    """The untuned estimator of a stage ('stage1' classifies, 'stage2' regresses).

    Boosted trees and the linear SVM are binary in MLlib and run one-vs-rest, without row cap.
    """
    weighted = {"weightCol": weight} if weight else {}
    if stage == "stage1":
        if name == "logistic_regression":
            return LogisticRegression(family="multinomial", standardization=False, maxIter=1000, labelCol=label, **weighted)
        if name == "random_forest":
            return RandomForestClassifier(labelCol=label, seed=seed, **weighted)
        if name == "boosting":
            # a share of the columns is drawn for every node
            return OneVsRest(classifier=BlockGBTClassifier(seed=seed, featureSubsetStrategy="0.8"), labelCol=label, parallelism=classes, **weighted)
        if name == "svm":
            # a finer tolerance makes the line search of the hinge loss, which has no slope at its kink, try in vain
            return OneVsRest(classifier=LinearSVC(standardization=False, tol=1e-3), labelCol=label, parallelism=classes, **weighted)
        if name == "mlp":
            return BlockPerceptron(labelCol=label, maxIter=200, seed=seed)
    elif stage == "stage2":
        if name in ("linear_regression", "ridge"):
            return LinearRegression(labelCol=label, solver="normal", elasticNetParam=0.0, standardization=False)
        if name == "huber":
            return LinearRegression(labelCol=label, loss="huber", standardization=False, maxIter=2000)
        if name == "random_forest":
            return RandomForestRegressor(labelCol=label, featureSubsetStrategy="all", seed=seed)
        if name == "boosting":
            return BlockGBTRegressor(labelCol=label, seed=seed, featureSubsetStrategy="0.8")
        if name == "gradient_boosting":
            return BlockGBTRegressor(labelCol=label, seed=seed)
    raise KeyError(f"{stage}: {name}")


def settings_for(name: str, point: dict, *, rows: float, width: int = 0, classes: int = 3, spread: float = 1.0) -> dict:
    """MLlib parameter values of one grid point.

    C and alpha weigh summed losses, MLlib's regParam the mean loss: regParam = 1 / (C n) or
    alpha / n. Squared loss also rescales the label, hence the population sd ``spread``.
    """
    p = {**DEFAULTS[name], **point}
    if name in ("logistic_regression", "svm"):
        return {"regParam": 1.0 / (p["C"] * rows)}
    if name == "random_forest":
        return {"numTrees": p["n_estimators"], "maxDepth": p["max_depth"] or MAX_DEPTH,
                "minInstancesPerNode": p["min_samples_leaf"]}
    if name in ("boosting", "gradient_boosting"):
        return {"maxIter": p["n_estimators"], "maxDepth": p["max_depth"], "stepSize": p["learning_rate"],
                "subsamplingRate": p["subsample"]}
    if name == "mlp":
        return {"layers": [width, *p["hidden_layer_sizes"], classes]}
    if name == "ridge":
        return {"regParam": p["alpha"] * spread / rows}
    if name == "huber":
        return {"epsilon": p["epsilon"], "regParam": p["alpha"] / rows}
    return {}


def param_map(estimator: Estimator, settings: dict) -> dict:
    """Settings as an MLlib parameter map; one-vs-rest hands them to its binary classifier."""
    owner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    return {owner.getParam(k): v for k, v in settings.items()}


class MacroF1(Evaluator):
    """Unweighted mean of the class F1 values (MLlib's ``f1`` weights classes by size)."""

    def __init__(self, label: str = "label", classes: int = 3):
        super().__init__()
        self.label, self.names = label, {k: str(k) for k in range(classes)}

    def _evaluate(self, dataset: DataFrame) -> float:
        row = classification_metrics(dataset, [], self.label, "prediction", self.names).first()
        return float(row["Macro-F1"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def grid_points(grid: dict[str, list] | None) -> list[dict]:
    """All combinations of a grid; one empty setting without a grid."""
    names = list(grid or {})
    return [dict(zip(names, combo)) for combo in product(*[grid[n] for n in names])] if names else [{}]


def data_shape(data: DataFrame, label: str = "label") -> tuple[int, float, int]:
    """Rows, population sd of the label (1 when it is 0 or missing) and width of the features."""
    row = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("s"),
                   F.first(F.size(vector_to_array("features"))).alias("w")).first()
    return row["n"], float(row["s"] or 1.0), row["w"] or 0


def _mean_scores(joined: DataFrame, estimator: Estimator, maps: list[dict], judge: Evaluator, k: int, label: str,
                 weight: str | None, parallelism: int) -> list[float]:
    """Mean score per setting over the folds, not a number for a setting that can't be fitted in one.

    Only a setting that the estimator refuses counts as that; a failed job ends the search. Class
    weights are those of each fold's own training rows.
    """
    others = fold_weights(joined, k, label, weight) if weight else [joined.where(F.col("fold") != fold) for fold in range(k)]
    parts = [(train, joined.where(F.col("fold") == fold)) for fold, train in enumerate(others)]

    def one(job: tuple[int, dict]) -> float:
        train, held = parts[job[0]]
        try:
            model = estimator.fit(train, job[1])
        except (IllegalArgumentException, ValueError):
            return math.nan
        return float(judge.evaluate(model.transform(held)))

    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(one, [(fold, m) for m in maps for fold in range(k)]))
    return [sum(found[i * k:(i + 1) * k]) / k for i in range(len(maps))]


def merged_rows(data: DataFrame, label: str, weight: str | None, rows: float) -> tuple[DataFrame, str | None]:
    """Rows with equal label and features as one with the sum of their weights, and the name of the weight.

    Only where that leaves at most a tenth of the rows (of flags, say); other data stays as it is. For models
    that minimise a weighted sum over the rows and go over them very often: their loss stays the same.
    """
    kinds = data.agg(F.approx_count_distinct(F.xxhash64(label, vector_to_array("features"))).alias("n")).first()["n"]
    if kinds * 10 > rows:
        return data, weight
    size = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    merged = data.groupBy(label, vector_to_array("features").alias("_x")).agg(size.alias("_size"))
    return staged(merged.select(label, array_to_vector("_x").alias("features"), "_size"), "merged"), "_size"


def _penalty(name: str, point: dict) -> float:
    return float({**DEFAULTS[name], **point}["alpha"]) if name == "ridge" else 0.0


def fit_best(name: str, stage: str, data: DataFrame, *, key: str = "stay_id", grid: dict[str, list] | None = None,
             folds: DataFrame | None = None, label: str = "label", weight: str | None = None, classes: int = 3,
             parallelism: int = 4, seed: int = 42, shape: tuple[int, float, int] | None = None,
             left_out: list[dict] | None = None) -> tuple[Model, dict]:
    """Fit directly without folds or grid, otherwise choose by cross-validation and refit on all rows.

    Stage 1 maximises macro-F1, stage 2 minimises MAE. ``data`` is (key, label, features[, weight]);
    the folds are a keyed column, so every setting is scored on the same rows. ``shape`` is
    :func:`data_shape` when already known. Settings that an estimator refuses are left out and appended to
    ``left_out``; all refused is an error, and so is any failed job. Ridge penalties are scored from
    moments in two passes over the rows, however many there are.
    """
    rows, spread, width = shape or data_shape(data, label)
    estimator = base_estimator(name, stage, label=label, weight=weight, classes=classes, seed=seed)
    tune = lambda point, n: param_map(estimator, settings_for(
        name, point, rows=n, width=width, classes=classes, spread=spread))
    points = grid_points(grid)

    def whole(point: dict) -> Model:
        if name != "svm":  # whose line search goes over the rows a thousand times
            return estimator.fit(data, tune(point, rows))
        merged, size = merged_rows(data, label, weight, rows)
        own = base_estimator(name, stage, label=label, weight=size, classes=classes, seed=seed)
        return own.fit(merged, param_map(own, settings_for(name, point, rows=rows, width=width, classes=classes, spread=spread)))

    if folds is None or len(points) == 1:
        return whole(points[0]), points[0]
    joined = staged(data.join(folds.select(key, "fold"), key), "folds")
    k = joined.agg(F.max("fold")).first()[0] + 1
    judge = MacroF1(label, classes) if stage == "stage1" else RegressionEvaluator(labelCol=label, metricName="mae")
    if stage == "stage2" and name in CLOSED_FORM:
        by_fold = ls.fold_scores(joined, [_penalty(name, p) for p in points], label=label)
        scores = [sum(f["mae"] for f in folds_) / len(folds_) for folds_ in by_fold]
    else:
        scores = _mean_scores(joined, estimator, [tune(p, rows * (k - 1) / k) for p in points], judge, k, label, weight, parallelism)
    if left_out is not None:
        left_out += [p for p, x in zip(points, scores) if math.isnan(x)]
    known = [x for x in scores if not math.isnan(x)]
    if not known:
        raise RuntimeError(f"no setting of {name} could be fitted")
    best = points[scores.index(max(known) if judge.isLargerBetter() else min(known))]
    return whole(best), best


def cross_validated(names: list[str], stage: str, data: DataFrame, folds: DataFrame, *, key: str = "stay_id",
                    label: str = "label", classes: int = 3, seed: int = 42, points: dict[str, dict] | None = None,
                    balanced: bool = True, parallelism: int = 4) -> DataFrame:
    """(model, metric, mean, sd) over folds, sd with denominator n: accuracy and macro-F1, or MAE and R2.

    Classifiers are ``balanced``: each fold's training rows carry their own class weights.
    """
    spark = data.sparkSession
    joined = staged(data.join(folds.select(key, "fold"), key), "folds")
    k = joined.agg(F.max("fold")).first()[0] + 1
    weight = "weight" if stage == "stage1" and balanced else None
    others = fold_weights(joined, k, label, weight) if weight else [joined.where(F.col("fold") != fold) for fold in range(k)]

    def one(job: tuple[str, int]) -> list[tuple]:
        name, fold = job
        model, _ = fit_best(name, stage, others[fold], key=key, label=label, classes=classes, seed=seed, weight=weight,
                            grid={n: [v] for n, v in (points or {}).get(name, {}).items()})
        scored = model.transform(joined.where(F.col("fold") == fold)).select(label, "prediction")
        if stage == "stage1":
            row = classification_metrics(scored, [], label, "prediction", {c: str(c) for c in range(classes)}).first()
            return [(name, "accuracy", row["Accuracy"]), (name, "f1_macro", row["Macro-F1"])]
        row = regression_metrics(scored, [], label, "prediction", median=False).first()
        return [(name, "mae", row["MAE"]), (name, "r2", row["R2"])]

    closed = [n for n in names if stage == "stage2" and n in CLOSED_FORM]
    # one gathering and one scoring pass for all closed forms together
    scored = ls.fold_scores(joined, [_penalty(n, (points or {}).get(n, {})) for n in closed], label=label) if closed else []
    parts = [(n, metric, f[metric]) for n, by_fold in zip(closed, scored) for f in by_fold for metric in ("mae", "r2")]
    with ThreadPoolExecutor(parallelism) as pool:
        jobs = [(name, fold) for name in names if name not in closed for fold in range(k)]
        parts += [r for rows in pool.map(one, jobs) for r in rows]
    table = spark.createDataFrame(parts, "model string, metric string, score double")
    return table.groupBy("model", "metric").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))


def class_predictions(model: Model | MarginModel, data: DataFrame, *, key: str = "stay_id", label: str = "label", classes: int = 3) -> DataFrame:
    """(key, y_true, y_pred, p0, p1, ...); the probabilities are NULL for a model without them."""
    out = model.transform(data)
    if "probability" in out.columns:
        vector = vector_to_array("probability")
        probs = [vector[c].alias(f"p{c}") for c in range(classes)]
    else:
        probs = [F.lit(None).cast("double").alias(f"p{c}") for c in range(classes)]
    return out.select(key, F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), *probs)


def day_predictions(model: Model, data: DataFrame, *, key: str = "stay_id", label: str = "label") -> DataFrame:
    """(key, y_true_days, y_pred_days, y_true_log, y_pred_log) of a model of the log target."""
    return model.transform(data).select(
        key, F.expm1(label).alias("y_true_days"), days_from_log("prediction").alias("y_pred_days"),
        F.col(label).alias("y_true_log"), F.col("prediction").alias("y_pred_log"))


def with_probabilities(name: str, model: Model, data: DataFrame, point: dict, *, key: str = "stay_id", label: str = "label",
                       weight: str | None = None, classes: int = 3, folds: int = 2, seed: int = 42,
                       calibrate: bool | None = None) -> Model | MarginModel:
    """A one-vs-rest classifier with class probabilities; other models as they are.

    Boosted trees use the sigmoid of their own loss, unless ``calibrate``; the SVM's sigmoids are fitted on
    margins out of ``folds`` stratified folds of its training rows ``data`` with the setting ``point``. Too few rows
    for two folds leave its sigmoids at one.
    """
    if not isinstance(model, OneVsRestModel):
        return model
    if calibrate is None:
        calibrate = name != "boosting"
    marks = class_folds(data, key=key, label=label, folds=folds, seed=seed) if calibrate else None
    if marks is None:
        return MarginModel(model, [BOOSTED if name == "boosting" else (1.0, 0.0)] * classes)

    def fit(train: DataFrame) -> OneVsRestModel:
        if weight:
            train = balanced_weights(train.drop(weight), label, weight)
        return fit_best(name, "stage1", train, key=key, label=label, weight=weight, classes=classes, seed=seed,
                        grid={k: [v] for k, v in point.items()})[0]

    seen = out_of_fold_margins(data, marks, fit, key, label)
    return MarginModel(model, fit_sigmoids(seen, classes, label))


def save_model(model: Model | MarginModel, path: str) -> None:
    if isinstance(model, MarginModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def importances(model: Model, features: list[str], top: int | None = None) -> DataFrame:
    """(feature, importance) of a tree model, highest first."""
    from pyspark.sql import SparkSession

    values = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    table = SparkSession.getActiveSession().createDataFrame(values, "feature string, importance double")
    ordered = table.orderBy(F.col("importance").desc(), "feature")
    return ordered.limit(top) if top else ordered


def used_features(model: Model, width: int) -> list[int]:
    """Positions of the features that can change a prediction: coefficients or importances other than zero, all if unknown."""
    for name in ("coefficients", "featureImportances"):
        if hasattr(model, name):
            weights = getattr(model, name).toArray()
            return [j for j in range(width) if weights[j] != 0]
    return list(range(width))


def permutation_importance(model: Model, data: DataFrame, features: list[str], *, key: str = "stay_id", label: str = "label",
                           repeats: int = 30, seed: int = 42, focus: list[str] | None = None) -> DataFrame:
    """(feature, importance_mean, importance_std, is_focus): rise of the MAE when a column is shuffled.

    A repeat pairs every row with a donor row through two independent random orders of the keys;
    column by column the donor's value replaces the own one. So a repeat costs one join for all
    features, all repeats run in one job, and each row is shuffled once a side. Every row is
    scored once. A linear model's other predictions are the first one plus coefficient * (donor - own),
    taken side by side in one aggregation: no row is copied. Other models score a copy of a row per
    repeat and feature that the model uses; features it doesn't use have exactly zero.
    """
    scored = model.transform(data.select(key, label, "features")).select(
        key, F.col(label).alias("_y"), F.col("prediction").alias("_p"), vector_to_array("features").alias("_x"))
    scored = staged(spread(scored), "scored")  # every row becomes many in the task that reads it
    sums = scored.agg(F.avg(F.abs(F.col("_p") - F.col("_y"))).alias("plain"), F.count(F.lit(1)).alias("n")).first()
    plain, paired = sums["plain"], permuted_pairs(scored, key, ["_y", "_p", "_x"], "_x", repeats, seed, sums["n"])
    used = used_features(model, len(features))
    spark = data.sparkSession
    rises = None
    if used and hasattr(model, "coefficients"):
        step = lambda j: F.lit(float(model.coefficients[j])) * (F.col("_d")[j] - F.col("_x")[j])
        wide = paired.groupBy("repeat").agg(*[F.avg(F.abs(F.col("_p") + step(j) - F.col("_y"))).alias(f"m{j}") for j in used])
        rises = wide.select(F.inline(F.array(*[F.struct(F.lit(j).alias("j"), (F.col(f"m{j}") - F.lit(plain)).alias("rise")) for j in used])))
    elif used:
        swapped = paired.select("repeat", "_y", "_x", "_d", F.explode(F.array(*[F.lit(j) for j in used])).alias("j")).select(
            "repeat", "_y", "j", array_to_vector(
                F.transform("_x", lambda v, i: F.when(i == F.col("j"), F.get("_d", F.col("j"))).otherwise(v))).alias("features"))
        miss = F.avg(F.abs(F.col("prediction") - F.col("_y")))
        rises = model.transform(swapped).groupBy("j", "repeat").agg((miss - F.lit(plain)).alias("rise"))
    names = spark.createDataFrame(list(enumerate(features)), "j int, feature string")
    if rises is None:
        table = names.select("j", F.lit(0.0).alias("importance_mean"), F.lit(0.0).alias("importance_std"))
    else:
        table = rises.groupBy("j").agg(F.avg("rise").alias("importance_mean"), F.stddev_pop("rise").alias("importance_std"))
    zero = lambda c: F.when(F.col("j").isin(used), F.col(c)).otherwise(F.lit(0.0)).alias(c)
    named = names.join(table, "j", "left").select("feature", zero("importance_mean"), zero("importance_std"))
    return named.withColumn("is_focus", F.col("feature").isin(list(focus or []))) if focus is not None else named


def learning_curve(name: str, runs: dict[str, DataFrame], *, key: str = "stay_id", label: str = "label",
                   shares: tuple[float, ...] = tuple(i / 10 for i in range(1, 11)), folds: int = 5, seed: int = 42,
                   point: dict | None = None) -> DataFrame:
    """(run, share, fold, train_rows, mae) of a regressor trained on growing parts of each fold.

    ``runs`` maps a run to its (key, label, features). A part is the first ``floor(share * n)`` of a
    fold's n training keys in a random order that is the same for every run. The error of a part too
    small to fit (under two rows) is missing.
    """
    first = next(iter(runs.values()))
    marks = plain_folds(first, key=key, folds=folds, seed=seed)
    held_out = F.explode(F.array(*[F.lit(f) for f in range(folds)]))
    orders = marks.select(key, "fold", held_out.alias("held")).where("fold <> held").withColumn(
        "_h", hash_text(seed, F.lit("size"), F.col(key)))
    ranked = staged(hash_ranks(orders, ["held"], "_h", [key], "_rank").select(key, "held", "_rank"), "curve-order")
    sizes = {r["held"]: r["n"] for r in ranked.groupBy("held").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = first.sparkSession
    rows_of = lambda fold, share: int(math.floor(share * sizes.get(fold, 0) + 1e-9))
    if name in CLOSED_FORM:
        rows = _closed_curve(_penalty(name, point or {}), runs, marks, ranked, rows_of, key, label, shares, folds)
        return spark.createDataFrame(rows, "run string, share double, fold int, train_rows long, mae double")
    stored = {run: staged(data.join(marks, key), "curve") for run, data in runs.items()}

    def one(job: tuple[str, int, float]) -> tuple:
        run, fold, share = job
        n = rows_of(fold, share)
        if n < 2:
            return run, float(share), fold, n, None
        part = stored[run].join(ranked.where((F.col("held") == fold) & (F.col("_rank") <= n)).select(key), key)
        model, _ = fit_best(name, "stage2", part.select(key, label, "features"), key=key, label=label, seed=seed,
                            grid={k: [v] for k, v in (point or {}).items()})
        scored = model.transform(stored[run].where(F.col("fold") == fold))
        return run, float(share), fold, n, regression_metrics(scored, [], label, "prediction", median=False).first()["MAE"]

    with ThreadPoolExecutor(4) as pool:
        rows = list(pool.map(one, [(run, fold, share) for run in runs for fold in range(folds) for share in shares]))
    return spark.createDataFrame(rows, "run string, share double, fold int, train_rows long, mae double")


def _closed_curve(alpha: float, runs: dict[str, DataFrame], marks: DataFrame, ranked: DataFrame, rows_of, key: str, label: str,
                  shares: tuple[float, ...], folds: int) -> list[tuple]:
    """Points of the learning curve of a closed form: a row's place in each fold's order gives the part it first belongs to."""
    ordered = sorted(shares)
    part = F.lit(None).cast("int")
    for fold in range(folds):
        ends = [rows_of(fold, s) for s in ordered]
        first = F.aggregate(F.array(*[F.lit(e) for e in ends]), F.lit(0), lambda n, e: n + (e < F.col("_rank")).cast("int"))
        part = F.when((F.col("held") == fold) & (F.col("_rank") <= ends[-1]), first).otherwise(part)
    parts = ranked.withColumn("_part", part).groupBy(key).agg(
        F.array(*[F.max(F.when(F.col("held") == f, F.col("_part"))) for f in range(folds)]).alias("parts"))
    places = staged(marks.join(parts, key, "left"), "curve-parts")
    rows = []
    for run, data in runs.items():
        stored = staged(data.select(key, label, "features").join(places, key), "curve")
        found = ls.growing_errors(stored, folds, len(ordered), alpha, label=label)
        rows += [(run, float(share), fold, rows_of(fold, share), found[fold, ordered.index(share)] if rows_of(fold, share) >= 2 else None)
                 for fold in range(folds) for share in shares]
    return rows


def curve_summary(points: DataFrame) -> DataFrame:
    """Mean and spread over folds per run and share."""
    return points.groupBy("run", "share").agg(
        F.avg("train_rows").alias("train_rows"), F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_sd"))


def weighted(data: DataFrame, label: str = "label") -> DataFrame:
    """Add balanced class weights as ``weight``."""
    return balanced_weights(data, label, "weight")


def stage_folds(data: DataFrame, stage: str, *, key: str = "stay_id", label: str = "label", folds: int = 5, seed: int = 42) -> DataFrame | None:
    """Stratified folds for classifiers, plain ones for regressors."""
    if stage == "stage1":
        return class_folds(data, key=key, label=label, folds=folds, seed=seed)
    return plain_folds(data, key=key, folds=folds, seed=seed)
