"""Whole runs: extracts, feature tables, model stages and the comparison of two feature sets."""

from __future__ import annotations

from typing import Any

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorkit.config import merged
from anchorkit.operators import cohort as co
from anchorkit.operators import compare as cp
from anchorkit.operators import metrics as me
from anchorkit.operators import models as mo
from anchorkit.operators import prep as pr
from anchorkit.operators.oversample import oversample
from anchorkit.operators.quality import check_prepared, cohort_table, validate_features
from anchorkit.plans import clinical as cl
from anchorkit.session import staged
from anchorkit.sources import files, sinks, tables

STAGE1 = ["logistic_regression", "random_forest", "boosting", "svm", "mlp"]
STAGE2 = ["linear_regression", "ridge", "huber", "random_forest", "boosting", "gradient_boosting"]
CLASS_ABLATION_ORDER = ["boosting", "random_forest", "logistic_regression"]
SOURCE_TABLES = ["icustays", "patients", "admissions", "diagnoses_icd", "chartevents", "labevents"]
SCORE_TABLES = ["inputevents", "outputevents"]
CLASS_METRICS = ["Accuracy", "Macro-F1", "Short-F1", "Medium-F1", "Long-F1", "Kappa", "AUC"]
DAY_METRICS = ["MAE", "RMSE", "R2", "MAPE", "MedianAE"]


def source_tables(spark: SparkSession, config: dict[str, Any], severity: bool = True) -> dict[str, DataFrame]:
    return tables.load_tables(spark, config, [*SOURCE_TABLES, *(SCORE_TABLES if severity else [])])


def cohort_of(views: dict[str, DataFrame], config: dict[str, Any]) -> DataFrame:
    c = config["cohort"]
    return co.select_cohort(
        views["icustays"], views["patients"], min_age=c["min_age"], min_hours=c["min_los_hours"],
        max_days=c["max_los_days"], first_only=c["first_only"], los="los" if "los" in views["icustays"].columns else None)


def extract_all(views: dict[str, DataFrame], config: dict[str, Any], folder: str) -> dict[str, DataFrame]:
    """Interim parquet of cohort, diagnoses, vitals, labs, severity and occupancy."""
    from anchorkit.operators.encode import top_chapters
    from anchorkit.operators.occupancy import occupancy

    cohort = sinks.save_parquet(cohort_of(views, config), f"{folder}/cohort")
    events = [views[t] for t in ("chartevents", "labevents", "inputevents", "outputevents")]
    rest = sinks.save_extracts({
        "diagnoses": top_chapters(views["diagnoses_icd"]), "vitals": cl.vitals(cohort, views["chartevents"]),
        "labs": cl.labs(cohort, views["labevents"]), "severity": cl.severity_score(cohort, *events),
        "occupancy": occupancy(cohort),
    }, folder)
    return {"cohort": cohort, **rest}


def feature_tables(views: dict[str, DataFrame], config: dict[str, Any], folder: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(baseline, extended) feature tables, each built once and then read from ``folder``.

    A table is built again when the settings it depends on or the source tables' files have changed.
    One store of windowed events serves both.
    """
    spark = views["icustays"].sparkSession
    bins = config["los_bins"]
    sources = [views[t] for t in SOURCE_TABLES]
    asked = {"cohort": config["cohort"]}
    cohort = sinks.cached(spark, f"{folder}/cohort", lambda: cohort_of(views, config), asked, [views["icustays"], views["patients"]])
    store: list[DataFrame] = []

    def events() -> DataFrame:
        if not store:
            store.append(cl.event_store(cohort, views))
        return store[0]

    asked |= {"bins": bins, "top_units": config["top_units"]}
    base = sinks.cached(spark, f"{folder}/baseline_features", lambda: cl.base_features(
        views, cohort=cohort, short=bins["short_threshold_days"], long=bins["long_threshold_days"], top_units=config["top_units"],
        store=events()), asked, sources)

    def extend() -> DataFrame:
        score = staged(cl.severity_from(cohort, events()), "score")
        return cl.extended_features(base, cl.checked_severity(score, strict))

    extended = sinks.cached(spark, f"{folder}/extended_features", extend, asked | {"strict": strict},
                            [*sources, *[views[t] for t in SCORE_TABLES]])
    sinks.save_parquet(validate_features(base), f"{folder}/feature_missingness")
    return base, extended


def shared_splits(features: DataFrame, path: str, config: dict[str, Any]) -> DataFrame:
    """The split table at ``path``; made from the first run's features and reused by the second."""
    p = config["preparation"]
    spark = features.sparkSession
    if not files.finished(spark, path):
        sinks.save_splits(pr.stratified_split(features, test_size=p["test_size"], val_size=p["val_size"], seed=config["seed"]), path)
    return sinks.load_splits(spark, path)


def _oversampled(train: DataFrame, cap: int | None, seed: int) -> DataFrame:
    """The network's training rows: capped, then classes filled up."""
    small = pr.capped_sample(train, cap, key="stay_id", label="label", seed=seed)
    points = small.select("stay_id", "label", vector_to_array("features").alias("x"))
    full = oversample(staged(points, "points"), key="stay_id", label="label", vector="x", seed=seed)
    return staged(full.select("stay_id", "label", array_to_vector("x").alias("features")), "oversampled")


def run_stages(features: DataFrame, splits: DataFrame, folder: str, run: str, config: dict[str, Any] | None = None, *,
               stage1: list[str] | None = None, stage2: list[str] | None = None,
               grids1: dict | None = None, grids2: dict | None = None) -> dict[str, DataFrame]:
    """Prepare, train on train and validation rows, predict the test rows, store everything.

    Statistics come from the training rows only. Stored below ``folder``: models, the
    preparation, one predictions table of both stages, metrics per stage.
    """
    cfg = merged(config)
    spark, p = features.sparkSession, cfg["preparation"]
    names = {"stage1": STAGE1 if stage1 is None else stage1, "stage2": STAGE2 if stage2 is None else stage2}
    grids = {"stage1": mo.STAGE1_GRIDS if grids1 is None else grids1, "stage2": mo.STAGE2_GRIDS if grids2 is None else grids2}
    targets = {"stage1": ("classification", "los_class"), "stage2": ("regression", "los_log")}
    preds_path, stored = f"{folder}/predictions", {}
    for stage, (target, y) in targets.items():
        prep = pr.Preparation(scaling=p["scaling"], strategy=p["imputation_strategy"])
        frames = pr.prepare_splits(features, splits, prep, target=target)
        columns = prep.fitted.outputs
        check_prepared(frames["train"].unionByName(frames["val"]), frames["test"], p["test_size"], columns)
        spark.createDataFrame([(prep.fitted.to_json(),)], "fitted string").coalesce(1).write.mode("overwrite").text(f"{folder}/preparation_{stage}")
        matrix = {s: staged(mo.assembled(f.withColumn("label", F.col(y).cast("double")), columns, ["stay_id", "label"]), s)
                  for s, f in frames.items()}
        train = matrix["train"].unionByName(matrix["val"])
        if stage == "stage1":
            train = staged(mo.weighted(train), "weighted")
        folds = mo.stage_folds(train, stage, folds=p["cv_folds"], seed=cfg["seed"])
        for name in names[stage]:
            network = name == "mlp"
            data = _oversampled(train, cfg["caps"].get(name), cfg["seed"]) if network else train
            weight = "weight" if stage == "stage1" and not network else None
            model, point = mo.fit_best(name, stage, data, grid=grids[stage].get(name), folds=folds, seed=cfg["seed"], weight=weight)
            if stage == "stage1":
                model = mo.with_probabilities(name, model, data, point, weight=weight, seed=cfg["seed"])
            mo.save_model(model, f"{folder}/models/{name}_{stage}")
            if stage == "stage1":
                out = mo.class_predictions(model, matrix["test"])
            else:
                out = mo.day_predictions(model, matrix["test"]).select(
                    "stay_id", F.col("y_true_days").alias("y_true"), F.col("y_pred_days").alias("y_pred"))
            sinks.save_predictions(out, f"{preds_path}_{stage}", run, name, stage)
        preds = spark.read.parquet(f"{preds_path}_{stage}").where(F.col("run") == run)
        if stage == "stage1":
            table = me.classification_metrics(preds, ["model", "stage"]).join(
                me.macro_auc(preds, ["model", "stage"], {k: f"p{k}" for k in range(3)}), ["model", "stage"], "left")
            sinks.save_parquet(me.confusion_counts(preds, ["model"]), f"{folder}/confusion")
        else:
            table = me.regression_metrics(preds, ["model", "stage"])
        stored[stage] = sinks.save_parquet(table, f"{folder}/metrics_{stage}")
    return stored


def describe(features: DataFrame, folder: str) -> None:
    """Cohort table and the rank correlation of every numeric feature with the length of stay."""
    sinks.save_csv(cohort_table(features), f"{folder}/cohort_table")
    numeric = [c for c in pr.feature_columns(features) if dict(features.dtypes)[c] not in ("string", "timestamp_ntz", "timestamp")]
    found = cp.spearman(features, numeric, "los_days", p_values=True)
    sinks.save_csv(found.orderBy(F.abs("spearman_r").desc(), "feature"), f"{folder}/correlations")


def compare_runs(baseline_folder: str, extended_folder: str, extended_features: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Metric deltas, paired tests of the best common model, strata by severity, class ablation."""
    spark = extended_features.sparkSession
    read = lambda where, what: spark.read.parquet(f"{where}/{what}")
    metrics = {(s, w): read(p, f"metrics_{s}") for s in ("stage1", "stage2") for w, p in (("b", baseline_folder), ("e", extended_folder))}
    joined = lambda w: metrics["stage1", w].unionByName(metrics["stage2", w], allowMissingColumns=True)
    out = {"delta_metrics": cp.delta_table(joined("b"), joined("e"), [*CLASS_METRICS, *DAY_METRICS])}

    best = cp.best_common_model(metrics["stage2", "b"], metrics["stage2", "e"]).first()["model"]
    common = metrics["stage2", "b"].join(metrics["stage2", "e"].select("model"), "model", "left_semi").count()
    both = lambda s: read(baseline_folder, f"predictions_{s}").unionByName(read(extended_folder, f"predictions_{s}"))
    pair = staged(sinks.prediction_pair(both("stage2"), model=best), "pair")
    errors = cp.paired_errors(pair, "y_true", "baseline", "candidate")
    out["significance"] = cp.paired_tests(errors, ["model"], n_models=common)
    if "sofa_total" in extended_features.columns:
        strata = pair.join(extended_features.select("stay_id", "sofa_total"), "stay_id")
        out["severity_strata"] = cp.stratified_error(strata, "sofa_total", "y_true", "baseline", "candidate")
    classes = both("stage1")
    known = {r["model"] for r in metrics["stage1", "b"].join(metrics["stage1", "e"].select("model"), "model", "left_semi").select("model").collect()}
    for name in CLASS_ABLATION_ORDER:
        if name in known:
            pairs = sinks.prediction_pair(classes, model=name, stage="stage1")
            out["class_ablation"] = cp.class_ablation(pairs, "y_true", "baseline", "candidate")
            break
    for name, df in out.items():
        sinks.save_csv(df, f"{folder}/{name}")
    return out
