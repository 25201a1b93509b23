"""Preparation, oversampling, tests of significance, sources and one whole comparison run."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorkit.config import merged
from anchorkit.functions import tails
from anchorkit.operators import compare as cp
from anchorkit.operators import metrics as me
from anchorkit.operators import models as mo
from anchorkit.operators import prep as pr
from anchorkit.operators.oversample import nearest_in_class, oversample
from anchorkit.operators.quality import check_prepared
from anchorkit.plans import clinical as cl
from anchorkit.plans import runs
from anchorkit.plans.retail import clinical_views
from anchorkit.session import scratch_path, shared_dir, staged
from anchorkit.sources import ingest, sinks, tables


def test_no_leakage(spark):
    train = spark.createDataFrame([(1.0, 1, 1), (3.0, 0, 0)], "age double, gender_male int, diag1_ch_1 int")
    test = spark.createDataFrame([(None, 0, 1)], "age double, gender_male int, diag1_ch_1 int")
    prep = pr.Preparation(scaling="none")
    with pytest.raises(RuntimeError):
        prep.transform(test)
    prep.fit(train)
    assert prep.transform(test).first().age == 2.0
    assert pr.FittedPreparation.from_json(prep.fitted.to_json()).apply(test).first().age == 2.0


def test_preparation_edges(spark):
    train = spark.createDataFrame([(1.0, 5.0, None, 1, None), (2.0, 5.0, None, 0, None), (None, 5.0, None, 0, None), (6.0, 5.0, None, 1, 2)],
                                  "age double, const double, empty double, tie int, cat int")
    cont = ["age", "const", "empty"]
    fit = pr.Preparation(scaling="standard", continuous=cont).fit(train)
    assert fit.fill == {"age": 2.0, "const": 5.0, "empty": 0.0, "tie": 0.0, "cat": 2.0}
    sd = math.sqrt(sum((v - 2.75) ** 2 for v in (1, 2, 2, 6)) / 4)
    assert fit.scale["age"] == pytest.approx(sd) and fit.scale["const"] == 1.0
    assert fit.outputs == ["age", "const", "empty", "tie", "cat"]
    low = pr.Preparation(scaling="minmax", continuous=cont).fit(train)
    assert [round(r.age, 6) for r in low.apply(train).collect()] == [0.0, 0.2, 0.2, 1.0]
    assert {r.const for r in low.apply(train).collect()} == {0.0}
    partial = low.apply(train.select("cat", F.lit("x").alias("age"), F.lit(9).alias("other")))
    assert partial.columns == fit.outputs and partial.first().age == 0.2
    mode = pr.Preparation(scaling="none", strategy="most_frequent", continuous=cont).fit(train)
    assert mode.fill["age"] == 1.0
    for bad in ({"scaling": "log"}, {"strategy": "random"}):
        with pytest.raises(ValueError):
            pr.Preparation(**bad)


@pytest.fixture(scope="module")
def thirty(spark):
    return spark.createDataFrame([(i, 20 + i, i % 2, [1, 4, 9][i % 3], math.log1p([1, 4, 9][i % 3]), i % 3) for i in range(30)],
                                 "stay_id long, age long, gender_male int, los_days int, los_log double, los_class int")


def test_split(spark, thirty):
    splits = pr.stratified_split(thirty)
    counts = {(r.los_class, r.split): r["count"] for r in splits.groupBy("los_class", "split").count().collect()}
    assert counts == {(k, s): n for k in range(3) for s, n in (("train", 7), ("val", 1), ("test", 2))}
    again = pr.stratified_split(thirty.orderBy(F.col("age").desc()).repartition(5))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, splits.collect()))
    path = scratch_path(spark, "split")
    with pytest.raises(FileNotFoundError):
        sinks.load_splits(spark, path)
    sinks.save_splits(splits, path)
    assert sinks.load_splits(spark, path).count() == 30
    frames = pr.prepare_splits(thirty, splits, pr.Preparation(), target="regression")
    assert frames["train"].columns == ["stay_id", "los_log", "age", "gender_male"]
    assert check_prepared(frames["train"].unionByName(frames["val"]), frames["test"], 0.2, ["age"]) == 0.2
    with pytest.raises(ValueError):
        pr.prepare_splits(thirty, splits, pr.Preparation(), target="ranking")
    with pytest.raises(KeyError):
        pr.prepare_splits(thirty.drop("los_class"), splits, pr.Preparation())
    with pytest.raises(ValueError):
        check_prepared(frames["train"], frames["train"], 0.2, ["age"])
    with pytest.raises(ValueError):
        check_prepared(frames["train"].withColumn("age", F.lit(None)), frames["test"], 0.2, ["age"])


def test_folds_caps_weights(spark, thirty):
    folds = pr.class_folds(thirty, key="stay_id", label="los_class")
    assert {r["count"] for r in folds.groupBy("los_class", "fold").count().collect()} == {2}
    few = thirty.where("stay_id < 7")  # classes of 3, 2 and 2 rows
    assert pr.class_folds(few, key="stay_id", label="los_class").agg(F.max("fold")).first()[0] == 1
    assert pr.class_folds(thirty.where("stay_id < 4"), key="stay_id", label="los_class") is None
    assert pr.plain_folds(thirty.limit(1), key="stay_id") is None
    assert pr.plain_folds(few, key="stay_id", folds=20).agg(F.max("fold")).first()[0] == 6
    capped = pr.capped_sample(thirty, 9, key="stay_id", label="los_class")
    assert {r["count"] for r in capped.groupBy("los_class").count().collect()} == {3}
    assert pr.capped_sample(thirty, 12, key="stay_id").count() == 12
    even = spark.range(20).select("id", (F.col("id") % 4).alias("c"))  # four classes of 5
    assert pr.capped_sample(even, 10, key="id", label="c").count() == 10
    rare = spark.range(1000).select("id", F.when(F.col("id") < 4, None).otherwise("x").alias("c"))
    found = {r.c: r["count"] for r in pr.capped_sample(rare, 100, key="id", label="c").groupBy("c").count().collect()}
    assert sum(found.values()) == 100 and found[None] >= 1
    assert pr.capped_sample(thirty, None, key="stay_id") is thirty and pr.capped_sample(thirty, 30, key="stay_id") is thirty
    w = {r.los_class: r.weight for r in pr.balanced_weights(few, "los_class").collect()}
    assert w == {0: pytest.approx(7 / 9), 1: pytest.approx(7 / 6), 2: pytest.approx(7 / 6)}
    assert pr.sample_rows(thirty, 5, key="stay_id").count() == 5


def test_nearest_with_copies_and_blocks(spark, monkeypatch):
    import random

    from anchorkit.operators import oversample as ov

    rnd = random.Random(2)
    monkeypatch.setattr(ov, "_BLOCK_ROWS", 16)
    pts = [(i, i % 2, [1.0, 2.0] if i % 3 == 0 else [float(rnd.randrange(9)), rnd.random()]) for i in range(90)]
    df = spark.createDataFrame(pts, "id long, k int, x array<double>")
    got = {r.id: r.neighbour for r in nearest_in_class(df, key="id", label="k", vector="x").collect()}
    for i, k, x in pts:
        best = min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, c, y in pts if c == k and j != i)
        assert got[i] == best[1]


def test_oversample(spark):
    pts = [(i, 0, [float(i), 0.0]) for i in range(11)] + [(100, 1, [0.0, 0.0]), (101, 1, [1.0, 1.0]), (102, 1, [9.0, 9.0])]
    df = spark.createDataFrame(pts, "id long, k int, x array<double>")
    made = oversample(df, key="id", label="k", vector="x").where("synthetic").collect()
    assert len(made) == 8 and {r.k for r in made} == {1}
    assert all(r.x[0] == pytest.approx(r.x[1]) and 0 <= r.x[0] <= 9 for r in made)  # on the line between neighbours
    alone = df.where("k = 0 or id = 100")
    assert oversample(alone, key="id", label="k", vector="x").where("synthetic").count() == 0


def test_tails():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.student_two_sided(0.0, 5) == pytest.approx(1.0)
    assert tails.sign_two_sided(8, 2) == pytest.approx(0.109375) and tails.sign_two_sided(5, 5) == 1.0
    assert tails.sign_two_sided(0, 10) == pytest.approx(2 / 1024)
    assert tails.signed_rank_exact(0, 5) == pytest.approx(2 / 32) and tails.signed_rank_exact(3, 6) == pytest.approx(10 / 64)
    big = tails.signed_rank_two_sided(500.0, 60, 0.0, 0)
    z = (500 - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24)
    assert big == pytest.approx(tails.normal_two_sided(z))
    assert tails.signed_rank_two_sided(10.0, 10, 0.0, 0) != tails.signed_rank_exact(10, 10)  # size doesn't choose the method


def test_paired_tests(spark):
    y, b, c = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [2.0, 2.5, 2.0, 5.5, 7.0, 6.25], [1.25, 2.25, 2.9, 4.5, 5.0, 6.5]
    df = spark.createDataFrame([("m", *t) for t in zip(y, b, c)], "model string, y double, b double, c double")
    got = cp.paired_tests(cp.paired_errors(df, "y", "b", "c"), ["model"]).first()
    d = [abs(p - q) - abs(p - r) for p, q, r in zip(y, b, c)]
    mean = sum(d) / 6
    sd = math.sqrt(sum((v - mean) ** 2 for v in d) / 5)
    assert got.paired_t_stat == pytest.approx(mean / sd * math.sqrt(6))
    assert got.paired_t_p == pytest.approx(tails.student_two_sided(got.paired_t_stat, 5))
    assert got.wilcoxon_stat == 1.5 and got.conclusion == "not_significant"
    same = df.withColumn("c", F.col("b"))
    flat = cp.paired_tests(cp.paired_errors(same, "y", "b", "c"), ["model"]).first()
    assert flat.wilcoxon_stat is None and flat.dm_stat is None and flat.paired_t_stat is None and flat.conclusion == "not_significant"
    many = spark.range(200).select(F.lit("m").alias("model"), F.lit(0.0).alias("y"), (F.col("id") + 2.0).alias("b"), (F.col("id") + 1.0).alias("c"))
    assert cp.paired_tests(cp.paired_errors(many, "y", "b", "c"), ["model"], n_models=5).first().conclusion == "candidate_improved"
    ungrouped = cp.paired_statistics(cp.paired_errors(df, "y", "b", "c"), []).first()
    assert ungrouped.wilcoxon_stat == 1.5


def test_metrics_edges(spark):
    df = spark.createDataFrame([(0, 0, .9, .1, .0), (0, 0, .8, .1, .1), (1, 0, .2, .7, .1)], "y int, p int, p0 double, p1 double, p2 double")
    m = me.classification_metrics(df, [], "y", "p").first()
    assert m["Medium-F1"] == 0 and m["Long-F1"] == 0 and m["Macro-F1"] == pytest.approx(0.4) and m["Kappa"] == 0
    assert me.macro_auc(df, [], {0: "p0", 1: "p1", 2: "p2"}, "y").first().AUC is None
    two = me.class_auc(df, [], {0: "p0", 1: "p1"}, "y")
    assert {r.label: r.auc for r in two.collect()} == {0: 1.0, 1: 1.0}
    low = spark.createDataFrame([(0.1, 0.2), (0.4, 0.1)], "y_true double, y_pred double")
    r = me.regression_metrics(low, []).first()
    assert r.MAPE is None and r.MedianAE == pytest.approx(0.2)


def test_delta_and_best(spark):
    b = spark.createDataFrame([("x", "s", 2.0, 0.0), ("y", "s", 1.0, None), ("z", "s", 0.5, 1.0)], "model string, stage string, MAE double, R2 double")
    c = spark.createDataFrame([("x", "s", 1.0, 0.5), ("y", "s", 3.0, 0.1)], "model string, stage string, MAE double, R2 double")
    got = {(r.model, r.metric): r for r in cp.delta_table(b, c, ["MAE", "R2"]).collect()}
    assert set(got) == {("x", "MAE"), ("x", "R2"), ("y", "MAE")}
    assert got["x", "MAE"].delta_pct == -50 and got["x", "MAE"].improved and got["x", "R2"].delta_pct is None
    assert cp.best_common_model(b, c).first().model == "y"


def test_macro_f1_and_predictions(spark):
    data = spark.createDataFrame([(i, float(i % 3), float(i % 3) * 2, float(i % 2)) for i in range(60)], "stay_id long, label double, a double, b double")
    vec = mo.assembled(data, ["a", "b"], ["stay_id", "label"])
    folds = mo.stage_folds(vec, "stage1", folds=3)
    model, best = mo.fit_best("random_forest", "stage1", vec, folds=folds,
                              grid={"n_estimators": [3, 5], "max_depth": [2, None], "min_samples_leaf": [1]})
    preds = mo.class_predictions(model, vec)
    assert best["n_estimators"] in (3, 5) and me.classification_metrics(preds, []).first()["Accuracy"] == 1.0
    table = mo.importances(model, ["a", "b"], 1).collect()
    assert [r.feature for r in table] == ["a"]
    with pytest.raises(KeyError):
        mo.base_estimator("unknown", "stage1")


def test_permutation_importance_finds_the_feature(spark):
    data = spark.createDataFrame([(i, float(i % 7) * 3, float(i % 7), float(i % 5)) for i in range(70)], "stay_id long, label double, a double, b double")
    vec = mo.assembled(data, ["a", "b"], ["stay_id", "label"])
    model, _ = mo.fit_best("linear_regression", "stage2", vec)
    got = {r.feature: r for r in mo.permutation_importance(model, vec, ["a", "b"], repeats=4, focus=["a"]).collect()}
    assert got["a"].importance_mean > 2 and abs(got["b"].importance_mean) < 1e-6 and got["a"].is_focus


def test_sources(spark, tmp_path):
    base = f"file://{tmp_path}"
    stays = spark.createDataFrame([(1, "2020-01-01 00:00:00", "x,\"y\"", "bad")], "stay_id long, intime string, note string, subject_id string")
    sinks.save_csv(stays, f"{base}/icustays.csv.gz", "gzip")
    cfg = merged({"data": {"source": "csv", "table_sources": {"patients": "parquet", "labevents": "postgresql", "odd": "mongo"},
                           "csv": {"base_path": base, "files": {"icustays": "icustays.csv", "admissions": "none.csv"}},
                           "parquet": {"base_path": base},
                           "postgresql": {"host": "h", "port": 1, "dbname": "d", "user": "u", "schema_hosp": "hosp", "schema_icu": "icu",
                                          "partitioning": {"labevents": {"column": "hadm_id", "lower": 1, "upper": 9}}}}})
    got = tables.load_table(spark, cfg, "icustays", ["stay_id", "intime", "note", "subject_id"]).first()
    assert got.intime == datetime(2020, 1, 1) and got.note == 'x,"y"' and got.subject_id is None
    spark.createDataFrame([(1,)], "subject_id long").write.parquet(f"{base}/patients.parquet")
    assert tables.load_table(spark, cfg, "patients").count() == 1
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, cfg, "admissions")
    with pytest.raises(KeyError):
        tables.load_table(spark, cfg, "chartevents")
    with pytest.raises(ValueError):
        tables.load_table(spark, cfg, "odd")
    options = tables.jdbc_options(cfg, "labevents")
    assert tables.ranged({"dbtable": "x"}, "k", None, None, 4) == {"dbtable": "x"}
    assert tables.ranged({"dbtable": "x"}, "k", 1, 90, 4)["numPartitions"] == "4"
    assert options["dbtable"] == "hosp.labevents" and options["partitionColumn"] == "hadm_id"
    assert tables.render_schemas("FROM a_icu.x JOIN b_a_icu.y", {"a_icu": "z"}) == "FROM z.x JOIN b_a_icu.y"


def test_append_items_empties_listed_items(spark):
    target = scratch_path(spark, "items")
    sinks.save_parquet(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "itemid int, v double"), target, ["itemid"])
    fresh = spark.createDataFrame([(2, 5.0, "new"), (3, 9.0, "new")], "itemid int, v double, extra string")
    out = ingest.append_items(fresh, target, [1, 2])
    assert sorted((r.itemid, r.v, r.extra) for r in out.collect()) == [(2, 5.0, "new"), (3, 3.0, None)]
    report = ingest.item_report(out, {"both": [2, 3], "gone": [1]})
    assert {r.label: r.n for r in report.collect()} == {"both": 2, "gone": 0}


def test_shared_dir_follows_the_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    else:
        assert shared_dir(spark) == shared_dir(spark)


def test_whole_comparison(spark, sf):
    """Extracts, both feature tables, both runs on one split, then the comparison."""
    root = scratch_path(spark, "runs")
    config = merged({"preparation": {"cv_folds": 2}, "cohort": {"max_los_days": 60, "first_only": False}})
    views = clinical_views(spark, sf)
    base, extended = runs.feature_tables(views, config, f"{root}/features", strict=False)
    assert base.count() == extended.count() and set(runs.pr.SEVERITY_FEATURES) <= set(extended.columns)
    splits = runs.shared_splits(base, f"{root}/splits", config)
    grids = {"random_forest": {"n_estimators": [3], "max_depth": [3], "min_samples_leaf": [1]}, "ridge": {"alpha": [1.0, 10.0]}}
    for run, table in (("baseline", base), ("extended", extended)):
        stored = runs.run_stages(table, splits, f"{root}/{run}", run, config, stage1=["random_forest"], stage2=["ridge"],
                                 grids1=grids, grids2=grids)
        assert stored["stage2"].first().MAE > 0 and stored["stage1"].first()["Accuracy"] > 0
    out = runs.compare_runs(f"{root}/baseline", f"{root}/extended", extended, f"{root}/comparison")
    assert set(out) == {"delta_metrics", "significance", "severity_strata", "class_ablation"}
    assert out["significance"].first().model == "ridge" and out["delta_metrics"].count() >= 11
    runs.describe(base.select("stay_id", "age", "gender_male", "heart_rate_mean", "los_days", "los_class"), f"{root}/tables")
    assert spark.read.option("header", True).csv(f"{root}/tables/correlations").count() >= 2


def test_extracts(spark, sf):
    config = merged()
    got = runs.extract_all(clinical_views(spark, sf), config, scratch_path(spark, "extracts"))
    assert set(got) == {"cohort", "diagnoses", "vitals", "labs", "severity", "occupancy"}
    assert got["severity"].count() == got["cohort"].count() == got["occupancy"].count()
    assert set(cl.I.VITAL_COLUMNS) <= set(got["vitals"].columns)


def test_missing_groups_and_labels_stay(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("g"),
                                 F.col("id").cast("double").alias("y"), (F.col("id") * 1.5).alias("p"))
    split = pr.stratified_split(df, key="id", label="g")
    assert split.count() == 100 and split.where("g is null and split = 'test'").count() == 5
    assert pr.balanced_weights(df, "g").where("g is null").count() == 25
    assert pr.class_folds(df, key="id", label="g").count() == 100
    found = {r.g: r.MedianAE for r in me.regression_metrics(df, ["g"], "y", "p").collect()}
    assert set(found) == {None, "1", "2", "3"} and found[None] == 24.0
    tested = cp.paired_statistics(cp.paired_errors(df.withColumn("c", F.col("y") + 1), "y", "p", "c"), ["g"])
    assert tested.where("g is null and wilcoxon_stat is not null").count() == 1
    flat = df.select("g", F.lit(2.0).alias("y"), F.lit(2.0).alias("p"), F.lit(3.0).alias("q"))
    assert {r.R2 for r in me.regression_metrics(flat, [], "y", "p").collect()} == {1.0}
    assert {r.R2 for r in me.regression_metrics(flat, [], "y", "q").collect()} == {0.0}


def test_pruned_neighbours(spark):
    """Exact in every layout: many pivots, crowded shells, copies, a null class, a null vector, visits in chunks."""
    from anchorkit.operators.neighbours import nearest_neighbours

    rnd = random.Random(5)
    points = []
    for i in range(1200):
        centre = rnd.randrange(6) * 10.0
        x = [centre + rnd.random(), centre - rnd.random(), float(rnd.randrange(3))]
        points.append((i, rnd.choice(["a", "a", "a", "b", None]), [7.0, 7.0, 7.0] if i % 10 == 0 else x))
    points += [(5000 + i, "grid", [float(i % 8), float(i // 8 % 8), float(i // 64)]) for i in range(512)]
    points += [(7000, "alone", [1.0, 1.0, 1.0]), (7001, "a", None)]
    df = spark.createDataFrame(points, "id long, k string, x array<double>")
    for block_rows in (8, 64, 4096):
        found, stats = nearest_neighbours(df, key="id", label="k", vector="x", block_rows=block_rows)
        got = {r.id: r.neighbour for r in found.collect()}
        for i, k, x in points:
            others = [(sum((b - a) ** 2 for a, b in zip(x, y)), j) for j, c, y in points if c == k and j != i and y is not None and x is not None]
            assert got.get(i) == (min(others)[1] if others else None)
        assert stats["visits"] <= stats["all_visits"]
    assert nearest_neighbours(df.limit(0), key="id", label="k", vector="x")[0].count() == 0


def test_pruning_on_clustered_points_grows_slowly(spark):
    """Pairs compared in visits grow far slower than the square of the points on clustered data."""
    from anchorkit.operators.neighbours import nearest_neighbours

    def pairs(n):
        rng = np.random.default_rng(n)
        centres = rng.normal(0, 50, (12, 2))
        x = centres[rng.integers(0, 12, n)] + rng.normal(0, 1, (n, 2))
        df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, k int, x array<double>")
        stats = nearest_neighbours(df, key="id", label="k", vector="x", block_rows=128)[1]
        print(n, stats)
        return stats["visits"] * stats["points"] / stats["blocks"]

    assert pairs(24_000) < 0.5 * 9 * pairs(8000)


def test_oversample_fills_a_missing_class(spark):
    pts = [(i, "a", [float(i), 0.0]) for i in range(20)] + [(100 + i, "b", [float(i), 1.0]) for i in range(5)]
    pts += [(200 + i, None, [float(i), 2.0]) for i in range(6)]
    df = spark.createDataFrame(pts, "id long, k string, x array<double>")
    made = {r.k: r["count"] for r in oversample(df, key="id", label="k", vector="x").where("synthetic").groupBy("k").count().collect()}
    assert made == {"b": 15, None: 14}


def test_moments_merge_and_fit(spark):
    from anchorkit.operators import least_squares as ls

    rng = np.random.default_rng(1)
    x = rng.normal(1e4, 3, (400, 3))
    x[:, 2] = x[:, 0] - x[:, 1]  # dependent columns have a least-norm fit
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(0, 0.1, 400)
    one, rest = ls.Moments.of(np.column_stack([x, y])[:150]), ls.Moments.of(np.column_stack([x, y])[150:])
    whole = one.plus(rest)
    centred = x - x.mean(axis=0)
    assert np.allclose(whole.co[:-1, :-1], centred.T @ centred, rtol=1e-9)
    b = whole.fit()
    assert np.abs(x @ b[:-1] + b[-1] - y).mean() < 0.1
    ridge = whole.fit(50.0)
    assert np.allclose(ridge[:-1], np.linalg.solve(centred.T @ centred + 50 * np.eye(3), centred.T @ (y - y.mean())))
    rows = [(int(i % 4), float(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (1, None, 0.0, 0.0, 0.0)], "fold int, label double, a double, b double, c double").repartition(7)
    data = mo.assembled(df, ["a", "b", "c"], ["label", "fold"])
    scores = ls.fold_scores(data, [50.0])[0]
    fold = np.arange(400) % 4
    for f, found in enumerate(scores):
        train, held = fold != f, fold == f
        m, my = x[train].mean(axis=0), y[train].mean()
        c = x[train] - m
        b = np.linalg.solve(c.T @ c + 50 * np.eye(3), c.T @ (y[train] - my))
        miss = my + (x[held] - m) @ b - y[held]
        assert found["mae"] == pytest.approx(np.abs(miss).mean()) and found["r2"] == pytest.approx(1 - (miss ** 2).mean() / y[held].var())


def test_refused_settings_are_told_and_failures_are_not_hidden(spark):
    rows = spark.createDataFrame([(i, float(i % 2), float(i % 2 + i % 3)) for i in range(40)], "stay_id long, label double, x double")
    data = mo.assembled(rows, ["x"], ["stay_id", "label"])
    folds = mo.stage_folds(data, "stage1", folds=2)
    refused = []
    _, best = mo.fit_best("random_forest", "stage1", data, folds=folds, left_out=refused,
                          grid={"n_estimators": [2], "max_depth": [2, 99], "min_samples_leaf": [1]})
    assert best["max_depth"] == 2 and [p["max_depth"] for p in refused] == [99]
    broken = data.withColumn("label", F.when(F.col("stay_id") == 7, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("label")))
    with pytest.raises(Exception, match="lost"):
        mo.fit_best("random_forest", "stage1", broken, folds=folds, shape=(40, 1.0, 1),
                    grid={"n_estimators": [2, 3], "max_depth": [2], "min_samples_leaf": [1]})


def test_margin_model_survives_saving(spark):
    from anchorkit.operators.calibrate import MarginModel

    rows = spark.createDataFrame([(i, float(i % 3), float(i % 3 == 1), float(i % 3 == 2)) for i in range(60)], "stay_id long, label double, a double, b double")
    data = staged(mo.assembled(rows.coalesce(1), ["a", "b"], ["stay_id", "label"]))
    model, point = mo.fit_best("svm", "stage1", data, grid={"C": [0.1]})
    model = mo.with_probabilities("svm", model, data, point, calibrate=False)
    path = scratch_path(spark, "margin-model")
    mo.save_model(model, path)
    both = [mo.class_predictions(m, data).orderBy("stay_id").collect() for m in (model, MarginModel.load(path))]
    assert both[0] == both[1] and all(r.y_true == r.y_pred and r[f"p{r.y_true}"] > 0.4 for r in both[0])
    forest, _ = mo.fit_best("random_forest", "stage1", data, grid={"n_estimators": [1], "max_depth": [2], "min_samples_leaf": [1]})
    assert mo.with_probabilities("random_forest", forest, data, {}) is forest


def test_unused_features_have_no_importance(spark):
    rows = spark.createDataFrame([(i, float(i % 5), float(i % 5), float(i * 7 % 11)) for i in range(200)], "stay_id long, label double, a double, b double")
    data = mo.assembled(rows, ["a", "b"], ["stay_id", "label"])
    forest, _ = mo.fit_best("random_forest", "stage2", data, grid={"n_estimators": [1], "max_depth": [4], "min_samples_leaf": [1]})
    found = {r.feature: (r.importance_mean, r.importance_std) for r in mo.permutation_importance(forest, data, ["a", "b"], repeats=3).collect()}
    assert found["a"][0] > 0.5 and (found["b"] == (0.0, 0.0) or 1 in mo.used_features(forest, 2))
    assert mo.used_features(forest, 2)[0] == 0


def test_broken_append_leaves_the_old_table(spark, monkeypatch):
    """Readers see a whole version at every step, also after a call that broke off before its manifest."""
    from anchorkit.sources import files

    target = scratch_path(spark, "items")
    first = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "itemid int, v double")
    ingest.append_items(first, target, [1, 2, 3])
    old = ingest.read_items(spark, target)
    fresh = spark.createDataFrame([(2, 9.0, "new")], "itemid int, v double, extra string")
    with monkeypatch.context() as patch:
        patch.setattr(files, "publish_text", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            ingest.append_items(fresh, target, [1, 2])
    values = lambda df: sorted((r.itemid, r.v) for r in df.collect())
    assert values(ingest.read_items(spark, target)) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    # another call publishes first: ours builds on it
    real, raced = files.publish_text, []

    def race(spark_, path, text):
        if not raced:
            raced.append(path)
            ingest.append_items(spark.createDataFrame([(3, 30.0)], "itemid int, v double"), target, [3])
        return real(spark_, path, text)

    with monkeypatch.context() as patch:
        patch.setattr(files, "publish_text", race)
        out = ingest.append_items(fresh, target, [1, 2])
    assert values(out) == [(2, 9.0), (3, 30.0)] and values(old) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert ingest.drop_old_items(spark, target) >= 4 and values(ingest.read_items(spark, target)) == [(2, 9.0), (3, 30.0)]
    emptied = ingest.append_items(first.limit(0), target, [2, 3])
    assert emptied.count() == 0 and {"itemid", "v", "extra"} <= set(emptied.columns)


def test_cached_table_follows_settings_and_files(spark):
    path, source, built = scratch_path(spark, "cached"), scratch_path(spark, "source"), []

    def table(settings):
        data = spark.read.parquet(source)
        return sinks.cached(spark, path, lambda: built.append(settings) or data.withColumn("s", F.lit(settings)), settings, [data]).count()

    spark.range(5).write.parquet(source)
    assert [table("a"), table("a"), table("b"), table("b")] == [5, 5, 5, 5] and built == ["a", "b"]
    spark.range(3).write.mode("append").parquet(source)
    assert table("b") == 8 and built == ["a", "b", "b"]


def test_sparse_levels(spark):
    from anchorkit.operators.encode import MOST_LEVELS, level_table, levels_of, sparse_one_hot

    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "b")], "id int, k string")
    out = {r.id: (r.level, r.hot.size, list(r.hot.indices)) for r in sparse_one_hot(df, "k").collect()}
    assert out == {1: (1, 2, [0]), 2: (0, 2, []), 3: (None, 2, []), 4: (2, 2, [1]), 5: (1, 2, [0])}
    fitted = level_table(df.where("k <> 'c'"), "k")
    out = {r.id: (r.level, list(r.hot.indices)) for r in sparse_one_hot(df, "k", fitted, drop_first=False).collect()}
    assert out == {1: (1, [1]), 2: (0, [0]), 3: (None, []), 4: (None, []), 5: (1, [1])}
    with pytest.raises(ValueError, match="sparse_one_hot"):
        levels_of(spark.range(MOST_LEVELS + 5), "id")


@pytest.mark.parametrize("cell_rows", [100_000, 12])
def test_permuted_pairs_match_ranks_and_shuffle_rows_once(spark, monkeypatch, cell_rows):
    """Rows of equal rank in two orders by hash, whatever the cells; a repeated key stands for all its rows, a null key is left out."""
    import hashlib
    from collections import Counter

    from anchorkit.operators import pairing

    monkeypatch.setattr(pairing, "CELL_ROWS", cell_rows)
    rows = [(i, float(i), [float(i), 2.0]) for i in range(60)] + [(7, 100.0, [100.0, 3.0]), (None, 200.0, [200.0, 4.0])]
    scored = spark.createDataFrame(rows, "k long, y double, x array<double>")
    out = pairing.permuted_pairs(scored, "k", ["y", "x"], "x", 3, 42, len(rows))
    expected = Counter()
    for r in range(3):
        order = [sorted(rows, key=lambda v: hashlib.md5(":".join(map(str, [42, tag, r, *([v[0]] if v[0] is not None else [])])).encode()).hexdigest())
                 for tag in ("own", "donor")]
        for a, b in zip(*order):
            expected.update((r, own[1], don[2][0]) for own in rows for don in rows if own[0] == a[0] and don[0] == b[0] and None not in (a[0], b[0]))
    assert Counter((r.repeat, r.y, r._d[0]) for r in out.collect()) == expected
    assert out.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_extracts_are_packed_tightly(spark, tmp_path):
    """Times of minutes as microseconds: far less is written than by the default codec, and the rows come back."""
    rows = spark.range(200_000).selectExpr("id % 1000 AS stay_id", "timestamp_micros((id * 7919 % 100000) * 60000000) AS charttime")
    folder = f"file://{tmp_path}"
    stored = sinks.save_extracts({"a": rows}, f"{folder}/extracts")["a"]
    sinks.save_parquet(rows, f"{folder}/plain")
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).rglob("*.parquet"))
    assert size("extracts") < 0.8 * size("plain")
    assert stored.exceptAll(rows).isEmpty() and stored.count() == 200_000
