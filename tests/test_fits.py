"""Fits whose number of passes depends neither on the scale of the data nor on the number of folds."""

import math
import threading

import pytest
from pyspark.sql import functions as F

from anchorkit.operators import calibrate as ca
from anchorkit.operators import prep as pr


@pytest.mark.parametrize("spread, centre", [(1.0, 0.0), (1e-6, -1.0), (1e6, 3e6)])
def test_sigmoids_take_few_steps_whatever_the_scale_of_the_margins(spark, spread, centre):
    """Over two margins the fitted probability of each is the mean of what is wanted there."""
    rows = [(k % 2, int(k % 10 < (3 if k % 2 else 8))) for k in range(1, 401)]
    df = spark.createDataFrame([(hit, [centre + spread * side] * 2) for side, hit in rows], "label int, margins array<double>")
    hits = sum(hit for _, hit in rows)
    a, b = ca.fit_sigmoids(df, 2, steps=8)[1]
    for side in (0, 1):
        wanted = [(hits + 1) / (hits + 2) if hit else 1 / (len(rows) - hits + 2) for s, hit in rows if s == side]
        found = 1 / (1 + math.exp(-(a * (centre + spread * side) + b)))
        assert found == pytest.approx(sum(wanted) / len(wanted), abs=1e-8)


def test_sigmoids_of_margins_without_spread_or_value(spark):
    same = spark.createDataFrame([(k % 2, [2.5, 2.5]) for k in range(20)], "label int, margins array<double>")
    assert all(1 / (1 + math.exp(-(a * 2.5 + b))) == pytest.approx(0.5, abs=1e-6) for a, b in ca.fit_sigmoids(same, 2))
    assert ca._scale(None, None) == ca._scale(float("nan"), 1.0) == ca._scale(1.0, float("inf")) == (0.0, 1.0)
    assert ca.fit_sigmoids(same.where("label > 5"), 2) == [(0.0, 0.0)] * 2


def test_fits_run_two_at_a_time(spark):
    from anchorkit.catalog.learning import _side_by_side

    meet = threading.Barrier(2, timeout=120)

    def one(name):
        meet.wait()  # breaks when one fit waits for the other's end
        return spark.createDataFrame([(name,)], "model string")

    assert sorted(r.model for r in _side_by_side(reversed({"a": 1, "b": 2, "c": 3, "d": 4}), one).collect()) == ["a", "b", "c", "d"]


def test_an_svm_goes_over_each_kind_of_row_once_a_pass(spark, monkeypatch):
    """Flags repeat: a fit over the kinds with their sizes finds what the fit over all rows finds."""
    from pyspark.ml.functions import vector_to_array

    from anchorkit.operators import models as mo

    rows = [(i, float(i % 2), float(i // 2 % 2), 1.0 if i % 2 else 2.0 if i // 2 % 2 else 0.0) for i in range(800)]
    df = mo.assembled(spark.createDataFrame(rows, "key long, a double, b double, label double"), ["a", "b"], ["key", "label"])
    merged, size = mo.merged_rows(df, "label", None, 800)
    assert size == "_size" and {(r.label, *r.x, r["_size"]) for r in merged.withColumn("x", vector_to_array("features")).collect()} == {
        (0.0, 0.0, 0.0, 200.0), (1.0, 1.0, 0.0, 200.0), (2.0, 0.0, 1.0, 200.0), (1.0, 1.0, 1.0, 200.0)}
    halves, size = mo.merged_rows(df.withColumn("w", F.lit(0.5)), "label", "w", 800)
    assert {r[size] for r in halves.collect()} == {100.0}
    assert mo.merged_rows(df, "label", "w", 30) == (df, "w")  # too few rows of a kind: nothing is merged

    seen = []
    real = mo.OneVsRest.fit
    monkeypatch.setattr(mo.OneVsRest, "fit", lambda self, data, params=None: seen.append(data.count()) or real(self, data, params))
    model, _ = mo.fit_best("svm", "stage1", df, key="key", grid={"C": [0.01]})
    assert seen == [4]
    assert model.transform(df).where("prediction <> label").count() == 0


def test_fold_weights_are_the_balanced_ones_without_a_join(spark):
    rows = [(i, None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(i % 3 % 2), i % 7 % 3) for i in range(200)]
    df = spark.createDataFrame([*rows, (500, 7.0, 1), (501, 1.0, None)], "key long, label double, fold int").withColumn("weight", F.lit(9.0))
    parts = pr.fold_weights(df, 3, "label")
    assert len(parts) == 3
    for held, part in enumerate(parts):
        wanted = pr.balanced_weights(df.drop("weight").where(F.col("fold") != held), "label")
        assert {(r.key, r.weight) for r in part.collect()} == {(r.key, r.weight) for r in wanted.collect()}
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


def _numbers(text):
    import re

    found = re.compile(r"-?\d+\.\d+(?:E-?\d+)?")
    return found.sub("#", text), [float(x) for x in found.findall(text)]


def _wide_rows(spark, n):
    """Ties, zeros, a constant, few and many values, weights."""
    rows = [(i, float(i * 37 % 101 - 50) / 7, float(i % 3), 0.0, float(i * i % 997), [0.5, 1.0, 2.5][i % 3], math.sin(i) + (i * 37 % 101 > 60)) for i in range(n)]
    from anchorkit.operators import models as mo

    df = spark.createDataFrame(rows, "key long, a double, b double, c double, d double, weight double, label double").repartition(3, "key")
    return mo.assembled(df.withColumn("hit", (F.col("label") > 0.7).cast("double")), ["a", "b", "c", "d"], ["key", "label", "hit", "weight"])


@pytest.mark.parametrize("rows, settings", [(10_500, {"featureSubsetStrategy": "0.8", "subsamplingRate": 0.8}), (700, {"subsamplingRate": 1.0})])
def test_boosted_trees_from_blocks_are_those_of_mllib(spark, monkeypatch, rows, settings):
    """More rows than the bins are made of, rows and columns drawn: the same splits and leaves, whatever the loss."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    from anchorkit.operators import boosted as bo
    from anchorkit.session import staged

    monkeypatch.setattr(bo._Boosted, "least_rows", 0)
    monkeypatch.setattr(bo, "KEPT_TREES", 2)
    df = staged(_wide_rows(spark, rows))
    same = {"maxIter": 3, "maxDepth": 3, "seed": 42, "stepSize": 0.3, **settings}
    passes = []
    real = bo.summed
    monkeypatch.setattr(bo, "summed", lambda *a: passes.append(1) or real(*a))
    for ours, theirs, own in ((bo.BlockGBTRegressor, GBTRegressor, {}), (bo.BlockGBTClassifier, GBTClassifier, {"labelCol": "hit", "weightCol": "weight"})):
        passes.clear()
        found, wanted = ours(**same, **own).fit(df), theirs(**same, **own).fit(df)
        assert 0 < len(passes) <= 3 * 3  # a pass for each level of each tree
        (text, values), (text_wanted, values_wanted) = (_numbers(m.toDebugString.split("\n", 1)[1]) for m in (found, wanted))
        assert text == text_wanted and values == pytest.approx(values_wanted, rel=1e-9, abs=1e-12)
        assert found.featureImportances.toArray() == pytest.approx(wanted.featureImportances.toArray())
        assert [found.getMaxDepth(), found.getStepSize(), found.numFeatures] == [3, 0.3, 4]
        joined = found.transform(df).select("key", F.col("prediction").alias("p")).join(wanted.transform(df), "key")
        assert joined.where("abs(p - prediction) > 1e-9").count() == 0


def test_one_vs_rest_and_stored_models_hold_trees_from_blocks(spark, monkeypatch, tmp_path):
    from pyspark.ml.classification import OneVsRestModel

    from anchorkit.operators import boosted as bo
    from anchorkit.operators import models as mo

    monkeypatch.setattr(bo._Boosted, "least_rows", 0)
    df = _wide_rows(spark, 600).withColumn("label", (F.col("key") % 3).cast("double"))
    model, point = mo.fit_best("boosting", "stage1", df, key="key", weight="weight",
                               grid={"n_estimators": [2], "max_depth": [2], "learning_rate": [0.1], "subsample": [0.8]})
    mo.save_model(model, f"{tmp_path}/model")
    back = OneVsRestModel.load(f"{tmp_path}/model")
    found, again = ({(r.key, r.prediction) for r in m.transform(df).select("key", "prediction").collect()} for m in (model, back))
    assert found == again and len(found) == 600
    # b is the remainder of the key by three
    assert {(r.key, r.prediction) for r in model.transform(df).collect()} == {(k, float(k % 3)) for k in range(600)}


def test_boosted_trees_without_a_split_or_with_bad_rows(spark, monkeypatch):
    from anchorkit.operators import boosted as bo
    from anchorkit.operators import models as mo

    monkeypatch.setattr(bo._Boosted, "least_rows", 0)
    flat = mo.assembled(spark.createDataFrame([(i, 1.0, 4.0) for i in range(20)], "key long, a double, label double"), ["a"], ["key", "label"])
    assert {r.prediction for r in bo.BlockGBTRegressor(maxIter=2, seed=1).fit(flat).transform(flat).collect()} == {4.0}
    with pytest.raises(Exception, match="finite"):
        bo.BlockGBTRegressor(maxIter=2, seed=1).fit(flat.withColumn("label", F.when(F.col("key") != 3, F.col("label"))))


def test_sums_of_many_tasks_are_merged_before_the_driver(spark, monkeypatch):
    import numpy as np

    from anchorkit.operators import boosted as bo

    df = spark.range(0, 1000, 1, 9).select(F.col("id").cast("int").alias("n"))
    task = lambda rows: np.array([[float(sum(r["n"] for r in rows)), 1.0]])
    assert bo.summed(df, task).tolist() == [[499500.0, 9.0]]
    monkeypatch.setattr(bo, "_DIRECT_TASKS", 4)
    assert bo.summed(df, task).tolist() == [[499500.0, 9.0]]


def test_a_perceptron_from_blocks_is_that_of_mllib(spark, monkeypatch):
    """Short stacks of each partition included; one pass a step, nearly."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    from anchorkit.operators import perceptron as pe
    from anchorkit.session import staged

    monkeypatch.setattr(pe.BlockPerceptron, "least_rows", 0)
    monkeypatch.setattr(pe, "_STACKS", 1)
    passes = []
    real = pe.summed
    monkeypatch.setattr(pe, "summed", lambda *a: passes.append(1) or real(*a))
    df = staged(_wide_rows(spark, 700).withColumn("label", (F.col("key") % 3).cast("double")))
    same = {"layers": [4, 5, 4, 3], "maxIter": 15, "seed": 42}
    found, wanted = pe.BlockPerceptron(**same).fit(df), MultilayerPerceptronClassifier(**same).fit(df)
    assert 15 < len(passes) < 25
    assert found.weights.toArray() == pytest.approx(wanted.weights.toArray(), rel=1e-7, abs=1e-9)
    assert found.getMaxIter() == 15
    joined = found.transform(df).select("key", F.col("prediction").alias("p")).join(wanted.transform(df), "key")
    assert joined.where("p <> prediction").count() == 0
    with pytest.raises(Exception, match="whole numbers"):
        pe.BlockPerceptron(**same).fit(df.withColumn("label", F.lit(5.0)))


def test_descent_ends_where_values_or_slopes_settle():
    import numpy as np

    from anchorkit.operators import perceptron as pe

    seen = []

    def bowl(x):
        seen.append(1)
        return float(((x - 3.0) ** 4).sum() + 1.0), 4 * (x - 3.0) ** 3

    assert np.abs(pe.minimised(bowl, np.zeros(3), 500, 1e-6) - 3.0).max() < 0.05 and len(seen) < 100
    assert pe.minimised(bowl, np.zeros(3), 0, 1e-6).tolist() == [0.0] * 3
    settled = np.full(3, 3.0)
    assert pe.minimised(bowl, settled, 500, 1e-6).tolist() == settled.tolist()
