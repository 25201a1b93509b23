"""Class probabilities of one-vs-rest margin models.

A margin becomes a probability by a sigmoid per class, and the classes' values are divided by their
sum. Boosted trees minimise the logistic loss, so their own sigmoid is known; a support vector
machine's is fitted on margins of rows that its model hasn't seen (folds), by Newton steps that are one
aggregation over the margins for all classes together.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorkit.session import staged

#: The logistic loss of boosted trees is that of twice the margin.
BOOSTED = (2.0, 0.0)


def margins(model: OneVsRestModel, data: DataFrame, out: str = "margins") -> DataFrame:
    """``data`` plus the array of the binary models' margins, one model after the other in the JVM."""
    columns = []
    for k, binary in enumerate(model.models):
        own = binary.copy().setRawPredictionCol(f"_raw{k}").setPredictionCol(f"_pred{k}")
        if own.hasParam("probabilityCol"):
            own = own.setProbabilityCol("")
        data = own.transform(data)
        columns.append(vector_to_array(F.col(f"_raw{k}"))[1])
    drop = [f"_raw{k}" for k in range(len(columns))] + [f"_pred{k}" for k in range(len(columns))]
    return data.withColumn(out, F.array(*columns)).drop(*drop)


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _scale(mean: float | None, sd: float | None) -> tuple[float, float]:
    """Centre and spread of a class's margins; those that differ by rounding only, or aren't finite, stay as they are."""
    if mean is None or sd is None or not math.isfinite(mean) or not math.isfinite(sd) or sd <= 1e-12 * max(1.0, abs(mean)):
        return 0.0, 1.0
    return float(mean), float(sd)


def fit_sigmoids(rows: DataFrame, classes: int, label: str = "label", margin: str = "margins", steps: int = 100) -> list[tuple[float, float]]:
    """(slope, intercept) per class of the sigmoid that makes the margins of ``rows`` most likely.

    The wanted probabilities of class k are (n + 1) / (n + 2) for its n rows and 1 / (m + 2) for the m others, which
    keeps separable margins finite. Newton steps with halving; each is one aggregation of a few sums. They run on margins
    brought to mean zero and spread one, so their number depends neither on the margins' scale nor on the rows.
    Rows without a label are left out.
    """
    known = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(margin).alias("m"))
    sizes = known.agg(F.count(F.lit(1)).alias("n"), *[e for k in range(classes) for e in (
        F.count_if(F.col("y") == k).alias(f"p{k}"), F.avg(F.col("m")[k]).alias(f"m{k}"), F.stddev_pop(F.col("m")[k]).alias(f"d{k}"))]).first()
    if not sizes["n"]:
        return [(0.0, 0.0)] * classes
    n = sizes["n"]
    scales = [_scale(sizes[f"m{k}"], sizes[f"d{k}"]) for k in range(classes)]
    hits = [sizes[f"p{k}"] for k in range(classes)]
    wanted = [F.when(F.col("y") == k, (hits[k] + 1.0) / (hits[k] + 2.0)).otherwise(1.0 / (n - hits[k] + 2.0)) for k in range(classes)]

    def sums(at: list[tuple[float, float]]) -> list[list[float]]:
        """Loss, gradient and second derivatives of each class at its point."""
        parts = []
        for k, (a, b) in enumerate(at):
            m = (F.col("m")[k] - F.lit(scales[k][0])) / F.lit(scales[k][1])
            z = F.lit(a) * m + F.lit(b)
            p, t = _sigmoid(z), wanted[k]
            loss = F.greatest(z, F.lit(0.0)) - t * z + F.log1p(F.exp(-F.abs(z)))
            parts += [loss, (p - t) * m, p - t, p * (1 - p) * m * m, p * (1 - p) * m, p * (1 - p)]
        row = known.agg(*[F.avg(x).alias(f"s{i}") for i, x in enumerate(parts)]).first()
        return [[row[f"s{6 * k + i}"] for i in range(6)] for k in range(len(at))]

    points = [(0.0, math.log((h + 1.0) / (n - h + 1.0))) for h in hits]
    state = sums(points)
    for _ in range(steps):
        moves = []
        for _, ga, gb, haa, hab, hbb in state:
            haa, hbb = haa + 1e-12, hbb + 1e-12
            d = haa * hbb - hab * hab
            moves.append(((hbb * ga - hab * gb) / d, (haa * gb - hab * ga) / d) if d > 0 else (ga / haa, gb / hbb))
        # what the steps can still gain
        if all(abs(ga) + abs(gb) < 1e-11 or da * ga + db * gb < 1e-18 for (_, ga, gb, *_), (da, db) in zip(state, moves)):
            break
        size = [1.0] * classes
        for _ in range(30):
            trial = [(a - s * da, b - s * db) for (a, b), (da, db), s in zip(points, moves, size)]
            found = sums(trial)
            worse = [k for k in range(classes) if found[k][0] > state[k][0] + 1e-15]
            if not worse:
                break
            size = [s / 2 if k in worse else s for k, s in enumerate(size)]
        else:
            break
        moved = max(abs(x - y) for p, q in zip(points, trial) for x, y in zip(p, q))
        points, state = trial, found
        if moved < 1e-12:
            break
    return [(a / sd, b - a * mean / sd) for (a, b), (mean, sd) in zip(points, scales)]


class MarginModel:
    """A one-vs-rest model whose predictions carry ``probability`` (vector) besides ``prediction`` (largest margin)."""

    def __init__(self, model: OneVsRestModel, sigmoids: list[tuple[float, float]]):
        self.model, self.sigmoids = model, [tuple(map(float, s)) for s in sigmoids]

    def transform(self, data: DataFrame) -> DataFrame:
        scored = margins(self.model, data, "_margins")
        each = F.array(*[_sigmoid(F.lit(a) * F.col("_margins")[k] + F.lit(b)) for k, (a, b) in enumerate(self.sigmoids)])
        scored = scored.withColumn("_each", each).withColumn("_sum", F.aggregate("_each", F.lit(0.0), lambda s, x: s + x))
        share = F.when(F.col("_sum") > 0, F.transform("_each", lambda x: x / F.col("_sum"))).otherwise(
            F.transform("_each", lambda x: F.lit(1.0 / len(self.sigmoids))))
        best = (F.array_position("_margins", F.array_max("_margins")) - 1).cast("double")
        return scored.withColumns({"probability": array_to_vector(share), "prediction": best}).drop("_margins", "_each", "_sum")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        _session().createDataFrame([(json.dumps(self.sigmoids),)], "sigmoids string").coalesce(1).write.mode("overwrite").text(f"{path}/sigmoids")

    @staticmethod
    def load(path: str) -> MarginModel:
        found = _session().read.text(f"{path}/sigmoids").first()[0]
        return MarginModel(OneVsRestModel.load(f"{path}/model"), json.loads(found))


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def out_of_fold_margins(data: DataFrame, folds: DataFrame, fit: Callable[[DataFrame], OneVsRestModel], key: str, label: str = "label") -> DataFrame:
    """(label, margins) of every row by the model that ``fit`` makes of the other folds; a written table."""
    joined = staged(data.join(folds.select(key, "fold"), key), "calibration")
    numbers = range((joined.agg(F.max("fold")).first()[0] or 0) + 1)
    with ThreadPoolExecutor(len(numbers)) as pool:  # a fit is many small jobs in a row: folds fill each other's gaps
        models = list(pool.map(lambda f: fit(joined.where(F.col("fold") != f).drop("fold")), numbers))
    scored = [margins(m, joined.where(F.col("fold") == f)).select(label, "margins") for f, m in zip(numbers, models)]
    return staged(reduce(DataFrame.unionByName, scored), "margins")
