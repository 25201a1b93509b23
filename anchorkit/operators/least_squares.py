"""Least squares and ridge from moments: one pass gathers them, one pass scores every fit.

A group's moments (rows, means, sums of products around the means) merge exactly, so a training set
without one fold is the merge of the other folds, a growing part is a running merge, and every
penalty is a small linear system. However many folds, shares and penalties there are, the rows are
read twice: for the moments, and for the errors of all fits at once (an absolute error is not a function
of moments).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of tasks whose moments are merged before the last merge.
_MERGE_WIDTH = 64
_STATE = "grp int, n long, mean array<double>, co array<double>"


@dataclass(frozen=True)
class Moments:
    """Rows, means and sums of products around the means of features and label (last)."""

    n: int
    mean: np.ndarray
    co: np.ndarray

    @staticmethod
    def of(z: np.ndarray) -> Moments:
        mean = z.mean(axis=0)
        centred = z - mean
        return Moments(len(z), mean, centred.T @ centred)

    def plus(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        step = other.mean - self.mean
        return Moments(n, self.mean + step * (other.n / n), self.co + other.co + np.outer(step, step) * (self.n * other.n / n))

    def fit(self, alpha: float = 0.0) -> np.ndarray:
        """Coefficients and intercept that minimise squared errors + alpha * squared coefficients (least norm when not unique)."""
        gram, cross = self.co[:-1, :-1], self.co[:-1, -1]
        if alpha > 0:
            b = np.linalg.solve(gram + alpha * np.eye(len(gram)), cross)
        else:
            # columns on one scale, so that small ones are not taken for dependent ones
            scale = np.sqrt(np.diag(gram))
            scale[scale == 0] = 1.0
            b = np.linalg.lstsq(gram / np.outer(scale, scale), cross / scale, rcond=1e-10)[0] / scale
        return np.append(b, self.mean[-1] - b @ self.mean[:-1])


def merged(parts: list[Moments]) -> Moments:
    return reduce(Moments.plus, parts)


def _state_rows(states: dict[int, Moments], names: list[str], extra: list | None = None) -> pa.RecordBatch:
    arrays = [pa.array(list(states), pa.int32()), pa.array([s.n for s in states.values()], pa.int64()),
              pa.array([s.mean for s in states.values()], pa.list_(pa.float64())),
              pa.array([s.co.reshape(-1) for s in states.values()], pa.list_(pa.float64()))]
    if extra is not None:
        arrays.append(pa.array(extra, pa.int32()))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    y = batch.column("y").to_numpy(zero_copy_only=False)
    return np.column_stack([x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), y])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments of each group among a task's rows; a row counts in every group that ``groups`` lists."""
    from pyspark import TaskContext

    states: dict[int, Moments] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        z, groups = _matrix(batch), batch.column("groups")
        row = np.repeat(np.arange(len(z)), groups.value_lengths().to_numpy(zero_copy_only=False))
        group = groups.flatten().to_numpy(zero_copy_only=False)
        for g in np.unique(group):
            new = Moments.of(z[row[group == g]])
            states[int(g)] = states[int(g)].plus(new) if int(g) in states else new
    part = TaskContext.get().partitionId() % _MERGE_WIDTH
    yield _state_rows(states, ["grp", "n", "mean", "co", "part"], [part] * len(states))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict[int, Moments] = {}
    for batch in batches:
        for g, n, mean, co in zip(*(batch.column(c).to_pylist() for c in ("grp", "n", "mean", "co"))):
            new = Moments(n, np.array(mean), np.array(co).reshape(len(mean), -1))
            states[g] = states[g].plus(new) if g in states else new
    yield _state_rows(states, ["grp", "n", "mean", "co"])


def group_moments(data: DataFrame, groups, *, label: str = "label", features: str = "features") -> dict[int, Moments]:
    """Moments of each group of ``data`` (label, features vector); ``groups`` is an array<int> column, one entry per group a row counts in.

    One pass. Tasks send one row per group, merged in two steps; groups are few (folds, parts of folds).
    Rows without a label count nowhere.
    """
    rows = data.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), groups.alias("groups")).where("y is not null")
    parts = rows.mapInArrow(_gather, f"{_STATE}, part int")
    parts = parts.groupBy("grp", "part").applyInArrow(_merge, _STATE)
    return {r["grp"]: Moments(r["n"], np.array(r["mean"]), np.array(r["co"]).reshape(len(r["mean"]), -1))
            for r in parts.groupBy("grp").applyInArrow(_merge, _STATE).collect()}


def _errors(models: dict[int, np.ndarray]) -> Callable:
    """Per task and group: rows, absolute and squared errors of each model (coefficients and intercept in rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, group = _matrix(batch), batch.column("grp").to_numpy(zero_copy_only=False)
            for g in np.unique(group):
                b, some = models[int(g)], z[group == g]
                miss = some[:, :-1] @ b[:, :-1].T + b[:, -1] - some[:, -1:]
                sums = np.stack([np.full(len(b), float(len(some))), np.abs(miss).sum(axis=0), (miss * miss).sum(axis=0)], axis=1)
                total[int(g)] = total.get(int(g), 0) + sums
        rows = [(g, m, *sums) for g, t in total.items() for m, sums in enumerate(t.tolist())]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["grp", "model", "n", "absolute", "squared"])
    return run


def group_errors(data: DataFrame, group, models: dict[int, np.ndarray], *, label: str = "label",
                 features: str = "features") -> dict[tuple[int, int], tuple[float, float, float]]:
    """(rows, sum of absolute errors, sum of squared errors) by (group, model): the rows of a group scored by all of its models in one pass.

    ``group`` is an int column; groups without models must not occur. A model is its coefficients, then
    the intercept.
    """
    rows = data.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), group.cast("int").alias("grp")).where("y is not null")
    parts = rows.mapInArrow(_errors(models), "grp int, model int, n double, absolute double, squared double")
    sums = parts.groupBy("grp", "model").agg(*[F.sum(c).alias(c) for c in ("n", "absolute", "squared")])
    return {(r["grp"], r["model"]): (r["n"], r["absolute"], r["squared"]) for r in sums.collect()}


def fold_scores(data: DataFrame, alphas: list[float], *, fold: str = "fold", label: str = "label") -> list[list[dict[str, float]]]:
    """For each penalty and fold the MAE and R2 on the fold of the fit to all other folds.

    ``data`` is (label, features, fold). R2 of a constant label is 1 for a perfect fit, else 0.
    """
    state = group_moments(data, F.array(F.col(fold).cast("int")), label=label)
    models = {f: np.stack([merged([s for g, s in state.items() if g != f]).fit(a) for a in alphas]) for f in state}
    sums = group_errors(data, F.col(fold), models, label=label)

    def scores(model: int, f: int) -> dict[str, float]:
        n, absolute, squared = sums[f, model]
        spread = state[f].co[-1, -1]
        return {"mae": absolute / n, "r2": float(1 - squared / spread) if spread > 0 else float(squared == 0)}

    return [[scores(m, f) for f in sorted(state)] for m in range(len(alphas))]


def growing_errors(data: DataFrame, folds: int, steps: int, alpha: float = 0.0, *, label: str = "label", fold: str = "fold",
                   parts: str = "parts") -> dict[tuple[int, int], float | None]:
    """MAE on fold f of the fit to the first s parts of its training rows, by (f, s) for s = 0..steps-1.

    ``parts`` is an array<int> by held-out fold: in which part (0..steps-1) of that fold's training rows a
    row lies, null for none. A part's running merge is the next fit, so all sizes cost one pass; a fit
    to fewer than two rows is missing.
    """
    held = F.transform(F.col(parts), lambda p, f: f * F.lit(steps) + p)
    state = group_moments(data, F.array_compact(held).cast("array<int>"), label=label)
    models, known = {}, {}
    for f in range(folds):
        upto, fits = None, []
        for s in range(steps):
            new = state.get(f * steps + s)
            upto = new if upto is None else upto.plus(new) if new else upto
            if upto is not None and upto.n >= 2:
                known[f, s] = len(fits)
                fits.append(upto.fit(alpha))
        if fits:
            models[f] = np.stack(fits)
    sums = group_errors(data.where(F.col(fold).isin(list(models))), F.col(fold), models, label=label) if models else {}
    found = {}
    for f in range(folds):
        for s in range(steps):
            n, absolute, _ = sums.get((f, known.get((f, s), -1)), (0.0, 0.0, 0.0))
            found[f, s] = absolute / n if n else None
    return found
