"""MLlib's multilayer perceptron, fitted by passes over blocks of rows in numpy.

Same loss, start and steps (L-BFGS with a strong Wolfe line search) as ``MultilayerPerceptronClassifier``;
what a pass costs is a few matrix products for some hundred rows, which stay in the cache. A pass is one job that sends one gradient a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorkit.operators.boosted import dealt, summed
from anchorkit.session import staged

#: Rows of one matrix product, and of a stored block in stacks.
_CHUNK, _STACKS = 256, 64
_BLOCK = "n int, x binary, y binary, w binary, stacks int"


def _blocks(width: int, classes: int, stack: int) -> Callable:
    """Rows as blocks. MLlib averages stacks of rows and then the stacks, so the rows of a partition's last, short stack weigh more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, held = [], [], 0

        def block(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            n, rest = len(y), len(y) % stack
            w = np.full(n, 1.0 / stack)
            if rest:
                w[n - rest:] = 1.0 / rest
            cells = [n, np.ascontiguousarray(x).tobytes(), y.tobytes(), w.tobytes(), -(-n // stack)]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["n", "x", "y", "w", "stacks"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            if x.shape[1] != width or not np.isfinite(x).all() or not np.isin(y, np.arange(classes)).all():
                raise ValueError(f"features must be finite and {width} in number, labels whole numbers below {classes}")
            xs.append(x)
            ys.append(y.astype(np.int64))
            held += n
            if held >= stack * _STACKS:
                x, y, whole = np.concatenate(xs), np.concatenate(ys), held // stack * stack
                yield block(x[:whole], y[:whole])
                xs, ys, held = [x[whole:]], [y[whole:]], held - whole
        if held:
            yield block(np.concatenate(xs), np.concatenate(ys))
    return run


def _slope(layers: list[int], weights: np.ndarray) -> Callable[[Iterator[dict]], np.ndarray]:
    """Per task the loss and its gradient at ``weights``, summed over rows by their weight."""
    places, at = [], 0
    for rows_in, rows_out in zip(layers, layers[1:]):
        places.append((at, at + rows_in * rows_out, rows_in, rows_out))
        at += (rows_in + 1) * rows_out

    def run(rows: Iterator[dict]) -> np.ndarray:
        total = np.zeros(len(weights) + 1)
        maps = [(weights[a:b].reshape(i, o), weights[b:b + o]) for a, b, i, o in places]
        sums = [(total[1:][a:b].reshape(i, o), total[1:][b:b + o]) for a, b, i, o in places]
        for r in rows:
            x, y, w = np.frombuffer(r["x"]).reshape(r["n"], -1), np.frombuffer(r["y"], np.int64), np.frombuffer(r["w"])
            for start in range(0, r["n"], _CHUNK):
                outs, truth, weight = [x[start:start + _CHUNK]], y[start:start + _CHUNK], w[start:start + _CHUNK]
                for k, (m, b) in enumerate(maps):
                    z = outs[-1] @ m
                    z += b
                    if k < len(maps) - 1:
                        np.negative(z, out=z)
                        with np.errstate(over="ignore"):
                            np.exp(z, out=z)
                        z += 1.0
                        np.reciprocal(z, out=z)
                    else:
                        z -= z.max(axis=1, keepdims=True)
                        np.exp(z, out=z)
                        z /= z.sum(axis=1, keepdims=True)
                    outs.append(z)
                each = np.arange(len(truth))
                with np.errstate(divide="ignore"):
                    total[0] -= np.dot(np.log(outs[-1][each, truth]), weight)
                delta = outs.pop()
                delta[each, truth] -= 1.0
                delta *= weight[:, None]
                for k in range(len(maps) - 1, -1, -1):
                    below = outs.pop()
                    sums[k][0][...] += below.T @ delta
                    sums[k][1][...] += delta.sum(axis=0)
                    if k:
                        delta = delta @ maps[k][0].T
                        delta *= below
                        delta *= 1.0 - below
        return total
    return run


class _NoStep(Exception):
    """A direction or step that can't be used."""


@dataclass(frozen=True)
class _Point:
    """Value and slope along a direction."""

    t: float
    value: float
    slope: float


def _between(left: _Point, right: _Point) -> float:
    """Minimum of the cubic through two points, kept away from both."""
    d1 = left.slope + right.slope - 3 * (left.value - right.value) / (left.t - right.t)
    inside = d1 * d1 - left.slope * right.slope
    d2 = math.sqrt(inside) if inside >= 0 else math.nan
    span = right.t - left.t
    t = right.t - span * (right.slope + d2 - d1) / (right.slope - left.slope + 2 * d2)
    return left.t + 0.1 * span if t < left.t + 0.1 * span else left.t + 0.9 * span if t > left.t + 0.9 * span else t


def _step_size(phi: Callable[[float], _Point], start: float, tries: int = 10, c1: float = 1e-4, c2: float = 0.9) -> float:
    """A step with enough decrease and a small enough slope (strong Wolfe conditions)."""
    low = first = phi(0.0)
    if first.slope > 0:
        raise _NoStep("no descent")

    def zoom(low: _Point, high: _Point) -> float:
        for _ in range(tries):
            c = phi(_between(high, low) if low.t > high.t else _between(low, high))
            if c.value > first.value + c1 * c.t * first.slope or c.value >= low.value:
                high = c
                continue
            if abs(c.slope) <= c2 * abs(first.slope):
                return c.t
            if c.slope * (high.t - low.t) >= 0:
                high = low
            low = c
        raise _NoStep("zoom failed")

    t = start
    for i in range(tries):
        c = phi(t)
        if not math.isfinite(c.value):
            t /= 2.0
            continue
        if c.value > first.value + c1 * t * first.slope or (c.value >= low.value and i > 0):
            return zoom(low, c)
        if abs(c.slope) <= c2 * abs(first.slope):
            return c.t
        if c.slope >= 0:
            return zoom(c, low)
        low = c
        t *= 1.5
    raise _NoStep("line search failed")


def _direction(grad: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Minus the approximate inverse Hessian times the gradient; latest step first."""
    out, shares = grad.copy(), []
    for s, y in zip(steps, changes):
        shares.append((s @ out) / (s @ y))
        if math.isnan(shares[-1]):
            raise _NoStep("not a number")
        out -= shares[-1] * y
    if steps:
        sy, yy = steps[0] @ changes[0], changes[0] @ changes[0]
        if sy < 0 or math.isnan(sy):
            raise _NoStep("not a number")
        out *= sy / yy
    for s, y, share in reversed(list(zip(steps, changes, shares))):
        out += (share - (y @ out) / (s @ y)) * s
    return -out


def minimised(slope: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, most: int, tol: float, memory: int = 10) -> np.ndarray:
    """L-BFGS: the point after ``most`` steps, or where values (of 20 steps) or gradient have settled."""
    known: dict = {}

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        key = x.tobytes()
        if known.get("key") != key:
            known.update(key=key, found=slope(x))
        return known["found"]

    x = start
    value, grad = at(x)
    first, values, steps, changes, failed = value, [math.inf], [], [], False
    number = 0
    while not (number >= most or len(values) >= 2 and abs(value - max(values)) <= tol * first
               or np.linalg.norm(grad) <= max(tol * value, 1e-8)):
        try:
            way = _direction(grad, steps, changes)

            def phi(t: float) -> _Point:
                v, g = at(x + t * way)
                return _Point(t, v, float(g @ way))

            size = _step_size(phi, 1.0 if number else 1.0 / float(np.linalg.norm(way)))
            if size * np.linalg.norm(grad) < 1e-10:
                raise _NoStep("step too small")
        except _NoStep:
            if failed:
                break
            steps, changes, failed = [], [], True
            continue
        new = x + size * way
        new_value, new_grad = at(new)
        steps, changes = [new - x, *steps][:memory], [new_grad - grad, *changes][:memory]
        values = [*values, new_value][-20:]
        x, value, grad, failed = new, new_value, new_grad, False
        number += 1
    return x


class BlockPerceptron(MultilayerPerceptronClassifier):
    """``MultilayerPerceptronClassifier`` from blocks above ``least_rows`` rows; fewer are as quick in MLlib."""

    least_rows = 500_000

    def _fit(self, dataset: DataFrame):
        layers = list(self.getLayers()) if self.isDefined("layers") else []
        rows = dataset.agg(F.count(F.lit(1))).first()[0]
        if not rows or rows < self.least_rows or len(layers) < 2 or self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        known = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        blocks = known.mapInArrow(_blocks(layers[0], layers[-1], self.getBlockSize()), _BLOCK)
        blocks = dealt(staged(blocks, "perceptron"), rows, "perceptron")
        stacks = blocks.agg(F.sum("stacks")).first()[0]
        start = self.getInitialWeights() if self.isSet("initialWeights") else None
        # MLlib draws the first weights and makes the model, without a step over its one row
        line = dataset.sparkSession.createDataFrame([(0.0, [0.0] * layers[0])], "label double, x array<double>").select(
            F.col("label").alias(self.getLabelCol()), array_to_vector("x").alias(self.getFeaturesCol()))
        plain = {self.maxIter: 0}
        start = np.array(start.toArray() if start is not None else self._own_fit(line, plain).weights.toArray())

        def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
            found = summed(blocks, _slope(layers, x)) / stacks
            return float(found[0]), found[1:]

        from pyspark.ml.linalg import Vectors

        best = minimised(slope, start, self.getMaxIter(), self.getTol())
        return self._copyValues(self._own_fit(line, {**plain, self.initialWeights: Vectors.dense(best)}))

    def _own_fit(self, dataset: DataFrame, params: dict):
        return MultilayerPerceptronClassifier._fit(self.copy(params), dataset)
