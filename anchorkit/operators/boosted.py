"""MLlib's boosted trees, fitted from sums by bin instead of row by row.

The trees are those of ``GBTRegressor`` and ``GBTClassifier``: the same bins, rows drawn per tree, columns
drawn per node and best splits. Only the passes differ: a row is one byte a feature, in blocks written once,
and tasks add up whole blocks in numpy. A pass is one job with a few kilobytes of sums a task. Rows'
predictions are written every few trees; passes add the trees since then.
"""

from __future__ import annotations

import ctypes
import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorkit.session import scratch_path, staged

#: Trees between two writings of the predictions.
KEPT_TREES = 8
#: Above this number of tasks their sums are added up on the executors first.
_DIRECT_TASKS = 64
#: Rows of one task of a pass at least, unless cores would idle: starting a task costs as much as reading a million rows.
TASK_ROWS = 2_000_000
_EPSILON = float(np.finfo(float).eps)
_ARRAY = "sums binary, shape array<int>"
_BLOCK = "n int, bins binary, label binary, weight binary, draws binary, scored binary"


@dataclass
class Node:
    """A node in the making: its sums (weight, label, squared label, rows) and its split, if any."""

    level: int
    sums: np.ndarray
    impurity: float
    gain: float = -1.0
    feature: int = -1
    upto: int = -1
    children: list[int] = field(default_factory=list)

    @property
    def prediction(self) -> float:
        return float(self.sums[1] / self.sums[0]) if self.sums[0] else 0.0


def impurity(sums: np.ndarray) -> np.ndarray:
    """Variance from (weight, label, squared label, ..) in the last axis, 0 without weight."""
    n = np.where(sums[..., 0] == 0, 1.0, sums[..., 0])
    return np.where(sums[..., 0] == 0, 0.0, (sums[..., 2] - sums[..., 1] * sums[..., 1] / n) / n)


def thresholds(values: np.ndarray, weights: np.ndarray, share: float, total: float, most: int) -> np.ndarray:
    """At most ``most`` split points of a feature, near its quantiles, from a ``share`` of rows that weigh ``total`` in all."""
    seen, inverse = np.unique(values, return_inverse=True)
    sizes = np.bincount(inverse, weights=weights, minlength=len(seen)).astype(float)
    some = seen != 0
    count = int(np.count_nonzero(values))
    seen, sizes = seen[some], sizes[some]
    if not count:
        return np.empty(0)
    wanted = share * total
    rest = wanted - sizes.sum()
    if rest > _EPSILON * count * 100:  # zeros are what is missing
        at = int(np.searchsorted(seen, 0.0))
        seen, sizes = np.insert(seen, at, 0.0), np.insert(sizes, at, rest)
    middles = (seen[:-1] + seen[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride, chosen = wanted / (most + 1), []
    target, now = stride, float(sizes[0])
    for i in range(1, len(seen)):
        before, now = now, now + float(sizes[i])
        if abs(before - target) < abs(now - target):
            chosen.append(middles[i - 1])
            target += stride
    return np.array(chosen)


class _Draws:
    """Columns for the nodes of one tree, drawn as MLlib draws them."""

    def __init__(self, spark: SparkSession, seed: int, width: int, wanted: int):
        self.jvm, self.width, self.wanted = spark.sparkContext._jvm, width, wanted
        self.random = self.jvm.java.util.Random(seed)

    def columns(self) -> list[int]:
        if self.wanted >= self.width:
            return list(range(self.width))
        kept = list(range(self.wanted))
        each = self.jvm.org.apache.spark.util.random.XORShiftRandom(self.random.nextLong())
        for column in range(self.wanted, self.width):
            place = int(each.nextDouble() * (column + 1))
            if place < self.wanted:
                kept[place] = column
        return kept


def best_split(sums: np.ndarray, columns: list[int], splits: list[np.ndarray], node: Node | None, level: int,
               least: int, least_weight: float, least_gain: float) -> tuple[Node, list[Node]]:
    """The node with its best split, and its two children (none for a leaf), from ``sums`` (feature, bin, sum).

    A missing ``node`` is the root. The first of equal gains wins.
    """
    best: tuple = (-math.inf, None)
    for f in columns:
        if not len(splits[f]):
            continue
        upto = np.cumsum(sums[f, :len(splits[f]) + 1], axis=0)
        left, whole = upto[:-1], upto[-1]
        right = whole - left
        if node is None:
            parent = left[0] + right[0]
            node = Node(level, parent, float(impurity(parent)))
        n = left[:, 0] + right[:, 0]
        with np.errstate(all="ignore"):
            gains = node.impurity - left[:, 0] / n * impurity(left) - right[:, 0] / n * impurity(right)
        bad = (np.minimum(left[:, 3], right[:, 3]) < least) | (np.minimum(left[:, 0], right[:, 0]) < least_weight) | ~(gains >= least_gain)
        gains = np.where(bad, -math.inf, gains)
        at = int(np.argmax(gains))
        if gains[at] > best[0]:
            best = (float(gains[at]), (f, at, left[at], right[at]))
    if node is None:  # no feature has two values
        whole = sums[0].sum(axis=0)
        node = Node(level, whole, float(impurity(whole)))
    if best[0] <= 0 or best[1] is None:
        return node, []
    node.gain, (node.feature, node.upto, *sides) = best[0], best[1]
    return node, [Node(level + 1, side, float(impurity(side))) for side in sides]


@dataclass(frozen=True)
class Tree:
    """Splits by node (feature -1: a leaf), parents before children, and the leaves' predictions."""

    feature: np.ndarray
    upto: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(nodes: list[Node]) -> Tree:
        child = lambda k: np.array([x.children[k] if x.children else -1 for x in nodes])
        return Tree(np.array([x.feature if x.children else -1 for x in nodes]), np.array([x.upto for x in nodes]), child(0), child(1),
                    np.array([x.prediction for x in nodes]))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """Number of the last node that each row comes to; ``bins`` is (feature, row)."""
        kind = np.uint8 if len(self.feature) <= 256 else np.uint16 if len(self.feature) <= 65536 else np.uint64

        def last(i: int) -> np.ndarray:
            if self.feature[i] < 0:
                return kind(i)
            left, right = last(self.left[i]), last(self.right[i])
            beyond = np.negative((bins[self.feature[i]] > int(self.upto[i])).astype(kind, copy=False))  # all bits or none
            return left ^ ((left ^ right) & beyond)

        return last(0) if self.feature[0] >= 0 else np.zeros(bins.shape[1], kind)


def keep_memory() -> None:
    """Let a worker's allocator keep what arrays free: giving pages back and asking for them again costs more than the sums."""
    try:
        glibc = ctypes.CDLL(None)
        glibc.mallopt(-1, 1 << 26)  # M_TRIM_THRESHOLD
        glibc.mallopt(-3, 1 << 26)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass


def _blocks(splits: list[np.ndarray]) -> Callable:
    """Rows of a batch as one block: bins by feature, the trees' draws as bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            plain = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            y = plain("y")
            w = plain("w") if "w" in batch.schema.names else np.ones(n)
            if x.shape[1] != len(splits) or not (np.isfinite(x).all() and np.isfinite(y).all() and np.isfinite(w).all() and (w >= 0).all()):
                raise ValueError("features, labels and weights must be finite, weights not negative")
            bins = np.stack([np.searchsorted(s, x[:, f], side="left") for f, s in enumerate(splits)]).astype(np.uint8)
            drawn = batch.column("drawn").flatten()
            bits = np.packbits(drawn.to_numpy(zero_copy_only=False).reshape(n, -1).T, axis=1).tobytes() if len(drawn) else None
            weight = w.tobytes() if "w" in batch.schema.names else None
            cells = [n, bins.tobytes(), y.tobytes(), weight, bits, None]
            kinds = [pa.int32()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)],
                                             names=["n", "bins", "label", "weight", "draws", "scored"])
    return run


def _scored(bins: np.ndarray, scored: np.ndarray | None, trees: list[tuple[float, Tree]]) -> np.ndarray | None:
    """Predictions after more trees."""
    for weight, tree in trees:
        add = (weight * tree.value)[tree.places(bins)]
        scored = add if scored is None else scored + add
    return scored


def _wanted(y: np.ndarray, scored: np.ndarray | None, loss: str) -> np.ndarray:
    """What the next tree learns: the label at first, then the slope of the loss."""
    if scored is None:
        return y
    if loss == "squared":
        return 2.0 * (y - scored)
    with np.errstate(over="ignore"):
        return 4.0 * y / (1.0 + np.exp(2.0 * y * scored))


def _level_sums(width: int, most: int, number: int, trees: list[tuple[float, Tree]], tree: Tree, open_nodes: list[int], loss: str) -> Callable:
    """Per task the sums (node, feature, bin) of the open nodes of tree ``number``."""
    slots = np.full(len(tree.feature), len(open_nodes))
    slots[open_nodes] = np.arange(len(open_nodes))
    size = (len(open_nodes) + 1) * most

    def run(rows: Iterator[dict]) -> np.ndarray:
        total = np.zeros((width, 4, size))
        for r in rows:
            bins = np.frombuffer(r["bins"], np.uint8).reshape(width, r["n"])
            y = np.frombuffer(r["label"])
            w = np.frombuffer(r["weight"]) if r["weight"] is not None else None
            scored = np.frombuffer(r["scored"]) if r["scored"] is not None else None
            if r["draws"] is not None:
                bits = np.frombuffer(r["draws"], np.uint8).reshape(-1, (r["n"] + 7) // 8)[number]
                kept = np.flatnonzero(np.unpackbits(bits, count=r["n"]))
                bins, y = bins.take(kept, axis=1), y.take(kept)
                w, scored = (None if v is None else v.take(kept) for v in (w, scored))
            z = _wanted(y, _scored(bins, scored, trees), loss)
            wz = z if w is None else w * z
            wzz = wz * z
            base = slots.take(tree.places(bins)) * most
            for f in range(width):
                at = base + bins[f]
                total[f, 3] += (rows_in := np.bincount(at, minlength=size))
                total[f, 0] += rows_in if w is None else np.bincount(at, w, size)
                total[f, 1] += np.bincount(at, wz, size)
                total[f, 2] += np.bincount(at, wzz, size)
        return total.reshape(width, 4, -1, most).transpose(2, 0, 3, 1)[:len(open_nodes)]
    return run


def _with_scores(width: int, trees: list[tuple[float, Tree]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, bins, scored in zip(*(batch.column(c).to_pylist() for c in ("n", "bins", "scored"))):
                old = None if scored is None else np.frombuffer(scored)
                out.append(_scored(np.frombuffer(bins, np.uint8).reshape(width, n), old, trees).tobytes())
            yield batch.set_column(batch.schema.get_field_index("scored"), "scored", pa.array(out, pa.binary()))
    return run


def summed(data: DataFrame, task: Callable[[Iterator[dict]], np.ndarray]) -> np.ndarray:
    """Sum over the partitions of ``data`` of the array that ``task`` makes of a partition's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        cells = lambda c: [x if x is None or isinstance(x, int) else memoryview(x) for x in c.to_pylist()]
        found = task(dict(zip(b.schema.names, row)) for b in batches for row in zip(*(cells(c) for c in b.columns)))
        yield _array_row(np.asarray(found, float))

    parts = data.mapInArrow(run, _ARRAY)
    if data.rdd.getNumPartitions() > _DIRECT_TASKS:
        parts = parts.select("sums", "shape", F.expr(f"spark_partition_id() % {_DIRECT_TASKS}").alias("part")).groupBy("part").applyInArrow(_array_sum, _ARRAY)
    return reduce(np.add, [np.frombuffer(r["sums"]).reshape(r["shape"]) for r in parts.collect()])


def dealt(blocks: DataFrame, rows: int, name: str) -> DataFrame:
    """Blocks written evenly into a file for each core, or more where these would become large."""
    return staged(blocks.repartition(max(blocks.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS)), name)


def _array_row(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary()), pa.array([list(found.shape)], pa.list_(pa.int32()))], names=["sums", "shape"])


def _array_sum(parts: pa.Table) -> pa.Table:
    each = zip(parts.column("sums").to_pylist(), parts.column("shape").to_pylist())
    return pa.Table.from_batches([_array_row(reduce(np.add, [np.frombuffer(s).reshape(shape) for s, shape in each]))])


def _nodes_of(nodes: list[Node], splits: list[np.ndarray]) -> list[tuple]:
    """A tree in MLlib's stored form, in preorder; two leaves that predict the same are one."""
    out: list[tuple] = []

    def leaf(i: int) -> float | None:
        """The prediction of a node that ends as a leaf."""
        if not nodes[i].children:
            return nodes[i].prediction
        a, b = (leaf(c) for c in nodes[i].children)
        return a if a is not None and a == b else None

    def add(i: int) -> int:
        node, at, ends = nodes[i], len(out), leaf(i)
        stats = [float(v) for v in node.sums[:3]]
        out.append(())
        if ends is not None:
            out[at] = (at, ends, node.impurity, stats, int(node.sums[3]), -1.0, -1, -1, (-1, [], -1))
        else:
            left, right = (add(c) for c in node.children)
            out[at] = (at, node.prediction, node.impurity, stats, int(node.sums[3]), node.gain, left, right,
                       (node.feature, [float(splits[node.feature][node.upto])], -1))
        return at

    add(0)
    return out


_STORED = """treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint,
gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""


class _Boosted:
    """Estimators whose ``_fit`` builds the same model from blocks.

    Settings that blocks don't cover stay with MLlib, as do fewer than ``least_rows`` rows: there its passes are as quick.
    """

    least_rows = 500_000

    def _covered(self, data: DataFrame) -> bool:
        attributes = json.dumps(data.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {}))
        return (self.getMaxBins() <= 256 and not self.isSet("validationIndicatorCol") and self.getLossType() in ("squared", "logistic")
                and '"nominal"' not in attributes and '"binary"' not in attributes)

    def _columns_per_node(self, width: int) -> int:
        """Number of columns drawn for a node, or none if the strategy has another form."""
        named = self.getFeatureSubsetStrategy()
        fixed = {"all": width, "auto": width, "sqrt": math.ceil(math.sqrt(width)), "onethird": math.ceil(width / 3.0),
                 "log2": max(1, math.ceil(math.log(width) / math.log(2)))}
        if named in fixed:
            return fixed[named]
        return min(int(named), width) if named.isdigit() else math.ceil(float(named) * width)

    def _fit(self, dataset: DataFrame):
        if not self._covered(dataset):
            return super()._fit(dataset)
        spark, binary = dataset.sparkSession, self.getLossType() == "logistic"
        label = F.col(self.getLabelCol()).cast("double")
        weight = self.getOrDefault("weightCol") if self.isDefined("weightCol") and self.getOrDefault("weightCol") else None
        columns = [vector_to_array(self.getFeaturesCol()).alias("x"), (label * 2 - 1 if binary else label).alias("y")]
        columns += [F.col(weight).cast("double").alias("w")] if weight else []
        known = dataset.select(*columns)
        shape = known.agg(F.count(F.lit(1)).alias("n"), (F.sum("w") if weight else F.count(F.lit(1)).cast("double")).alias("w"),
                          F.first(F.size("x")).alias("width"), F.count_if(~F.col("y").isin(-1.0, 1.0) | F.col("y").isNull()).alias("odd")).first()
        if not shape["n"] or shape["n"] < self.least_rows or not shape["width"] or (binary and shape["odd"]):
            return super()._fit(dataset)  # which also says what is wrong
        width, seed = shape["width"], self.getSeed()
        splits = self._splits(known, shape["n"], shape["w"], width, min(self.getMaxBins(), shape["n"]) - 1, bool(weight))
        most = max(len(s) for s in splits) + 1  # now and then one more than asked for
        if most > 256:
            return super()._fit(dataset)
        rate, number = self.getSubsamplingRate(), self.getMaxIter()
        drawn = F.array(*[F.rand(seed + m + 1) < rate for m in range(number)]) if rate < 1 else F.array().cast("array<boolean>")
        # the draws follow the rows' places in the partitions of the input, so they are stored with the rows
        blocks = known.withColumn("drawn", drawn).mapInArrow(_blocks(splits), _BLOCK)
        state = dealt(staged(blocks, "boosted"), shape["n"], "boosted")
        trees, stored, since = [], [], []
        wanted = self._columns_per_node(width)
        for m in range(number):
            nodes = self._tree(spark, state, m, since, splits, wanted, most, shape["w"], "logistic" if binary else "squared")
            share = 1.0 if m == 0 else self.getStepSize()
            trees.append(share)
            stored += [(m, n) for n in _nodes_of(nodes, splits)]
            since.append((share, Tree.of(nodes)))
            if len(since) >= KEPT_TREES and m + 1 < number:
                state, since = staged(state.mapInArrow(_with_scores(width, since), _BLOCK), "boosted"), []
        return self._model(spark, trees, stored, width)

    def _splits(self, known: DataFrame, rows: int, total: float, width: int, most: int, weighted: bool) -> list[np.ndarray]:
        """Split points of all features from the rows that MLlib draws for them (10,000, or the squared number of bins)."""
        spark, wanted = known.sparkSession, max(self.getMaxBins() ** 2, 10_000)
        share, some = 1.0, known
        if wanted < rows:
            share = wanted / rows
            chance = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(self.getSeed()).nextInt()
            sample = known._jdf.toJavaRDD().sample(False, share, chance)
            some = DataFrame(spark._jsparkSession.createDataFrame(sample, known._jdf.schema()), spark)
        found = some.collect()
        x = np.array([r["x"] for r in found], float).reshape(len(found), width)
        w = np.array([r["w"] for r in found], float) if weighted else np.ones(len(found))
        return [thresholds(x[:, f], w, share, total, most) for f in range(width)]

    def _tree(self, spark: SparkSession, state: DataFrame, number: int, since: list, splits: list[np.ndarray], wanted: int, most: int, total: float,
              loss: str) -> list[Node]:
        """Nodes of tree ``number``, the root first; a level is one pass."""
        width, deepest = len(splits), self.getMaxDepth()
        limits = (self.getMinInstancesPerNode(), self.getMinWeightFractionPerNode() * total, self.getMinInfoGain())
        draws = _Draws(spark, self.getSeed() + number, width, wanted)
        nodes: list[Node | None] = [None]
        still = [0]
        while still:
            columns = [draws.columns() for _ in still]
            known = Tree.of([x or Node(0, np.ones(4), 0.0) for x in nodes])
            sums = summed(state, _level_sums(width, most, number, since, known, still, loss))
            later: list[int] = []
            for place, mine, own in zip(still, columns, sums):
                level = nodes[place].level if nodes[place] else 0
                node, sides = best_split(own, mine, splits, nodes[place], level, *limits)
                nodes[place] = node
                if level >= deepest:
                    continue
                for side in sides:
                    node.children.append(len(nodes))
                    nodes.append(side)
                    if level + 1 < deepest and abs(side.impurity) >= _EPSILON:
                        later.insert(0, len(nodes) - 1)
            still = later
        return nodes

    def _model(self, spark: SparkSession, shares: list[float], stored: list[tuple], width: int):
        """The trees as MLlib's own model, read from its stored form."""
        path, said = scratch_path(spark, "boosted-model"), {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
        kind = "ml.classification.GBTClassificationModel" if isinstance(self, GBTClassifier) else "ml.regression.GBTRegressionModel"
        given = lambda only: {p.name: v for p, v in self.extractParamMap().items() if p.name not in ("parallelism",) and (
            p.name in only if only else True)}
        own = {"class": f"org.apache.spark.{kind}", **said, "uid": self.uid, "paramMap": given(None), "defaultParamMap": {},
               "numFeatures": width, "numTrees": len(shares), "treeWeights": shares}
        tree = {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **said,
                "paramMap": given({"maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "seed", "featuresCol"}), "defaultParamMap": {}}
        spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame([(m, json.dumps({**tree, "uid": f"dtr_{self.uid}_{m}"}), s) for m, s in enumerate(shares)],
                              "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(stored, _STORED).coalesce(1).write.parquet(f"{path}/data")
        return (GBTClassificationModel if isinstance(self, GBTClassifier) else GBTRegressionModel).load(path)


class BlockGBTRegressor(_Boosted, GBTRegressor):
    """``GBTRegressor`` from blocks."""


class BlockGBTClassifier(_Boosted, GBTClassifier):
    """``GBTClassifier`` from blocks."""
