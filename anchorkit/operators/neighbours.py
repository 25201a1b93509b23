"""Exact nearest neighbours inside classes, pruned by distances to pivots.

Points go to the nearest of a few pivots of their class; a pivot's points are cut into shells by
their distance to it, so that a block of a few thousand points has a pivot and a range of distances.
A point's own block gives it an upper bound. By the triangle inequality a nearer point of another
block must have a distance to that block's pivot that differs from the point's own distance to it by no
more than the bound, so the point visits only blocks whose range meets that interval. On data with
structure most blocks are left out; without any, all are visited, as in a plain search.

Equal points are put together first: they are each other's neighbours, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorkit.functions.values import hash_text, hash_unit
from anchorkit.operators.joins import balanced_join
from anchorkit.session import staged

#: Pivots of a class, and of all classes together; shells of a pivot.
PIVOTS, ALL_PIVOTS, SHELLS = 512, 8192, 1024
#: Relative slack of computed distances; it may add visits, never lose one.
_SLACK = 1e-9
_BLOCK = ["cls", "cell", "shell", "sub"]


@dataclass
class Layout:
    """Pivots of the large classes, and per pivot: borders of its shells, their range, and parts of overfull shells."""

    pivots: dict[str, np.ndarray]
    borders: dict[tuple[str, int], np.ndarray] = field(default_factory=dict)
    ranges: dict[tuple[str, int], tuple[float, float]] = field(default_factory=dict)
    subs: dict[tuple[str, int, int], int] = field(default_factory=dict)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] - 2.0 * a @ b.T + (b * b).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0.0))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ mixed >> np.uint64(29)) % np.uint64(parts)).astype(np.int32)


def _by_class(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    names = batch.column("cls").dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    for i, name in enumerate(names.dictionary.to_pylist()):
        yield name, np.flatnonzero(codes == i)


def _place(layout: Layout):
    """Adds each point's pivot, its distance to it, shell and part of the shell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cell, shell, sub = (np.zeros(n, np.int32) for _ in range(3))
            r = np.zeros(n)
            keys = batch.column("k").to_numpy(zero_copy_only=False)
            for name, at in _by_class(batch):
                if name in layout.pivots:
                    far = _distances(_vectors(batch.column("x").take(pa.array(at))), layout.pivots[name])
                    cell[at] = far.argmin(axis=1)
                    r[at] = far[np.arange(len(at)), cell[at]]
                for c in np.unique(cell[at]):
                    some = at[cell[at] == c]
                    borders = layout.borders.get((name, int(c)))
                    if borders is not None:
                        shell[some] = np.searchsorted(borders, r[some])
                    for s in np.unique(shell[some]):
                        if (parts := layout.subs.get((name, int(c), int(s)), 1)) > 1:
                            those = some[shell[some] == s]
                            sub[those] = _part(keys[those], parts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(r), pa.array(shell), pa.array(sub)],
                names=[*batch.schema.names, "cell", "r", "shell", "sub"])
    return run


def nearest_of(a: np.ndarray, a_keys: np.ndarray, b: np.ndarray, b_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance and key of the row of ``b`` nearest to each row of ``a``, itself excepted, ties by key; infinite without any."""
    order = np.argsort(b_keys, kind="stable")
    b, b_keys = b[order], b_keys[order]
    slack = _SLACK * float((a * a).sum(1).max(initial=0.0) + (b * b).sum(1).max(initial=0.0))
    at, dist = np.zeros(len(a), np.int64), np.full(len(a), np.inf)
    for start in range(0, len(a), 256):
        part = a[start:start + 256]
        d = (part * part).sum(1)[:, None] - 2.0 * part @ b.T + (b * b).sum(1)[None, :]
        d[a_keys[start:start + 256, None] == b_keys[None, :]] = np.inf
        low = d.min(1, keepdims=True)
        # close candidates are measured again: the expanded form loses digits near zero
        row, cand = np.nonzero((d <= low + slack) & np.isfinite(d))
        if not len(row):
            continue
        exact = np.concatenate([((b[c] - part[r]) ** 2).sum(1) for r, c in zip(
            np.array_split(row, len(row) // 65536 + 1), np.array_split(cand, len(row) // 65536 + 1))])
        best = np.lexsort((cand, exact, row))
        rows, first = np.unique(row[best], return_index=True)
        at[start + rows] = b_keys[cand[best[first]]]
        dist[start + rows] = exact[best[first]]
    return dist, at


def _found(keys: np.ndarray, dist: np.ndarray, at: np.ndarray) -> pa.Table:
    known = np.isfinite(dist)
    return pa.table({"k": pa.array(keys[known]), "dist": pa.array(dist[known]), "neighbour": pa.array(at[known])})


def _own_block(block: pa.Table) -> pa.Table:
    block = block.combine_chunks()
    x, keys = _vectors(block.column("x").chunk(0)), block.column("k").to_numpy()
    ask = np.flatnonzero(block.column("n").to_numpy() == 1)
    dist, at = nearest_of(x[ask], keys[ask], x, keys)
    return pa.table({"k": pa.array(keys[ask]), "dist": pa.array(dist), "neighbour": pa.array(at)})


def _visits(layout: Layout, chunks: dict | None):
    """Blocks that each point must visit: their number of visits per batch, or the visitors with their chunk."""
    def blocks_of(name: str, x: np.ndarray, bound: np.ndarray, own: tuple[np.ndarray, ...]) -> Iterator[tuple]:
        pivots = layout.pivots.get(name)
        far = _distances(x, pivots) if pivots is not None else np.zeros((len(x), 1))
        slack = _SLACK * (1.0 + far.max(initial=0.0))
        for c in range(far.shape[1]):
            span = layout.ranges.get((name, c), (0.0, np.inf) if pivots is None else None)
            if span is None:  # a pivot without points
                continue
            low, high = far[:, c] - bound - slack, far[:, c] + bound + slack
            some = np.flatnonzero((low <= span[1]) & (high >= span[0]))
            borders = layout.borders.get((name, c), np.zeros(0))
            first = np.searchsorted(borders, low[some])
            last = np.minimum(np.searchsorted(borders, high[some]), len(borders))
            row = np.repeat(some, last - first + 1)
            shell = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + np.repeat(first, last - first + 1)
            for s in np.unique(shell):
                those = row[shell == s]
                for sub in range(layout.subs.get((name, c, int(s)), 1)):
                    visiting = those[~((own[0][those] == c) & (own[1][those] == s) & (own[2][those] == sub))]
                    if len(visiting):
                        yield (name, c, int(s), sub), visiting

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "shell", "sub")]
            keys, bounds = batch.column("k").to_numpy(zero_copy_only=False), np.sqrt(batch.column("dist").to_numpy(zero_copy_only=False))
            for name, at in _by_class(batch):
                x = _vectors(batch.column("x").take(pa.array(at)))
                counts = []
                for block, visiting in blocks_of(name, x, bounds[at], tuple(o[at] for o in own)):
                    if chunks is None:
                        counts.append((*block, len(visiting)))
                        continue
                    rows = at[visiting]
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block[0]] * n), *[pa.array(np.full(n, v, np.int32)) for v in block[1:]],
                         pa.array(_part(keys[rows], chunks.get(block, 1))), pa.array(keys[rows]), batch.column("x").take(pa.array(rows))],
                        names=[*_BLOCK, "chunk", "k", "x"])
                if counts:
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*counts), kinds)], names=[*_BLOCK, "visits"])
    return run


def _meet(visitors: pa.Table, block: pa.Table) -> pa.Table:
    if not visitors.num_rows or not block.num_rows:
        none = np.zeros(0)
        return _found(none.astype(np.int64), none, none.astype(np.int64))
    visitors, block = visitors.combine_chunks(), block.combine_chunks()
    keys = visitors.column("k").to_numpy()
    return _found(keys, *nearest_of(_vectors(visitors.column("x").chunk(0)), keys, _vectors(block.column("x").chunk(0)), block.column("k").to_numpy()))


def _layout(points: DataFrame, block_rows: int) -> tuple[Layout, DataFrame]:
    """Pivots and shells of the classes that are larger than a block, and the points with their blocks (written)."""
    sizes = staged(points.groupBy("cls").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block_rows), "class-sizes")
    large = sizes.count()
    most = min(PIVOTS, ALL_PIVOTS // large) if large else 0
    layout = Layout({})
    if most:
        # two pivots a block, so that blocks are small in space as long as there are pivots; then come shells
        wanted = F.least(F.lit(most), F.ceil(2 * F.col("size") / block_rows)) / F.col("size")
        drawn = balanced_join(points, sizes, ["cls"]).where(hash_unit(hash_text(0, F.lit("pivot"), F.col("k"))) < wanted)
        found: dict[str, list] = {}
        for row in drawn.select("cls", "x").collect():  # a few hundred a class, ALL_PIVOTS or so together
            found.setdefault(row["cls"], []).append(row["x"])
        layout.pivots = {name: np.array(sorted(x)) for name, x in found.items()}
    kinds = "k long, cls string, x array<double>, n long, cell int, r double, shell int, sub int"
    names = list(layout.pivots)
    if not names:
        layout.subs = _overfull(points.mapInArrow(_place(layout), kinds), block_rows)
        return layout, staged(points.mapInArrow(_place(layout), kinds), "neighbour-blocks")
    steps = [i / SHELLS for i in range(1, SHELLS)]
    cells = points.where(F.col("cls").isin(names)).mapInArrow(_place(layout), kinds).groupBy("cls", "cell").agg(
        F.count(F.lit(1)).alias("size"), F.min("r").alias("low"), F.max("r").alias("high"),
        F.percentile_approx("r", steps, 4 * SHELLS).alias("steps"))
    for c in cells.collect():
        at = (c["cls"], c["cell"])
        layout.ranges[at] = (c["low"], c["high"])
        shells = min(SHELLS, -(-c["size"] // block_rows))
        layout.borders[at] = np.unique([c["steps"][i * SHELLS // shells - 1] for i in range(1, shells)])
    layout.subs = _overfull(points.mapInArrow(_place(layout), kinds), block_rows)
    return layout, staged(points.mapInArrow(_place(layout), kinds), "neighbour-blocks")


def _overfull(placed: DataFrame, block_rows: int) -> dict[tuple[str, int, int], int]:
    """Parts of the shells that hold over two blocks (equal distances can't be cut by distance)."""
    counts = placed.groupBy("cls", "cell", "shell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 2 * block_rows)
    return {(r["cls"], r["cell"], r["shell"]): -(-r["size"] // block_rows) for r in counts.collect()}


def nearest_neighbours(points: DataFrame, *, key: str, label: str, vector: str, block_rows: int = 4096) -> tuple[DataFrame, dict[str, int]]:
    """(key, neighbour) of the exact Euclidean nearest other point of the class, ties by key; and what was compared.

    Keys are whole numbers, one per row; a null label is a class; points with a null vector have no
    neighbour, a class of one point neither. The numbers: ``points`` that searched, ``blocks`` there are,
    ``visits`` of a point to a block other than its own, ``all_visits`` that a search without pruning makes.
    """
    if dict(points.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} must be a whole number")
    cls = F.when(F.col(label).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(label).cast("string")))
    rows = points.select(F.col(key).cast("long").alias("k"), cls.alias("cls"), F.col(vector).cast("array<double>").alias("x")).where("x is not null")
    same = staged(rows.groupBy("cls", "x").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n")), "distinct-points").select("k", "cls", "x", "n")
    copied = same.where("n > 1")
    size = copied.agg(F.sum(F.size("x") * 8 + 64).alias("b")).first()["b"]
    resolved = None
    if size:
        held = copied.select("cls", "x", F.col("k").alias("first"))
        others = balanced_join(rows, held, ["cls", "x"], right_bytes=int(size)).where("k <> first").select("k", "first")
        seconds = others.groupBy(F.col("first").alias("k")).agg(F.min("k").alias("neighbour"))
        resolved = others.select("k", F.col("first").alias("neighbour")).unionByName(seconds)
    layout, placed = _layout(same, block_rows)
    own = placed.groupBy(*_BLOCK).applyInArrow(_own_block, "k long, dist double, neighbour long")
    own = staged(own, "neighbour-bounds")
    asking = placed.where("n = 1").join(own.select("k", "dist"), "k")
    visit_counts = asking.mapInArrow(_visits(layout, None), "cls string, cell int, shell int, sub int, visits long")
    counts = visit_counts.groupBy(*_BLOCK).agg(F.sum("visits").alias("visits"))
    total = counts.agg(F.sum("visits").alias("v")).first()["v"] or 0
    crowded = counts.where(F.col("visits") > 4 * block_rows).collect()  # at most a row per block
    chunks = {tuple(r[c] for c in _BLOCK): -(-r["visits"] // (4 * block_rows)) for r in crowded}
    best = own.where(F.col("dist") < float("inf"))
    if total:
        visitors = asking.mapInArrow(_visits(layout, chunks), "cls string, cell int, shell int, sub int, chunk int, k long, x array<double>")
        copies = F.lit(1)
        if chunks:
            crowd = points.sparkSession.createDataFrame([(*b, n) for b, n in chunks.items()], "cls string, cell int, shell int, sub int, chunks int")
            blocks = placed.join(F.broadcast(crowd), _BLOCK, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", copies) - 1)))
        else:
            blocks = placed.withColumn("chunk", F.lit(0))
        met = visitors.groupBy(*_BLOCK, "chunk").cogroup(blocks.select(*_BLOCK, "chunk", "k", "x").groupBy(*_BLOCK, "chunk")).applyInArrow(
            _meet, "k long, dist double, neighbour long")
        best = best.unionByName(met)
    best = best.groupBy("k").agg(F.min(F.struct("dist", "neighbour")).alias("m")).select("k", F.col("m.neighbour").alias("neighbour"))
    out = best.unionByName(resolved) if resolved is not None else best
    per_class = placed.groupBy("cls").agg(F.countDistinct("cell", "shell", "sub").alias("b"), F.count_if(F.col("n") == 1).alias("p"))
    done = per_class.agg(F.sum("b").alias("b"), F.sum("p").alias("p"), F.sum((F.col("b") - 1) * F.col("p")).alias("a")).first()
    stats = {"points": done["p"] or 0, "blocks": done["b"] or 0, "visits": int(total), "all_visits": done["a"] or 0}
    return out.select(F.col("k").alias(key), "neighbour"), stats
