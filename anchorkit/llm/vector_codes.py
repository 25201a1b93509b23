"""Product codes of vectors by ball k-means.

Vectors are whole numbers cut into equal parts, and every part position has a codebook. An entry and
the parts assigned to it form a ball. Between rounds a part is compared with few entries: the ball's
radius (largest distance of its parts to the entry) leaves as neighbours only entries that are nearer
to its own entry than twice the radius; a part nearer to its entry than half the way to the nearest
neighbour lies in the stable core and keeps its code without any comparison; other parts lie in a
ring between half the ways to the k-th and the next neighbour and are compared with the first k.
All distances are squares of whole numbers, and only entries that can't be as near are left out, so
codes equal those of a full search, ties (to the lower index) included.

A round reads a written table of vectors and codes and writes the next one. Balls are those of an
Arrow batch's parts: their radii are no larger than those over all rows, and need no pass of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorkit.llm.rows import fresh, named
from anchorkit.operators.joins import balanced_join
from anchorkit.session import staged

#: Largest whole-number component: squares of differences, four times their sum over a part and sums over parts fit a long.
LARGEST = 1 << 26
_ROWS = 4096


def whole_vectors(df: DataFrame, vector: str, to: str, scale: int = 256) -> DataFrame:
    """Rows of ``df`` whose ``vector`` is neither null nor holds null, NaN or infinite components, with ``to``: floor(scale * x) as ints.

    Raises when the query runs if a component's whole number is beyond 2^26.
    """
    x = named(df, vector).cast("array<double>")
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.when(F.abs(v) * scale <= LARGEST, F.floor(v * scale).cast("int")).otherwise(
        F.raise_error(F.lit("vector components are too large for exact codes")).cast("int")))
    return df.where(x.isNotNull() & F.coalesce(fit, F.lit(False))).withColumn(to, whole)


def full_search(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (lowest index among equals) of each part, and its squared distance."""
    code, best = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), _ROWS):
        some = parts[at:at + _ROWS]
        far = np.zeros((len(some), len(book)), np.int64)
        for d in range(parts.shape[1]):
            far += (some[:, d, None] - book[None, :, d]) ** 2
        code[at:at + _ROWS] = nearest = far.argmin(axis=1)
        best[at:at + _ROWS] = far[np.arange(len(some)), nearest]
    return code, best


def ball_search(parts: np.ndarray, book: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As :func:`full_search`, from the codes of the round before; also the number of distances to other entries."""
    own = ((parts - book[code]) ** 2).sum(axis=1)
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    code, best, compared = code.copy(), own.copy(), 0
    order = np.argsort(code, kind="stable")
    borders = np.searchsorted(code[order], np.arange(len(book) + 1))
    for entry in range(len(book)):
        members = order[borders[entry]:borders[entry + 1]]
        if not len(members):
            continue
        # an entry is out of reach of a part if half the way to it is longer than the part's distance
        reach = 4 * own[members]
        others = np.flatnonzero((apart[entry] <= reach.max()) & (np.arange(len(book)) != entry))
        others = others[np.argsort(apart[entry][others], kind="stable")]
        rings = np.searchsorted(apart[entry][others], reach, side="right")
        # rings are as wide as makes their number of candidates a power of two: few, and still no wider than twice the need
        rings = np.where(rings > 0, np.minimum(1 << np.ceil(np.log2(np.maximum(rings, 1))).astype(np.int64), len(others)), 0)
        for ring in np.unique(rings[rings > 0]):
            some = members[rings == ring]
            near = np.sort(np.append(others[:ring], entry))
            nearest, distance = full_search(parts[some], book[near])
            code[some], best[some] = near[nearest], distance
            compared += int(ring) * len(some)
    return code, best, compared


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _assign(books: np.ndarray, first: bool) -> Callable:
    """Codes (a byte per part) and errors of rows whose vectors fit the codebooks; others get null."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("whole")
            fit = np.flatnonzero(vectors.value_lengths().to_numpy(zero_copy_only=False) == parts * width)
            x = _matrix(vectors.take(pa.array(fit))).reshape(len(fit), parts, width)
            codes, error = np.zeros((len(fit), parts), np.uint8), np.zeros(len(fit), np.int64)
            if not first:
                old = batch.column("code").take(pa.array(fit)).to_pylist()
                codes = np.frombuffer(b"".join(old), np.uint8).reshape(len(fit), parts).copy()
            for p in range(parts):
                if first:
                    codes[:, p], far = full_search(x[:, p], books[p])
                else:
                    codes[:, p], far, _ = ball_search(x[:, p], books[p], codes[:, p].astype(np.int64))
                error += far
            all_codes = np.full(batch.num_rows, None, object)
            all_codes[fit] = [c.tobytes() for c in codes]
            errors = np.zeros(batch.num_rows, np.int64)
            errors[fit] = error
            none = np.ones(batch.num_rows, bool)
            none[fit] = False
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), vectors, pa.array(all_codes, pa.binary()), pa.array(errors, mask=none)],
                names=["row", "whole", "code", "error"])
    return run


def _part_sums(parts: int, entries: int, width: int) -> Callable:
    """Per task: number and sum of the parts of each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            known = batch.filter(batch.column("code").is_valid())
            x = _matrix(known.column("whole")).reshape(-1, width)
            cell = np.frombuffer(b"".join(known.column("code").to_pylist()), np.uint8).reshape(-1, parts) + np.arange(parts) * entries
            cell = cell.reshape(-1)
            order = np.argsort(cell, kind="stable")
            cell, x = cell[order], x[order]
            at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[:len(cell)])
            if len(at):
                total[cell[at], 0] += np.diff(np.append(at, len(cell)))
                total[cell[at], 1:] += np.add.reduceat(x, at, axis=0)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *[pa.array(total[used, i]) for i in range(width + 1)]], names=["cell", "n", *[f"s{d}" for d in range(width)]])
    return run


def _moved(books: np.ndarray, coded: DataFrame) -> np.ndarray:
    """Codebooks whose used entries are floor(sum / count) of their parts; at most one row per entry reaches the driver."""
    parts, entries, width = books.shape
    names = [f"s{d}" for d in range(width)]
    sums = coded.select("whole", "code").mapInArrow(_part_sums(parts, entries, width), f"cell long, n long, {', '.join(f'{s} long' for s in names)}")
    books = books.copy()
    for row in sums.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
        books[row["cell"] // entries, row["cell"] % entries] = [row[s] // row["n"] for s in names]
    return books


def product_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2,
                  scale: int = 256, to: str = "coded") -> tuple[DataFrame, np.ndarray]:
    """Rows of ``df`` with usable vectors plus the struct ``to`` (code binary, error long), and the codebooks (parts x entries x width).

    Vectors that are null or hold null or non-finite components are left out. Codebooks start as the
    parts of the ``entries`` smallest keys' vectors (null last; repeated keys by vector), fewer if there are
    fewer; each of ``rounds`` rounds assigns all parts and moves every used entry to floor(sum / count);
    at the end parts are assigned once more. The smallest key's vector sets the length, which ``parts``
    must divide; vectors of other lengths stay with a null code and error. An existing column
    ``to`` is replaced. With no vectors there are no codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part")
    whole, row = fresh(df, "whole"), fresh(df, "row")
    # the row number is stored beside its row
    kept = staged(whole_vectors(df, vector, whole, scale).withColumn(row, F.monotonically_increasing_id()), "vector-rows")
    work = kept.select(F.col(row).alias("row"), F.col(whole).alias("whole"))
    first = kept.orderBy(named(kept, key).asc_nulls_last(), whole).limit(1).select(F.size(whole).alias("n")).first()
    if first is None or first["n"] <= 0 or first["n"] % parts:
        if first is not None and first["n"] > 0:
            raise ValueError(f"{parts} parts don't divide vectors of {first['n']} components")
        none = F.struct(F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return kept.withColumn(to, none).drop(whole, row), np.zeros((parts, 0, 0), np.int64)
    width = first["n"] // parts
    start = kept.where(F.size(whole) == first["n"]).orderBy(named(kept, key).asc_nulls_last(), whole).limit(entries).select(whole).collect()
    books = np.array([r[0] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    kinds = "row long, whole array<int>, code binary, error long"
    coded = staged(work.mapInArrow(_assign(books, True), kinds), "vector-codes")
    for turn in range(rounds):
        books = _moved(books, coded)
        last = turn == rounds - 1
        again = coded.mapInArrow(_assign(books, False), kinds)
        coded = staged(again.drop("whole") if last else again, "vector-codes")
    held = fresh(kept, "coded_row")
    coded = coded.select(F.col("row").alias(held), F.struct("code", "error").alias(to))
    out = kept.drop(to).join(coded, F.col(row) == F.col(held))
    return out.drop(whole, row, held), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimals by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def group_error(df: DataFrame, group: str, error: str, to: str) -> DataFrame:
    """``df`` plus ``to``, the sum of ``error`` over rows with an equal ``group``; nulls are a group."""
    name = fresh(df, "group_key")
    df = df.withColumn(name, named(df, group))
    sums = staged(df.groupBy(name).agg(F.sum(error).alias(to)), "group-errors")
    return balanced_join(df, sums, [name], match_nulls=True).drop(name)
