"""Exact quantiles by counts of bits, without sorting a column and without a row per column.

Doubles map to whole numbers of the same order. A first pass counts the leading bits of every column
side by side; the counts tell in which leading bits each wanted place lies, and the next pass counts the
following bits of only the values there. Tasks send one packed row per group, whatever the number of
columns. Groups too small to be worth that are gathered: their sorted values are one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorkit.operators.joins import balanced_join, measured_bytes

#: Groups of at most this many rows are gathered.
GATHERED_ROWS = 100_000
#: Bits of the first pass; of a later pass when all that are left would be too many values to send.
FIRST_BITS, NEXT_BITS = 22, 21
#: Values left in the searched ranges of a group up to which they are sent whole.
SENT_VALUES = 2_000_000
_PACKED = "code int, part int, place binary, bits binary, n binary"


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order; both zeros are one value."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double(u: int) -> float:
    u = u & ((1 << 63) - 1) if u >> 63 else ~u & ((1 << 64) - 1)
    return float(np.array([u], np.uint64).view(np.float64)[0])


def _sum_up(place: np.ndarray, bits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (place, bits), ascending."""
    order = np.lexsort((bits, place))
    place, bits, n = place[order], bits[order], n[order]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (bits[1:] != bits[:-1])
    at = np.flatnonzero(new)
    return place[at], bits[at], np.add.reduceat(n, at) if len(at) else n


def _packed(code: int, part: int, counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple:
    return code, part, *[np.ascontiguousarray(c).tobytes() for c in counts]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["code", "part", "place", "bits", "n"])


def _count(width: int, fixed: int, bits: int, searched: dict[int, list[np.ndarray]]) -> Callable:
    """Per task: for each group, counts of the next ``bits`` of each column's values whose first ``fixed`` bits are searched.

    ``searched`` has per group and column the ascending leading bits. A place is column * 2^16 + number of the
    leading bits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % 64
        held: dict[int, list] = {}
        size = 0
        for batch in batches:
            code = batch.column(0).to_numpy(zero_copy_only=False)
            values = [batch.column(1 + c).to_numpy(zero_copy_only=False) for c in range(width)]
            for g in np.unique(code):
                at = np.flatnonzero(code == g)
                for c in range(width):
                    x = values[c][at]
                    u = _ordered(x[~np.isnan(x)])
                    if fixed:
                        lead = u >> np.uint64(64 - fixed)
                        wanted = searched[int(g)][c]
                        slot = np.searchsorted(wanted, lead)
                        hit = slot < len(wanted)
                        hit[hit] = wanted[slot[hit]] == lead[hit]
                        u, slot = u[hit], slot[hit]
                    else:
                        slot = np.zeros(len(u), np.int64)
                    if not len(u):
                        continue
                    rest = (u << np.uint64(fixed)) >> np.uint64(64 - bits)
                    counts = _sum_up((slot + (c << 16)).astype(np.int32), rest, np.ones(len(u), np.int64))
                    held.setdefault(int(g), []).append(counts)
                    size += len(counts[0])
            if size > 4_000_000:
                held = {g: [_sum_up(*(np.concatenate(x) for x in zip(*h)))] for g, h in held.items()}
                size = sum(len(h[0][0]) for h in held.values())
                if size > 2_000_000:
                    yield _rows([_packed(g, part, h[0]) for g, h in held.items()])
                    held, size = {}, 0
        yield _rows([_packed(g, part, _sum_up(*(np.concatenate(x) for x in zip(*h)))) for g, h in held.items()])
    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = (np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("place", "bits", "n"))):
            new = [np.frombuffer(x, t) for x, t in zip(row, (np.int32, np.uint64, np.int64))]
            total = _sum_up(*(np.concatenate(x) for x in zip(total, new)))
    return total


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _rows([_packed(key[0].as_py(), 0, _unpack(batches))])


def _find(wanted: dict[int, list[tuple[int, int, int]]] | None, probs: list[float], width: int) -> Callable:
    """Where each wanted rank of a group lies: (code, place, rank, bits, rank among those bits, their count, values of the column)."""
    names = ["code", "place", "target", "bits", "rank", "count", "total"]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = key[0].as_py()
        place, bits, n = _unpack(batches)
        out = []
        for p in np.unique(place):
            some = place == p
            upto = np.cumsum(n[some])
            total = int(upto[-1])
            if wanted is None:
                ranks = sorted({r for q in probs for r in places(total, q)[:2]})
                targets = [(r, r) for r in ranks]
            else:
                targets = [(target, rank) for at, target, rank in wanted[code] if at == p]
            for target, rank in targets:
                i = int(np.searchsorted(upto, rank, side="right"))
                out.append((code, int(p), target, int(bits[some][i].astype(np.int64)), rank - int(upto[i] - n[some][i]), int(n[some][i]), total))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 7)], names=names)
    return run


def places(n: int, prob: float) -> tuple[int, int, float]:
    """Ranks (from 0) between which a quantile of ``n`` values lies, and its share of the way."""
    at = (n - 1) * prob
    first = int(np.floor(at))
    return first, min(first + 1, n - 1), at - first


def _large(rows: DataFrame, width: int, probs: list[float]) -> list[tuple[int, int, float, float, int]]:
    """(code, column, prob, value, n) of the groups ``code`` of ``rows`` (code, then a double per column)."""
    found_kind = "code long, place long, target long, bits long, rank long, count long, total long"

    def counted(fixed: int, bits: int, searched: dict, wanted: dict | None) -> list:
        parts = rows.mapInArrow(_count(width, fixed, bits, searched), _PACKED).groupBy("code", "part").applyInArrow(_merge, _PACKED)
        return parts.groupBy("code").applyInArrow(_find(wanted, probs, width), found_kind).collect()  # a row per wanted rank

    state, totals, fixed = {}, {}, FIRST_BITS
    for r in counted(0, FIRST_BITS, {}, None):
        state[r["code"], r["place"] >> 16, r["target"]] = (r["bits"], r["rank"], r["count"])
        totals[r["code"], r["place"] >> 16] = r["total"]
    while fixed < 64:
        searched: dict[int, list] = {}
        for code, column, target in state:
            searched.setdefault(code, [set() for _ in range(width)])[column].add(state[code, column, target][0])
        left: dict[int, int] = {}
        for code, column, lead, count in {(c, k, s[0], s[2]) for (c, k, _), s in state.items()}:
            left[code] = left.get(code, 0) + count
        bits = 64 - fixed if max(left.values(), default=0) <= SENT_VALUES else min(NEXT_BITS, 64 - fixed)
        searched = {code: [np.array(sorted(s), np.uint64) for s in columns] for code, columns in searched.items()}
        wanted: dict[int, list] = {}
        leads: dict[tuple[int, int], int] = {}
        for (code, column, target), (lead, rank, _) in state.items():
            place = (column << 16) + int(np.searchsorted(searched[code][column], np.uint64(lead)))
            wanted.setdefault(code, []).append((place, target, rank))
            leads[code, place] = lead
        state = {(r["code"], r["place"] >> 16, r["target"]): ((leads[r["code"], r["place"]] << bits) + r["bits"], r["rank"], r["count"])
                 for r in counted(fixed, bits, searched, wanted)}
        fixed += bits
    out = []
    for (code, column), n in totals.items():
        for p in probs:
            a, b, part = places(n, p)
            low, high = (_double(state[code, column, x][0]) for x in (a, b))
            out.append((code, column, p, low + (high - low) * part, n))
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: rows (``by``, feature, prob, value, n).

    A null group is a group; NaN counts as missing; a column without any value gives no row. Groups of up to
    ``GATHERED_ROWS`` rows are one row of sorted values; larger ones, of which there can't be many, are
    counted in two or three passes over their rows.
    """
    by, probs = list(by or []), [float(p) for p in probs]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = df.select(*by, *[value(c).alias(f"_x{i}") for i, c in enumerate(columns)])
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > GATHERED_ROWS)
    large = sizes.select(*by).collect()  # one row per GATHERED_ROWS rows at most
    spark, small, parts = df.sparkSession, rows, []
    if large:
        if by:
            fields = T.StructType([*[T.StructField(b, df.schema[b].dataType, True) for b in by], T.StructField("_code", T.IntegerType())])
            codes = spark.createDataFrame([(*r, i) for i, r in enumerate(large)], fields)
            tagged = balanced_join(rows, codes, by, "left", right_bytes=measured_bytes(codes), match_nulls=True)
            small = tagged.where("_code is null").drop("_code")
            big = tagged.where("_code is not null")
        else:
            small, big = None, rows.withColumn("_code", F.lit(0))
        found = _large(big.select("_code", *[f"_x{i}" for i in range(len(columns))]), len(columns), probs)
        table = spark.createDataFrame([(c, columns[k], p, v, n) for c, k, p, v, n in found], "_code int, feature string, prob double, value double, n long")
        if by:
            table = table.join(F.broadcast(codes), "_code")
        parts.append(table.select(*by, "feature", "prob", "value", "n"))
    if small is not None:
        parts.append(_gathered(small, columns, probs, by))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _gathered(rows: DataFrame, columns: list[str], probs: list[float], by: list[str]) -> DataFrame:
    """Quantiles of groups whose sorted values fit one row."""
    lists = rows.groupBy(*by).agg(*[F.sort_array(F.collect_list(f"_x{i}")).alias(f"_x{i}") for i in range(len(columns))])
    items = []
    for i, c in enumerate(columns):
        n = F.size(f"_x{i}").cast("long")
        for p in probs:
            at = (n - 1) * F.lit(p)
            first = F.floor(at)
            low, high = F.get(f"_x{i}", first.cast("int")), F.get(f"_x{i}", F.least(first + 1, n - 1).cast("int"))
            items.append(F.struct(F.lit(c).alias("feature"), F.lit(p).alias("prob"), (low + (high - low) * (at - first)).alias("value"), n.alias("n")))
    return lists.select(*by, F.inline(F.array(*items))).where("n > 0")


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Median of each column as a Python dict, one entry per column (None when all missing)."""
    found = {r["feature"]: r["value"] for r in exact_quantiles(df, columns, [0.5]).collect()}
    return {c: found.get(c) for c in columns}
