"""Running totals and tie ranks over range partitions: one sort, no borders, no join of the rows.

Rows are dealt by ranges of (group, order), so that a task holds a run of the sorted rows, and each
task adds up its own run. Only a task's first group (and its first and last value) can reach into
other tasks, so all that is missing is a few numbers per task, which are settled on the driver and
broadcast back. A large group is cut like any other run of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorkit.operators.joins import _on_keyed, keyed
from anchorkit.session import shuffle_width, staged


def _changes(columns: list[pa.Array], n: int) -> np.ndarray:
    """Where a row differs from the one before in any of ``columns`` (nulls are equal, so are NaNs); the first row does."""
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(c.type):  # not a number is one value, as in Spark
            differ = differ & ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return new


def _plain(value):
    """A value that is equal to itself."""
    return "NaN" if isinstance(value, float) and value != value else value


def _same(row: tuple | None, columns: list[pa.Array]) -> bool:
    return row is not None and all(_plain(a) == _plain(c[0].as_py()) for a, c in zip(row, columns))


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartitionByRange(shuffle_width(df.sparkSession), *[F.col(k) for k in keys]).sortWithinPartitions(*keys)


def _locals(by: list[str], weight: str) -> Callable:
    """Running sums inside each group of a task's run; the task's number and the row's place in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, last, carry = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = [batch.column(c) for c in by]
            w = batch.column(weight).to_numpy(zero_copy_only=False)
            new = _changes(groups, n)
            new[0] = not _same(last, groups) if seen else True
            total = np.cumsum(w)
            starts = np.flatnonzero(new)
            before = np.zeros(n, total.dtype)
            before[starts] = total[starts] - w[starts]
            if not new[0]:
                before[0] = -carry
            base = before[np.maximum.accumulate(np.where(new | (np.arange(n) == 0), np.arange(n), 0))]
            local = total - base
            last, carry = tuple(c[n - 1].as_py() for c in groups), local[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(local), pa.array(np.full(n, task, np.int32)), pa.array(np.arange(seen, seen + n))],
                names=[*batch.schema.names, "_local", "_task", "_at"])
            seen += n
    return run


def _with_broadcast(df: DataFrame, rows: list[tuple], schema: T.StructType, keys: list[str]) -> DataFrame:
    """Left join with ``rows`` (a few per task) on null-safe ``keys``."""
    small = keyed(df.sparkSession.createDataFrame(rows, schema), keys)
    return _on_keyed(df, F.broadcast(small), keys, "left")


def range_totals(df: DataFrame, by: list[str], order: list[str], weight: str, out: str) -> DataFrame:
    """Inclusive running sum of ``weight`` by ``order`` inside each ``by`` group; a null in ``by`` is a group, a null order comes first.

    ``df`` has one row per (``by``, ``order``). One exchange; the result is a written table.
    """
    kind = df.schema[weight].dataType
    schema = T.StructType([*df.schema.fields, T.StructField("_local", kind), T.StructField("_task", T.IntegerType()), T.StructField("_at", T.LongType())])
    local = staged(_dealt(df, [*by, *order]).mapInArrow(_locals(by, weight), schema), "range-totals")
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    ends = local.groupBy("_task").agg(F.min_by(group, "_at").alias("first"), F.max_by(group, "_at").alias("last"), F.max_by("_local", "_at").alias("total"))
    offsets, before = [], None
    for row in sorted(ends.collect(), key=lambda r: r["_task"]):  # a row per task
        offset = before[1] if before and before[0] == row["first"] else 0
        if offset:
            offsets.append((row["_task"], *(row["first"] if by else ()), offset))
        before = (row["last"], row["total"] + (offset if row["first"] == row["last"] else 0))
    rows = local.drop("_at")
    if offsets:
        fields = [T.StructField("_task", T.IntegerType()), *[df.schema[b] for b in by], T.StructField("_offset", kind)]
        fields = [T.StructField(f.name, f.dataType, True) for f in fields]
        rows = _with_broadcast(rows, offsets, T.StructType(fields), ["_task", *by])
        rows = rows.withColumn("_local", F.col("_local") + F.coalesce("_offset", F.lit(0).cast(kind))).drop("_offset")
    return rows.withColumnRenamed("_local", out).drop("_task")


def _ties(by: list[str], value: str, weight: str) -> Callable:
    """Per row of a task's run: weight of smaller values of its group, and of its own value; a value's rows are held until it ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, group, before = TaskContext.get().partitionId(), 0, None, 0
        held: list[pa.RecordBatch] = []

        def done(rows: pa.RecordBatch) -> pa.RecordBatch:
            """``rows`` are whole values; ``group`` and ``before`` go on from the rows sent so far."""
            nonlocal seen, group, before
            n = rows.num_rows
            groups = [rows.column(c) for c in by]
            w = rows.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            new_group = _changes(groups, n)
            goes_on = seen > 0 and _same(group, groups)
            new_value = new_group | _changes([rows.column(value)], n)
            starts = np.flatnonzero(new_value)
            tie = np.add.reduceat(w, starts)
            of = np.cumsum(new_value) - 1
            upto = np.concatenate([[0], np.cumsum(w)])[starts]
            base = np.where(new_group[starts], upto, 0)
            base = base[np.maximum.accumulate(np.where(new_group[starts], np.arange(len(starts)), 0))]
            less = upto - base
            if goes_on:
                first = np.flatnonzero(new_group[starts])
                less[:first[1] if len(first) > 1 else len(starts)] += before
            group, before = tuple(c[n - 1].as_py() for c in groups), int(less[-1] + tie[-1])
            out = pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(less[of]), pa.array(tie[of]), pa.array(np.full(n, task, np.int32)), pa.array(np.arange(seen, seen + n))],
                names=[*rows.schema.names, "_less", "_tie", "_task", "_at"])
            seen += n
            return out

        def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=1 << 62)[0]

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _changes([batch.column(c) for c in (*by, value)], n)
            last = int(np.flatnonzero(new)[-1])
            if held and not _same(tuple(held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in (*by, value)), [batch.column(c) for c in (*by, value)]):
                yield done(joined(held))
                held = []
            if last > 0:
                yield done(joined([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield done(joined(held))
    return run


def tie_ranks(df: DataFrame, by: list[str], value: str, spread: list[str], weight: str, out: str) -> DataFrame:
    """``df`` plus the average rank of ``value`` inside its ``by`` group; a row stands for ``weight`` (whole number) rows.

    Equal values share the mean of their places. ``spread`` are further columns of a row's key, which let
    a value of many rows reach over several tasks. Nulls in ``by`` are groups; values aren't null. One
    exchange; the result is a written table. A task holds a value's rows in its own range at once.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in ("_less", "_tie")],
                           T.StructField("_task", T.IntegerType()), T.StructField("_at", T.LongType())])
    local = staged(_dealt(df, [*by, value, *spread]).mapInArrow(_ties(by, value, weight), schema), "tie-ranks")
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    ends = local.groupBy("_task").agg(
        F.min_by(group, "_at").alias("g0"), F.min_by(value, "_at").alias("v0"), F.min_by("_tie", "_at").alias("t0"),
        F.max_by(group, "_at").alias("g1"), F.max_by(value, "_at").alias("v1"), F.max_by("_tie", "_at").alias("t1"), F.max_by("_less", "_at").alias("l1"))
    tasks = sorted(ends.collect(), key=lambda r: r["_task"])  # a row per task
    shifts, fixes, before = [], {}, None
    # the value a task ends with: group, value, weight so far, weight of smaller values, tasks it lies in, value as it is
    open_: tuple | None = None

    def close(value_open: tuple | None) -> None:
        if value_open and len(value_open[4]) > 1:
            for task in value_open[4]:
                fixes[task, value_open[0], value_open[1]] = (value_open[3], value_open[2], value_open[5])

    for r in tasks:
        shift = before[1] if before and before[0] == r["g0"] else 0
        if shift:
            shifts.append((r["_task"], r["g0"], shift))
        v0, v1 = _plain(r["v0"]), _plain(r["v1"])
        alone = (r["g0"], v0) == (r["g1"], v1)
        if open_ and open_[:2] == (r["g0"], v0):
            open_ = (*open_[:2], open_[2] + r["t0"], open_[3], [*open_[4], r["_task"]], r["v0"])
        elif alone:
            close(open_)
            open_ = (r["g0"], v0, r["t0"], shift, [r["_task"]], r["v0"])
        else:
            close(open_)
            open_ = None
        upto = r["l1"] + r["t1"] + (shift if r["g0"] == r["g1"] else 0)
        if not alone:
            close(open_)
            open_ = (r["g1"], v1, r["t1"], upto - r["t1"], [r["_task"]], r["v1"])
        before = (r["g1"], upto)
    close(open_)
    rows, nullable = local.drop("_at"), lambda f: T.StructField(f.name, f.dataType, True)
    names = [nullable(df.schema[b]) for b in by]
    task, number = T.StructField("_task", T.IntegerType()), T.LongType()
    if shifts:
        table = [(t, *(g if by else ()), s) for t, g, s in shifts]
        rows = _with_broadcast(rows, table, T.StructType([task, *names, T.StructField("_shift", number)]), ["_task", *by])
        rows = rows.withColumn("_less", F.col("_less") + F.coalesce("_shift", F.lit(0))).drop("_shift")
    if fixes:
        table = [(t, *(g if by else ()), v, less, tie) for (t, g, _), (less, tie, v) in fixes.items()]
        schema = T.StructType([task, *names, nullable(df.schema[value]), T.StructField("_less2", number), T.StructField("_tie2", number)])
        rows = _with_broadcast(rows, table, schema, ["_task", *by, value])
        rows = rows.withColumns({"_less": F.coalesce("_less2", "_less"), "_tie": F.coalesce("_tie2", "_tie")}).drop("_less2", "_tie2")
    return rows.withColumn(out, F.col("_less") + (F.col("_tie") + 1) / 2.0).drop("_less", "_tie", "_task")
