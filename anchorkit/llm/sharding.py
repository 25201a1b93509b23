"""Uniform shuffle of a table into shards of exact size, by a hypergeometric communication matrix.

Three steps, as in distributed random permutation by exact counts:

1. how many rows each input partition sends to each shard is drawn as a whole, so that it has the
   law it would have under a uniform permutation (multivariate hypergeometric, row by row);
2. every partition permutes its rows and deals them out by those counts;
3. every shard permutes what it got.

Any assignment of rows to (shard, slot) with those shard sizes is equally likely. The matrix has
partitions x shards numbers and is the only thing the driver holds; rows move once to be permuted
in their partition and once to their shard. A shard isn't sorted in one task: its rows are ordered
by a random number, cut by that number's leading bits, and numbered inside the pieces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorkit.llm.rows import fresh, numbered
from anchorkit.operators.joins import balanced_join

#: Rows of a shard numbered in one task, on average.
PIECE_ROWS = 200_000


def exact_sizes(total: int, shards: int) -> list[int]:
    """Shard sizes at most one apart, larger ones first."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows each partition (``counts``) sends to each shard (``sizes``), drawn uniformly; both margins are exact."""
    draw, left = np.random.default_rng(seed), np.array(sizes, dtype=np.int64)
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        rest, pool = n, int(left.sum())
        for s in range(len(sizes)):  # one shard after the other: hypergeometric given what is left
            pool -= int(left[s])
            out[p, s] = _hypergeometric(draw, int(left[s]), pool, rest)
            rest -= int(out[p, s])
        left -= out[p]
    return out


def _hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Number of good ones among ``sample`` drawn from ``good + bad``.

    Pools beyond the generator's range (1e9) are drawn by inverting the distribution function over
    the mode and 40 standard deviations around it, from the ratios of neighbouring terms.
    """
    if min(good, sample) == 0:
        return 0
    if bad == 0:
        return sample
    if max(good, bad) < 1_000_000_000:
        return int(draw.hypergeometric(good, bad, sample))
    share = good / (good + bad)
    reach = int(40 * (sample * share * (1 - share)) ** 0.5) + 40
    mode = (sample + 1) * (good + 1) // (good + bad + 2)
    low, high = max(0, sample - bad, mode - reach), min(good, sample, mode + reach)
    at = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - at) + np.log(sample - at) - np.log(at + 1) - np.log(bad - sample + at + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    odds = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(odds, draw.random() * odds[-1], side="right"))


def _matrix_frame(spark: SparkSession, blocks: list[int], matrix: np.ndarray) -> DataFrame:
    """One row per (block, shard) with rows: local positions ``lo`` (in) to ``hi`` (out)."""
    ends = matrix.cumsum(axis=1)
    rows = [(int(b), [int(x) for x in ends[i]]) for i, b in enumerate(blocks)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("b", T.IntegerType()), T.StructField("ends", T.ArrayType(T.LongType()))]))


def uniform_shards(df: DataFrame, shards: int, seed: int = 0, shard_col: str = "shard", slot_col: str = "slot",
                   piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to ``shards - 1``) and ``slot`` (long, gapless from 0 in each shard).

    Every row of ``df`` is in the result once; nulls, repeated rows and equal texts are rows like any
    other and go their own ways. Shard sizes differ by one at most; with fewer rows than shards the
    last shards are empty, and an empty table gives an empty result. Columns of ``df`` that are named
    like the new ones are replaced. Same seed and same input partitions give the same result.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = df.sparkSession
    df = df.drop(shard_col, slot_col)
    block = fresh(df, "block_no")
    stored, row = numbered(df.withColumn(block, F.spark_partition_id()), "shard-rows")
    counted = sorted((r[block], r["n"]) for r in stored.groupBy(block).agg(F.count(F.lit(1)).alias("n")).collect())
    sizes = exact_sizes(sum(n for _, n in counted), shards)
    matrix = communication_matrix([n for _, n in counted], sizes, seed)
    sent = _matrix_frame(spark, [b for b, _ in counted], matrix).withColumnRenamed("b", block)

    local, moved, ends = (fresh(df, x) for x in ("local_no", "moved_key", "block_ends"))
    # permute locally: the place of a row among its block, in the order of a random number
    dealt = stored.withColumn(local, F.row_number().over(Window.partitionBy(block).orderBy(
        F.xxhash64(F.lit(seed), F.lit("local"), F.col(row)), F.col(row))) - 1)
    dealt = balanced_join(dealt, sent.withColumnRenamed("ends", ends), [block])
    dealt = dealt.withColumn(shard_col, F.size(F.filter(F.col(ends), lambda e: e <= F.col(local))).cast("int"))

    # permute what a shard got: order by another random number, in pieces by its leading bits
    pieces = max(1, -(-max(sizes) // piece_rows))
    piece = fresh(df, "piece_no")
    key = F.xxhash64(F.lit(seed), F.lit("moved"), F.col(row))
    cut = F.floor((key.cast("double") + 2.0**63) / 2.0**64 * pieces).cast("int")
    dealt = dealt.withColumn(moved, key).withColumn(piece, F.least(cut, F.lit(pieces - 1))).drop(local, ends, block)
    inner = Window.partitionBy(shard_col, piece).orderBy(moved, row)
    if pieces == 1:
        return dealt.withColumn(slot_col, (F.row_number().over(inner) - 1).cast("long")).drop(moved, piece, row)
    held = fresh(df, "piece_start")
    tally = dealt.groupBy(shard_col, piece).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(shard_col).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.select(shard_col, piece, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(held))
    placed = dealt.withColumn(slot_col, F.row_number().over(inner) - 1).join(starts, [shard_col, piece])
    return placed.withColumn(slot_col, (F.col(slot_col) + F.col(held)).cast("long")).drop(moved, piece, row, held)
