"""Synthetic minority rows between a row and its nearest neighbour of the same class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorkit.functions.values import hash_text, hash_unit
from anchorkit.operators.joins import balanced_join
from anchorkit.operators.neighbours import nearest_neighbours
from anchorkit.operators.prep import ranked_in_class

_BLOCK_ROWS = 4096


def nearest_in_class(points: DataFrame, *, key: str, label: str, vector: str) -> DataFrame:
    """(key, neighbour): exact Euclidean nearest other point of the class, ties by key.

    See :mod:`anchorkit.operators.neighbours`: blocks that the triangle inequality rules out are not
    compared, and no pair of points is ever written. A missing label is a class.
    """
    return nearest_neighbours(points, key=key, label=label, vector=vector, block_rows=_BLOCK_ROWS)[0]


def oversample(points: DataFrame, *, key: str, label: str, vector: str, seed: int = 42) -> DataFrame:
    """(key, label, vector, synthetic, source): every class filled up to the size of the largest.

    ``source`` is the key of the member a synthetic row starts from, missing for original rows; the
    synthetic row's own key is a negative number made from source and turn. A missing label is a class. A synthetic row lies at a random place between a class member and its nearest neighbour; the
    members take turns in a random order. Unchanged when a class has fewer than two rows.
    """
    sizes = points.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    same = points.select(key, label, F.col(vector).cast("array<double>").alias(vector), F.lit(False).alias("synthetic"),
                         F.lit(None).cast("long").alias("source")).withColumn(key, F.col(key).cast("long"))
    if not sizes or min(r["n"] for r in sizes) < 2:
        return same
    top = max(r["n"] for r in sizes)
    filled = [r[label] for r in sizes if r["n"] < top]
    is_small = F.col(label).isin([v for v in filled if v is not None])
    small = points.where(F.coalesce(is_small, F.lit(None in filled)))
    near = nearest_in_class(small, key=key, label=label, vector=vector)
    order = ranked_in_class(small, key, label, seed, "_rank")
    missing = F.lit(top) - F.col("n")
    turns = F.floor((missing - F.col("_rank") + F.col("n")) / F.col("n"))
    plan = order.withColumn("_turns", turns).where(F.col("_turns") > 0).select(
        key, label, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_turns"))).alias("_turn"))
    vectors = small.select(key, F.col(vector).cast("array<double>").alias("_x"))
    pairs = plan.join(near, key).join(vectors, key)
    # Copies of one point all name the same neighbour.
    made = balanced_join(pairs, vectors.select(F.col(key).alias("neighbour"), F.col("_x").alias("_y")), ["neighbour"])
    u = hash_unit(hash_text(seed, F.lit("gap"), F.col(key), F.col("_turn")))
    own = F.xxhash64(F.lit(seed), F.col(key), F.col("_turn")).bitwiseOR(F.lit(-(1 << 63)))
    synthetic = made.withColumn("_u", u).select(
        own.alias(key), label, F.zip_with("_x", "_y", lambda a, b: a + (b - a) * F.col("_u")).alias(vector), F.lit(True).alias("synthetic"), F.col(key).cast("long").alias("source"))
    return same.unionByName(synthetic)
