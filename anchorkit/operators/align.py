"""Time-tolerance alignment of several series of one entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorkit.functions.values import micros


def band_minima(events: DataFrame, *, entity: str, item: str, time: str, value: str, base, others: list,
                tolerance_seconds: int) -> DataFrame:
    """For each distinct base time the lowest value of every other item within the tolerance.

    Rows: (entity, base_time in microseconds, base_value, m0, m1, ...), closed band
    [t - tol, t + tol]. Time is cut into blocks as long as the band, so a band touches two
    neighbouring blocks: the minimum is the lower of a suffix minimum in the left block and a
    prefix minimum in the right one. Windows therefore hold one block of one entity, with linear
    frames, and readings at the same time are merged beforehand.
    """
    tol = tolerance_seconds * 1_000_000
    block = 2 * tol
    wanted = [base, *others]
    series = (
        events.where(F.col(item).isin(wanted) & F.col(value).isNotNull() & F.col(time).isNotNull())
        .groupBy(F.col(entity).alias("_e"), micros(time).alias("_t"))
        .agg(*[F.min(F.when(F.col(item) == w, F.col(value))).alias(f"_v{i}") for i, w in enumerate(wanted)])
    )
    other = [f"_v{i}" for i in range(1, len(wanted))]
    none = F.lit(None).cast("long")
    # Every row offers its values; a base row also asks at both ends of its band.
    offer = F.struct(F.col("_t").alias("at"), none.alias("left_of"), none.alias("right_of"),
                     *[F.col(c).alias(c) for c in other])
    blank = [F.lit(None).cast("double").alias(c) for c in other]
    left = F.struct((F.col("_t") - tol).alias("at"), F.col("_t").alias("left_of"), none.alias("right_of"), *blank)
    right = F.struct((F.col("_t") + tol).alias("at"), none.alias("left_of"), F.col("_t").alias("right_of"), *blank)
    series = series.select("_e", "_t", *[F.col(f"_v{i}").cast("double").alias(f"_v{i}") for i in range(len(wanted))])
    rows = series.select("_e", F.col("_v0").alias("_base"), F.explode(
        F.when(F.col("_v0").isNull(), F.array(offer)).otherwise(F.array(offer, left, right))).alias("_p"))
    flat = rows.select("_e", "_base", "_p.*").withColumn("_block", F.floor(F.col("at") / F.lit(block)))
    cell = W.partitionBy("_e", "_block").orderBy("at")
    before = cell.rangeBetween(W.unboundedPreceding, W.currentRow)
    after = cell.rangeBetween(W.currentRow, W.unboundedFollowing)
    probed = flat.select(
        "_e", "_base", "left_of", "right_of",
        *[F.when(F.col("left_of").isNotNull(), F.min(c).over(after))
          .when(F.col("right_of").isNotNull(), F.min(c).over(before)).alias(c) for c in other],
    ).where(F.col("left_of").isNotNull() | F.col("right_of").isNotNull())
    return probed.groupBy(F.col("_e").alias(entity), F.coalesce("left_of", "right_of").alias("base_time")).agg(
        F.min("_base").alias("base_value"), *[F.min(c).alias(f"m{i}") for i, c in enumerate(other)])


def band_aligned_min(events: DataFrame, *, entity: str, item: str, time: str, value: str, base, others: list,
                     tolerance_seconds: int, out: str = "aligned_min") -> DataFrame:
    """Lowest ``base + sum of others`` over aligned tuples, per entity with at least one tuple.

    The other items are not tied to each other, so the minimum of the sum over all tuples of a
    base reading is the base value plus each item's own minimum.
    """
    minima = band_minima(events, entity=entity, item=item, time=time, value=value, base=base, others=others,
                         tolerance_seconds=tolerance_seconds)
    total: Column = reduce(lambda a, b: a + b, [F.col("base_value"), *[F.col(f"m{i}") for i in range(len(others))]])
    return minima.withColumn("_s", total).where(F.col("_s").isNotNull()).groupBy(entity).agg(F.min("_s").alias(out))
