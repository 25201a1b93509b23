"""Running totals and ranks that no single task has to sort.

A window over a whole group puts that group into one task. Here the order key is cut into
buckets by approximate quantiles over all groups; a window runs inside each (group, bucket) and
the totals of the earlier buckets are added. Bucket borders steer balance only, never the result.
"""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorkit.functions.values import hash_bucket, quoted, sql_literal
from anchorkit.operators.joins import same_join
from anchorkit.operators.quantiles import exact_medians, exact_quantiles  # noqa: F401  their old place
from anchorkit.operators.ranges import range_totals
from anchorkit.session import shuffle_width

_MAX_BUCKETS = 4096


def order_borders(df: DataFrame, order: str, buckets: int | None = None) -> list:
    """At most ``buckets - 1`` ascending border values of a numeric order column (eager)."""
    n = min(buckets or shuffle_width(df.sparkSession), _MAX_BUCKETS)
    if n < 2:
        return []
    probs = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(order, probs, max(1000, 20 * n)).alias("b")).first()["b"]
    return sorted({b for b in found or [] if not isinstance(b, float) or isfinite(b)})


def bucket_of(order: str, borders: list) -> Column:
    """Number of borders at or below the value, by binary search over a literal array."""
    if not borders:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(borders).bit_length()))]
    array = "array(" + ", ".join(sql_literal(b) for b in borders) + ")"
    return F.expr(
        f"aggregate(array({', '.join(map(str, steps))}), 0, (low, step) -> "
        f"CASE WHEN get({array}, low + step - 1) <= {quoted(order)} THEN low + step ELSE low END)")


def running_total(df: DataFrame, by: list[str], order: str, weight: str, out: str = "running",
                  bucket: Column | None = None, ties: list[str] | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` by ``order`` inside each ``by`` group.

    ``df`` has one row per (``by``, ``order``, ``ties``); a NULL in ``by`` is a group. ``bucket`` may give
    a bucket that never falls while ``order`` rises (a hash prefix, say); otherwise borders are
    found with one aggregate over ``df``.
    """
    if bucket is None:
        bucket = bucket_of(order, order_borders(df, order))
    tagged = df.withColumn("_bucket", bucket)
    cell = [*by, "_bucket"]
    local = tagged.withColumn(
        "_local",
        F.sum(weight).over(
            W.partitionBy(*cell).orderBy(order, *(ties or [])).rowsBetween(W.unboundedPreceding, W.currentRow)
        ),
    )
    totals = tagged.groupBy(*cell).agg(F.sum(weight).alias("_total"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    carry = totals.select(
        *cell,
        F.coalesce(
            F.sum("_total").over(group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_carry"),
    )
    return (
        same_join(local, carry, cell)
        .withColumn(out, F.col("_local") + F.col("_carry"))
        .drop("_bucket", "_local", "_carry")
    )


def value_ranks(df: DataFrame, by: list[str], value: str, counts: list[Column] | None = None,
                weight: str | None = None) -> DataFrame:
    """One row per distinct value with its count ``n`` and average rank ``avg_rank``.

    Equal values are counted on the map side first, so a value holding a third of all rows
    travels as one partial row per task; the counts are then added up over ranges of the values. ``counts`` adds aggregates of the tied rows; ``weight``
    names a column saying how many rows one row stands for.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    tied = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(size.alias("n"), *(counts or []))
    ranked = range_totals(tied, by, [value], "n", "_upto")
    return ranked.withColumn("avg_rank", F.col("_upto") - (F.col("n") - 1) / 2.0).drop("_upto")


def hash_ranks(df: DataFrame, by: list[str], hashed: str, ties: list[str], out: str = "rank") -> DataFrame:
    """Rank 1..n of each row of a group in the order of a hex hash column.

    The leading digits of the hash are the bucket, so even one group of all rows is spread.
    """
    weighted = df.withColumn("_one", F.lit(1).cast("long"))
    # four buckets per shuffle partition, sixteen values a digit
    digits = max(3, -(-(4 * shuffle_width(df.sparkSession) - 1).bit_length() // 4))
    return running_total(weighted, by, hashed, "_one", out, hash_bucket(F.col(hashed), digits), ties).drop("_one")
