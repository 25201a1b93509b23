"""How many other stays of the same unit are under way when a stay starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorkit.checks import require_columns
from anchorkit.functions.values import micros
from anchorkit.operators.joins import balanced_join, measured_bytes
from anchorkit.operators.running import bucket_of, order_borders, running_total
from anchorkit.session import staged


def occupancy(stays: DataFrame, *, stay: str = "stay_id", unit: str = "first_careunit", start: str = "intime",
              end: str = "outtime") -> DataFrame:
    """(stay, concurrent_patients, occupancy_rate, occupancy_percentile).

    Concurrent are the *other* stays of the unit with ``start <= t < end`` at the own start ``t``:
    a simultaneous start counts, a stay ending exactly then does not. A stay that does not end
    after its start (or never ends) occupies nothing but is still scored; one without a start
    is left out. Rate is the share of the unit's highest count, percentile the percent rank in
    the unit.

    Starts and ends are counted per (unit, time) and summed up along time in buckets, so a unit
    holding most stays is spread over tasks; nothing pairs stays with each other.
    """
    require_columns(stays, [stay, unit, start, end], "stays")
    rows = stays.where(F.col(start).isNotNull()).select(
        stay, F.coalesce(F.col(unit).cast("string"), F.lit("Unknown")).alias("_unit"), micros(start).alias("_t"),
        micros(end).alias("_end"), F.coalesce(F.col(end) > F.col(start), F.lit(False)).cast("int").alias("_holds"),
    )
    change = F.array(
        F.struct(F.col("_t").alias("at"), F.col("_holds").cast("long").alias("delta"),
                 F.col("_holds").cast("long").alias("full"), (1 - F.col("_holds")).cast("long").alias("empty")),
        F.struct(F.col("_end").alias("at"), F.lit(-1).cast("long").alias("delta"),
                 F.lit(0).cast("long").alias("full"), F.lit(0).cast("long").alias("empty")),
    )
    changes = rows.select("_unit", F.explode(
        F.when(F.col("_holds") == 1, change).otherwise(F.slice(change, 1, 1))).alias("_c"))
    at_time = changes.groupBy("_unit", F.col("_c.at").alias("_t")).agg(
        F.sum("_c.delta").alias("_delta"), F.sum("_c.full").alias("_full"), F.sum("_c.empty").alias("_empty"))
    borders = order_borders(rows, "_t")
    active = running_total(at_time, ["_unit"], "_t", "_delta", "_active", bucket_of("_t", borders))
    # One cell per (unit, start time, occupies): all its stays share one count.
    cells = active.select("_unit", "_t", F.explode(F.array(
        F.struct(F.lit(1).alias("holds"), (F.col("_active") - 1).alias("others"), F.col("_full").alias("n")),
        F.struct(F.lit(0).alias("holds"), F.col("_active").alias("others"), F.col("_empty").alias("n")),
    )).alias("_c")).select("_unit", "_t", F.col("_c.holds").alias("_holds"), F.col("_c.others").alias("_others"),
                           F.col("_c.n").alias("_n")).where(F.col("_n") > 0)
    cells = staged(cells, "occupancy")
    spread = cells.groupBy("_unit", "_others").agg(F.sum("_n").alias("_n"))
    size = cells.groupBy("_unit").agg(F.sum("_n").alias("_size"), F.max("_others").alias("_peak"))
    # The counts are as few as the busiest moment has stays.
    levels = running_total(spread, ["_unit"], "_others", "_n", "_upto").join(size, "_unit").select(
        "_unit", "_others",
        F.coalesce(F.try_divide(F.col("_others"), F.col("_peak")), F.lit(0.0)).alias("occupancy_rate"),
        F.coalesce(F.try_divide(F.col("_upto") - F.col("_n"), F.col("_size") - 1), F.lit(0.0))
        .alias("occupancy_percentile"),
    )
    # Sizes are taken from the stored cells: the joined tables have their keys plus two numbers.
    two = [F.lit(0.0).alias("_r"), F.lit(0.0).alias("_p")]
    level_bytes = measured_bytes(cells.select("_unit", "_others", *two).distinct())
    cell_bytes = measured_bytes(cells.select("_unit", "_t", "_holds", "_others", *two))
    scored = balanced_join(cells.drop("_n"), levels, ["_unit", "_others"], right_bytes=level_bytes)
    joined = balanced_join(rows.select(stay, "_unit", "_t", "_holds"), scored, ["_unit", "_t", "_holds"], right_bytes=cell_bytes)
    return joined.select(stay, F.col("_others").alias("concurrent_patients"), "occupancy_rate", "occupancy_percentile")
