"""Own and donor rows of a permutation side by side, each row shuffled once.

A repeat orders the keys twice at random, and the rows of equal rank are a pair. Rows travel to the cell of
their hash (a range of the own order); how many hashes lie below a range is counted beforehand, so a donor's
rank is known to a small range of hashes and it travels straight to the cell it is paired in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from anchorkit.functions.values import hash_bucket, hash_text
from anchorkit.session import staged

#: Rows of a cell, on average; donors are counted in this many ranges per cell.
CELL_ROWS, RANGES = 100_000, 16


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash; per place the first place of its key, and the rows of that key (0: a null key, which meets nothing)."""
    held = pa.concat_arrays(table["_h"].chunks).cast(pa.binary(16))
    hashed = np.frombuffer(held.buffers()[1], ">u8")[2 * held.offset:2 * (held.offset + len(held))].reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((hashed[:, 1], hashed[:, 0]))
    hashed = hashed[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashed[1:] != hashed[:-1]).any(axis=1)
    of = np.cumsum(new) - 1
    null = table["_null"].to_numpy()[order]
    return order, np.flatnonzero(new)[of], np.where(null, 0, np.bincount(of)[of])


def _pairs(schema: pa.Schema):
    def run(own: pa.Table, donors: pa.Table) -> pa.Table:
        if not own.num_rows or not donors.num_rows:
            return schema.empty_table()
        order, first, rows = _ordered(own)
        order2, first2, rows2 = _ordered(donors)
        base = int(donors["_off"][int(order2[0])].as_py())  # place of the first donor in this cell
        place = np.arange(max(0, base), min(len(order), base + len(order2)))
        first, rows, first2, rows2 = first[place], rows[place], first2[place - base], rows2[place - base]
        # rows that share a key stand for each other
        n = rows * rows2
        at = np.repeat(np.arange(len(place)), n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        left = own.select(schema.names[:-1]).take(order[first[at] + within // rows2[at]])
        return left.append_column(schema.field(len(schema.names) - 1), pc.take(donors["_d"], pa.array(order2[first2[at] + within % rows2[at]])))
    return run


def permuted_pairs(scored: DataFrame, key: str, columns: list[str], donated: str, repeats: int, seed: int, n: int) -> DataFrame:
    """(repeat, ``columns``, _d): every row of the ``n`` in ``scored`` with the ``donated`` value of the row of its rank, ``repeats`` times."""
    cells = max(1, -(-n // CELL_ROWS))
    ranges = cells * RANGES if cells > 1 else 1
    repeat = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))

    def rows(tag: str, parts: int, *keep: str) -> DataFrame:
        hashed = scored.select(repeat.alias("repeat"), key, *keep).withColumn("_hex", hash_text(seed, F.lit(tag), F.col("repeat"), F.col(key)))
        return hashed.select("repeat", F.floor(hash_bucket(F.col("_hex"), 7) * (parts / 16.0**7)).cast("int").alias("_part"), F.unhex("_hex").alias("_h"),
                             F.col(key).isNull().alias("_null"), *keep)

    def starts(tag: str, parts: int) -> DataFrame:
        sizes = rows(tag, parts).groupBy("repeat", "_part").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(W.partitionBy("repeat").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
        return sizes.withColumn("_from", F.coalesce(before, F.lit(0)))

    to, of = starts("own", cells).alias("to"), starts("donor", ranges).alias("of")
    meet = (F.col("to.repeat") == F.col("of.repeat")) & (F.col("to._from") < F.col("of._from") + F.col("of._n")) & (
        F.col("of._from") < F.col("to._from") + F.col("to._n"))
    routes = staged(to.join(of, meet).select("of.repeat", "of._part", (F.col("of.repeat") * cells + F.col("to._part")).alias("_cell"),
                                             (F.col("of._from") - F.col("to._from")).alias("_off")), "routes")
    own = rows("own", cells, *columns).withColumn("_cell", F.col("repeat") * cells + F.col("_part")).drop("_part")
    donors = rows("donor", ranges, donated).join(F.broadcast(routes), ["repeat", "_part"]).select("_cell", "_off", "_h", "_null", F.col(donated).alias("_d"))
    schema = T.StructType([own.schema["repeat"], *[scored.schema[c] for c in columns], T.StructField("_d", scored.schema[donated].dataType)])
    return own.groupBy("_cell").cogroup(donors.groupBy("_cell")).applyInArrow(_pairs(to_arrow_schema(schema)), schema)
