"""SimHash fingerprints, links between those that differ in few bits, and connected groups.

Search by deletion variants: 64 bits are cut into so few segments that two fingerprints within the
distance agree on one segment up to a single bit (2 segments of 32 bits for distance 3). Every segment
is indexed as it is and with each of its bits left out, so that an equality join brings all such pairs
together; the whole distance is verified in the join. Values that many fingerprints share are cut
again: within one value the rest of the bits holds the remaining distance, and the same scheme is used
on it, until a value holds few fingerprints. No value's pairs are all written out, none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorkit.llm.rows import fresh, named, numbered
from anchorkit.llm.slices import alone
from anchorkit.operators.joins import balanced_join
from anchorkit.session import shuffle_width, staged


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the words ``[^\\x20\\x09-\\x0D]+`` of ``text`` with A-Z in lower case, as a signed long.

    A bit is one if it is one in over half of the shingles' XXH64 (seed 42). A text with fewer words
    than a shingle is one shingle; a text without words has the fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:n - 1].tolist()]
    last = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, last)], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(shingle: int):
    """Column function from texts to fingerprints (long, never null)."""
    @F.arrow_udf(T.LongType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        alone("simhash")
        for batch in batches:
            yield pa.array([fingerprint(x.as_py(), shingle) for x in batch], pa.int64())
    return run


#: A value of more fingerprints than this is cut again; the join of a value writes its square at most.
MOST = 64


def _cut(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (fp, start, path) once per half of the ``width`` bits from ``start`` and bit left out of it, or none.

    Adds ``key``: which half, which bit, and what is left of the half; ``other``: where the other half starts.
    """
    half = width // 2
    out = rows.withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(2 * half + 1))))
    which, bit = F.floor(F.col("kind") / (half + 1)).cast("int"), (F.col("kind") % (half + 1)) - 1
    at = F.col("start") + which * half
    value = F.call_function("shiftrightunsigned", F.col("fp"), at).bitwiseAND(F.lit((1 << half) - 1).cast("long"))
    left_out = F.when(bit >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long"))
    kept = value.bitwiseAND(F.bitwise_not(left_out))
    return out.select("fp", "path", F.call_function("shiftleft", F.col("kind").cast("long"), F.lit(32)).bitwiseOR(kept).alias("key"),
                      (F.col("start") + (1 - which) * half).alias("other"))


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _pairs(rows: DataFrame, width: int, distance: int, most: int) -> list[DataFrame]:
    """Tables (a, b) of the pairs within ``distance`` among rows of one ``path``; every pair is in one of them at least."""
    index = _cut(rows, width)
    keys = ["path", "key"]
    # all values are summed up before a row is moved; most have one fingerprint and go no further
    counts = staged(index.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                    .where("n > 1"), "simhash-values")
    found = [counts.where((F.col("n") == 2) & _near(F.col("a"), F.col("b"), distance)).select("a", "b")]
    shared = counts.where("n > 2").select(*keys, "n")
    sizes = shared.agg(F.count(F.lit(1)).alias("any"), F.max("n").alias("top")).first()
    if not sizes["any"]:
        return found
    members = staged(balanced_join(index, shared, keys), "simhash-members")
    # 8 bits and the three left out are all that differ in a value of the last cut: 2,048 fingerprints at most
    last = width <= 16
    few = members if last else members.where(F.col("n") <= most)
    one, two = few.select(*keys, F.col("fp").alias("a")), few.select(*keys, F.col("fp").alias("b"))
    found.append(one.join(two, keys).where((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b"), distance)).select("a", "b"))
    if not last and sizes["top"] > most:
        path = F.concat_ws(".", "path", F.col("key").cast("string"))
        hot = members.where(F.col("n") > most).select("fp", F.col("other").alias("start"), path.alias("path"))
        found += _pairs(hot, width // 2, distance, most)
    return found


def links(nodes: DataFrame, fingerprint_col: str = "fp", distance: int = 3, most: int = MOST) -> DataFrame:
    """Distinct pairs ``a < b`` of different fingerprints of ``nodes`` (long) that differ in ``distance`` bits at most.

    Null fingerprints have no links; repeated ones count once.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments find distances up to 3")
    rows = nodes.select(F.col(fingerprint_col).alias("fp")).where("fp is not null").distinct()
    # written fingerprints fill few files, but each becomes 66 rows: dealt out again before that
    rows = staged(rows, "simhash-nodes").repartition(shuffle_width(nodes.sparkSession)).select("fp", F.lit(0).alias("start"), F.lit("").alias("path"))
    return staged(reduce(DataFrame.unionByName, _pairs(rows, 64, distance, most)).distinct(), "simhash-links")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of ``pairs`` (a, b); root is the smallest node of its component.

    Every round hangs neighbours on the smallest known one: first the larger neighbours of every node
    (large star), then the smaller ones (small star), until nothing changes; rounds grow with the
    logarithm of the nodes. Each round is a written table; nothing but two numbers reaches the driver.
    """
    edges = staged(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now := (seen["n"], seen["h"])) == mark or not seen["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        mark = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = balanced_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = balanced_join(large, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v")))
        edges = staged(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3,
                    keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` (default: all) plus ``fingerprint`` (long), ``component_id`` and ``is_first``.

    Rows whose fingerprints are linked, directly or through others, form a component; equal
    fingerprints (repeated rows, all texts without words, nulls) do too. component_id is its smallest
    ``key`` (null if all are null); is_first marks one row of it: smallest key, then first in the table.
    Columns of ``df`` with the new names are replaced. Every row stays.
    """
    own = ("fingerprint", "component_id", "is_first")
    keep = [c for c in (keep or df.columns) if c.lower() not in own]
    rows = df.select(*[named(df, c).alias(c) for c in keep], named(df, key).alias(fresh(df, "group_key")),
                     fingerprints(shingle)(named(df, text)).alias("fingerprint"))
    group_key = rows.columns[-2]
    rows, row = numbered(rows, "simhash-rows")
    least = F.min(F.struct(F.col(group_key).isNull().alias("none"), F.col(group_key).alias("key"), F.col(row).alias("row")))
    nodes = staged(rows.groupBy(F.col("fingerprint").alias("node")).agg(least.alias("least")), "simhash-first")
    roots = components(links(nodes, "node", distance))
    placed = staged(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "simhash-roots")
    firsts = placed.groupBy("root").agg(F.min("least").alias("first"))
    # a component of many fingerprints is joined apart if it is hot
    labels = balanced_join(placed.select("root", "node"), firsts, ["root"]).select(
        F.col("node").alias("fingerprint"), F.col("first.key").alias("component_id"), F.col("first.row").alias("first_row"))
    first_row = fresh(rows, "first_row")
    labels = staged(labels, "simhash-labels").withColumnRenamed("first_row", first_row)
    out = balanced_join(rows, labels, ["fingerprint"])
    return out.select(*[named(out, c).alias(c) for c in keep], "fingerprint", "component_id",
                      (F.col(row) == F.col(first_row)).alias("is_first"))
