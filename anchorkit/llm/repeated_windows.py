"""Removal of word windows that occur before, found by a count-min sketch and settled by exact grouping.

First pass: each task counts its windows in a sketch of two rows of cells, each count held at two. Only
cells that were met are sent, cut into ranges of cells; a range's counts of all tasks are added up, and
what is left of it is one bit per cell, "two or more", in a file of its own below the shared folder. A
window counts at most what its smallest cell counts, so a window that occurs twice always has both bits
set. Second pass: windows whose bits (read from the mapped files) are set, and no others, are grouped by
96 bits of their hash; the first place of a group stays. The sketch grows with the text up to a largest
size; beyond it more single windows pass its test and the second pass groups them too, so the
result never depends on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorkit.llm.rows import fresh, named
from anchorkit.llm.shared_files import folder_uri, mapped, write_whole
from anchorkit.llm.slices import slices, tidy
from anchorkit.llm.word_arrays import indices, word_arrays
from anchorkit.operators.joins import balanced_join
from anchorkit.session import scratch_path, shuffle_width, staged

#: Words of a window.
WINDOW = 20
#: Cells of a row of the sketch are at most 2 to this power (8 GB of bits); the least is 2^16.
MOST_BITS = 36
LEAST_BITS = 16
#: A row of the sketch is cut into at most this many ranges.
RANGES = 1024
ROWS = 2
#: Windows a task holds before it sends them on.
HELD = 1 << 19
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_FOUND = "k1 long, spot long, doc long, tag long"
_NO_DOC = np.iinfo(np.int64).max
_SETTLED = 1 << 31


def _rolled(values: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes (mod 2^64) of all runs of ``size`` values, put together from runs of powers of two."""
    out, held, length, run, power = None, 0, 1, values, base
    while True:
        if size & length:
            if out is None:
                out, held = run, length
            else:
                n = len(values) - held - length + 1
                out = out[:n] * power + run[held:held + n]
                held += length
        if held == size:
            return out
        run = run[:-length] * power + run[length:]
        power = power * power
        length *= 2


def window_hashes(texts: pa.Array, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Two 64-bit hashes, text number and start of every window, in order; then all words and each text's bounds among them."""
    words, bounds = word_arrays(texts, lower=False)
    at = indices(words)
    none = np.zeros(0, np.int64)
    if len(at) < size:
        return none.view(np.uint64), none.view(np.uint64), none, none, words, bounds
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.dictionary.to_pylist())), np.uint64).reshape(-1, 2)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    n = len(at) - size + 1
    inside = np.flatnonzero(text[:n] == text[size - 1:])
    with np.errstate(over="ignore"):
        h1, h2 = (_rolled(both[at, i], size, _BASES[i])[inside] for i in range(2))
        h1 = (h1 ^ h1 >> np.uint64(32)) * _MIX
        h2 = (h2 ^ h2 >> np.uint64(29)) * _MIX
    return h1, h2, text[inside], inside - bounds[:-1][text[inside]], words, bounds


@dataclass(frozen=True)
class Sketch:
    """Cells of a row, power of two of a range's cells, and (once merged) where the ranges' bits lie and which there are."""

    cells: int
    power: int
    folder: str = ""
    ranges: frozenset = frozenset()

    @staticmethod
    def of(cells: int) -> Sketch:
        return Sketch(cells, max(LEAST_BITS, (-(-cells // RANGES) - 1).bit_length()))

    def row(self, row: int, h: np.ndarray) -> np.ndarray:
        """Cells of hashes in a row; the rows' ranges follow one another."""
        return h % np.uint64(self.cells) + np.uint64(row * (-(-self.cells >> self.power) << self.power))

    def hits(self, cells: np.ndarray, files: dict[int, np.ndarray]) -> np.ndarray:
        """Whether each cell's bit is set; ``files`` keeps the mapped ranges."""
        order = np.argsort(cells)
        part = (cells[order] >> np.uint64(self.power)).astype(np.int64)
        firsts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        out = np.zeros(len(cells), bool)
        for a, b in zip(firsts, np.append(firsts[1:], len(part))):
            number = int(part[a])
            if number not in self.ranges:
                continue
            if number not in files:
                files[number] = mapped(self.folder, f"{number:05d}")
            low = cells[order[a:b]] & np.uint64((1 << self.power) - 1)
            out[order[a:b]] = files[number][low >> np.uint64(3)] >> (np.uint64(7) - (low & np.uint64(7))).astype(np.uint8) & 1
        return out


def _packed(cells: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as differences, byte by byte: all but the low bytes are nearly all zero."""
    return np.diff(cells, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
    return np.cumsum(steps, dtype=np.int64)


def _met(sketch: Sketch, size: int, most: int) -> Callable:
    """Per task: cells met once and cells met more often, by ranges of cells."""
    def ranges(cells: np.ndarray) -> pa.RecordBatch:
        cells = np.sort(cells)
        at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        many = np.diff(np.append(at, len(cells))) > 1
        cells = cells[at]
        part = (cells >> np.uint64(sketch.power)).astype(np.int32)
        firsts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        low = (cells & np.uint64((1 << sketch.power) - 1)).astype(np.uint32)
        once, often = [], []
        for a, b in zip(firsts, np.append(firsts[1:], len(cells))):
            here = many[a:b]
            once.append(_packed(low[a:b][~here]))
            often.append(_packed(low[a:b][here]))
        return pa.RecordBatch.from_arrays([pa.array(part[firsts]), pa.array(once, pa.binary()), pa.array(often, pa.binary())],
                                          names=["part", "once", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for row in range(ROWS):
                yield ranges(np.concatenate([sketch.row(row, h[row]) for h in held]))

        for batch in batches:
            for texts in slices(batch.column(0)):
                h1, h2, *_ = window_hashes(texts, size)
                if len(h1):
                    held.append((h1, h2))
                    n += len(h1)
                if n >= 4 * most:
                    yield from sent()
                    held, n = [], 0
        if held:
            yield from sent()
        del held
        tidy()
    return run


def _merged(sketch: Sketch, folder: str) -> Callable:
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes the bits "two or more" of a range; tasks' counts are added up as they come."""
        counts = np.zeros(1 << sketch.power, np.uint8)
        for batch in batches:
            for once, often in zip(*(batch.column(c).to_pylist() for c in ("once", "often"))):
                at = _unpacked(once)
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[_unpacked(often)] = 2
        part = key[0].as_py()
        bits = np.packbits(counts > 1)
        any_ = bool(bits.any())
        if any_:
            write_whole(folder, f"{part:05d}", bits.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part] * any_, pa.int32())], names=["part"])
    return run


def repeated_cells(texts: DataFrame, size: int = WINDOW, most_bits: int = MOST_BITS, held: int = HELD) -> Sketch:
    """The merged sketch of a one-column table of texts.

    A row has a cell for every two bytes of text (some three for a window), up to the largest size.
    """
    if not LEAST_BITS <= most_bits <= MOST_BITS:
        raise ValueError(f"a row has 2^{LEAST_BITS} to 2^{MOST_BITS} cells")
    text = texts.columns[0]
    total = texts.agg(F.sum(F.octet_length(named(texts, text)).cast("long")).alias("n")).first()["n"] or 0
    sketch = Sketch.of(min(max(1 << LEAST_BITS, int(total) // 2), 1 << most_bits))
    folder = folder_uri(scratch_path(texts.sparkSession, "window-sketch"))
    met = texts.mapInArrow(_met(sketch, size, held), "part int, once binary, often binary")
    # one number per range that has a bit set
    found = met.groupBy("part").applyInArrow(_merged(sketch, folder), "part int").collect()
    return replace(sketch, folder=folder, ranges=frozenset(r["part"] for r in found))


def _candidates(sketch: Sketch, size: int, most: int) -> Callable:
    """Windows that the sketch takes for repeated; a task settles its own repetitions and sends one of each on."""
    def chunk(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h1, h2, doc, tag, start = (np.concatenate(x) for x in zip(*held))
        h2 = (h2 >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((tag, start, doc, h2, h1))
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        first = order[np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(order)), 0))]
        d, t, s = doc[order], tag[order], start[order]
        later = (d != doc[first]) | (s != start[first])
        # a row that occurs again has nothing to add
        again = np.append(False, same & (d[1:] == d[:-1]) & (s[1:] == s[:-1]) & (t[1:] == t[:-1]))
        # in the order of the texts, where neighbours have much in common and shuffle files stay small
        lead, rest = np.sort(order[~later & ~again]), order[later & ~again]
        rest = rest[np.lexsort((start[rest], tag[rest], doc[rest]))]
        d, t, s = doc[rest], tag[rest], start[rest]
        breaks = np.ones(len(rest), bool)
        breaks[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + size)
        at = np.flatnonzero(breaks)
        last = np.append(at[1:], len(rest))[:len(at)] - 1
        # runs that are settled go by keys of their own: they need no group, only a way to their document
        spread = (d[at].astype(np.uint64) * _BASES[0] ^ s[at].astype(np.uint64)) * _MIX
        ids = np.concatenate([doc[lead], d[at]])
        # a spot is 32 bits of hash and the first word's place; of a settled run its number of words, a flag and the place
        high = np.concatenate([h2[lead], (s[last] + size - s[at]).astype(np.uint32)]).astype(np.uint64) << np.uint64(32)
        low = np.concatenate([start[lead], s[at] | _SETTLED]).astype(np.uint64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([h1[lead], spread]).view(np.int64)), pa.array((high | low).view(np.int64)),
            pa.array(ids, mask=ids == _NO_DOC), pa.array(np.concatenate([tag[lead], t[at]]))], names=[x.split()[0] for x in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[int, np.ndarray] = {}
        held, n = [], 0
        for batch in batches:
            doc, tag = (batch.column(i).fill_null(_NO_DOC).to_numpy() for i in (1, 2))
            base = 0
            for texts in slices(batch.column(0)):
                h1, h2, text, start, *_ = window_hashes(texts, size)
                at = np.flatnonzero(sketch.hits(sketch.row(0, h1), files))
                at = at[sketch.hits(sketch.row(1, h2[at]), files)]
                if len(at):
                    of = text[at] + base
                    held.append((h1[at], h2[at], doc[of], tag[of], start[at]))
                    n += len(at)
                base += len(texts)
                if n >= most:
                    yield chunk(held)
                    held, n = [], 0
        if held:
            yield chunk(held)
        del held
        tidy()
    return run


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _ranges(begins: pa.Array, lengths: pa.Array) -> pa.Array:
    """Begins and ends (one after the other) of the unions of overlapping or touching ranges, per row."""
    out = []
    for a, n in zip(begins, lengths):
        a, n = a.values.to_numpy().astype(np.int64), n.values.to_numpy()
        order = np.argsort(a, kind="stable")
        a, reach = a[order], np.maximum.accumulate((a + n)[order])
        cut = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
        out.append(np.stack([a[cut], reach[np.append(cut[1:], len(a)) - 1]], 1).reshape(-1).astype(np.int32))
    return pa.array(out, pa.list_(pa.int32()))


def repeated_ranges(rows: DataFrame, size: int = WINDOW, most_bits: int = MOST_BITS, held: int = HELD) -> DataFrame:
    """Ranges of words to remove: (doc, tag, ranges) for documents of ``rows`` (text, doc long, tag long) that have any."""
    sketch = repeated_cells(rows.select(rows.columns[0]), size, most_bits, held)
    found = rows.mapInArrow(_candidates(sketch, size, held), _FOUND)
    # dealt by the first hash alone, as packed as it comes: 16 bytes of a window don't compress
    found = found.repartition(shuffle_width(rows.sparkSession), "k1")
    low = F.col("spot").bitwiseAND(F.lit((1 << 32) - 1))
    found = found.select("k1", F.shiftright("spot", 32).cast("int").alias("high"), (low >= _SETTLED).alias("settled"),
                         low.bitwiseAND(F.lit(_SETTLED - 1)).cast("int").alias("begin"), "doc", "tag")
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "begin")
    group = W.partitionBy("k1", "high").orderBy("settled", F.col("doc").asc_nulls_last(), "begin").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = found.withColumns({"place": place, "least": F.first(place).over(group)})
    removed = found.where(F.col("settled") | (F.col("place") > F.col("least")))
    length = F.when(F.col("settled"), F.col("high")).otherwise(size).cast("long")
    spot = F.shiftleft(F.col("begin").cast("long"), 32).bitwiseOR(length)
    lists = removed.groupBy("doc", "tag").agg(F.collect_list(spot).alias("spots"))
    begins = F.transform("spots", lambda x: F.shiftright(x, 32).cast("int"))
    lengths = F.transform("spots", lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    return lists.select("doc", "tag", _ranges(begins, lengths).alias("ranges"))


@F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
def _without(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """Words of each text, words inside its ranges, and the others joined by one space."""
    parts, base = [], 0
    for some in slices(texts):
        words, bounds = word_arrays(some, lower=False)
        kept = np.ones(len(words), bool)
        for i, r in enumerate(ranges.slice(base, len(some))):
            if r.is_valid:
                at = r.values.to_numpy() + bounds[i]
                step = np.zeros(bounds[i + 1] - bounds[i] + 1, np.int32)
                np.add.at(step, at[::2] - bounds[i], 1)
                np.add.at(step, at[1::2] - bounds[i], -1)
                kept[bounds[i]:bounds[i + 1]] = np.cumsum(step[:-1]) == 0
        upto = np.concatenate([[0], np.cumsum(kept)])[bounds]
        lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), words.dictionary.take(pa.array(indices(words)[kept])))
        n = np.diff(bounds)
        parts.append(pa.StructArray.from_arrays(
            [pa.array(n), pa.array(n - np.diff(upto)), pc.binary_join(lists, b" ").cast(pa.string())], names=["n_words", "n_removed", "kept"]))
        base += len(some)
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))


def remove_repeated(df: DataFrame, key: str = "doc_id", text: str = "text", to: str = "dedup", size: int = WINDOW,
                    most_bits: int = MOST_BITS, held: int = HELD) -> DataFrame:
    """``df`` plus the struct ``to`` (n_words, n_removed, kept): the text without words that some earlier equal window covers.

    A window is ``size`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one text. It is removed if the same words
    start earlier: in a smaller ``key`` (long; null is larger than all), or in the same key at an earlier place. Rows
    of one key are one document in this order; at equal places neither comes first, so repeated rows
    keep or lose the same words. Windows are judged on the input. Null, empty and short texts lose
    nothing. An existing column ``to`` is replaced; every row stays.
    """
    doc, tag, ranges = (fresh(df, x) for x in ("doc_key", "doc_tag", "doc_ranges"))
    df = df.withColumns({doc: named(df, key).cast("long"), tag: F.xxhash64(named(df, text))})
    # a key with several texts, as all rows without a key are, needs the texts' hashes to tell its rows apart
    shared = df.groupBy(doc).agg(F.min(tag).alias("low"), F.max(tag).alias("high")).where(F.col(doc).isNull() | (F.col("low") != F.col("high")))
    shared = staged(shared.select(doc, F.lit(True).alias("shared")), "shared-keys")
    several = fresh(df, "shared")
    df = balanced_join(df, shared.withColumnRenamed("shared", several), [doc], "left", match_nulls=True)
    df = df.withColumn(tag, F.when(F.col(several), F.col(tag)).otherwise(F.lit(0))).drop(several)
    found = staged(repeated_ranges(df.select(named(df, text), doc, tag), size, most_bits, held), "repeated-ranges")
    found = found.select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("ranges").alias(ranges))
    size_held = found.agg(F.sum(24 + 4 * F.size(ranges)).alias("n")).first()["n"] or 0
    out = balanced_join(df, found, [doc, tag], "left", right_bytes=int(size_held), match_nulls=True)
    return out.withColumn(to, _without(named(out, text), F.col(ranges))).drop(doc, tag, ranges)
