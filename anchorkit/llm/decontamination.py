"""Benchmark passages in training texts, found by spaced seeds and verified with substitutions allowed.

A seed is a fixed mask over 8 or 9 neighbouring tokens; the tokens at its ones are hashed and the others
ignored, so a changed word breaks only the windows where it stands under a one. The masks were chosen
together so that whatever tokens of an acceptable stretch are changed, one of them still fits (all
patterns were tried up to the length from which a part of the stretch is itself acceptable). Equal hashes of a
document and a benchmark item give a diagonal (how the two are laid on each other); tokens around the
hit are compared along it, and a stretch that is long and alike enough is an overlap. Around its hits a
document keeps as many tokens as the longest item has, so an item is always compared as a whole.

Hashes of a document are tested in the task against a bit filter of the benchmark's (fixed size), and
only what passes is joined; the join is by the whole hash and the comparison token by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorkit.llm.rows import named, numbered
from anchorkit.llm.slices import alone, slices
from anchorkit.llm.word_arrays import indices, word_arrays
from anchorkit.operators.joins import balanced_join
from anchorkit.session import staged

MASKS = ("111001101", "10111101", "100011111", "111100101", "101100111")
SPAN = 12
#: Items of fewer tokens than SPAN are looked up as a whole, without a change; under this number they say too little.
SHORTEST = 5
#: An overlap has so many equal tokens (or 4 of 5 of a shorter item's) and this share of them.
MIN_EQUAL, MIN_SHARE = 13, 0.8
#: A cluster of hits spans so many tokens of a text, or as many as the longest item has if that is more.
CLUSTER = 256
FILTER_BITS = 1 << 24
_PIECE = 1 << 15

_HITS = T.StructType([
    T.StructField("cluster", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("at", T.ArrayType(T.IntegerType())),
    T.StructField("hash", T.ArrayType(T.LongType()))])
_SEEDS = T.StructType([
    T.StructField("item", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType())),
    T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("hash", T.ArrayType(T.LongType()))])


@lru_cache(1 << 17)
def _token_hash(word: bytes) -> int:
    """Hash of a word in lower case without the signs around it, 0 for signs only."""
    token = word.decode("utf-8", "replace").lower()
    if not (token[0].isalnum() and token[-1].isalnum()):
        first = next((i for i, x in enumerate(token) if x.isalnum()), len(token))
        token = token[first:len(token) - next((j for j, x in enumerate(reversed(token)) if x.isalnum()), 0)]
    return xxhash.xxh64_intdigest(token.encode()) | 1 if token else 0


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (uint64) of the tokens of all texts, and the bounds of each text.

    A token is a word in lower case without the signs around it; a word of signs only is no token.
    """
    words, bounds = word_arrays(texts, lower=False)
    known = np.array([_token_hash(w) for w in words.dictionary.to_pylist()], np.uint64)
    found = known[indices(words)] if len(words) else np.zeros(0, np.uint64)
    kept = found != 0
    return found[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]


def seed_hashes(tokens: np.ndarray, bounds: np.ndarray, masks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask, the places where its window fits into a text and the hashes there."""
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(tokens))
    for number, mask in enumerate(masks):
        n = len(tokens) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, xxhash.xxh64_intdigest(mask.encode(), 1), np.uint64)
        for i, sign in enumerate(mask):
            if sign == "1":
                total = (total ^ tokens[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(29)
        places = np.flatnonzero(left[:n] >= len(mask))
        yield places, total[places]


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    first, second = hashes >> np.uint64(40), hashes & np.uint64(FILTER_BITS - 1)
    test = lambda p: (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    passed = test(first).astype(bool)
    at = np.flatnonzero(passed)
    passed[at] = test(second[at]).astype(bool)
    return passed


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and seed hashes of benchmark items."""
    alone("decontamination", _token_hash.cache_clear)
    for batch in batches:
        rows = []
        tokens, bounds = token_hashes(batch.column(1))
        for i, item in enumerate(batch.column(0).to_pylist()):
            own = tokens[bounds[i]:bounds[i + 1]]
            masks = list(MASKS) if len(own) >= SPAN else ["1" * len(own)] if len(own) >= SHORTEST else []
            at, hashes = [], []
            for places, found in seed_hashes(own, np.array([0, len(own)]), masks):
                at += places.tolist()
                hashes += _signed(found)
            rows.append((item, _signed(own), at, hashes))
        yield _batch(rows, _SEEDS)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}
    kind = lambda t: pa.list_(kinds[t.elementType]) if isinstance(t, T.ArrayType) else kinds[t]
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kind(f.dataType)) for c, f in zip(columns, schema)], schema.fieldNames())


def _finder(bits, masks: list[str], reach: int):
    """Hits that pass the filter, in clusters with ``reach`` tokens on either side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("decontamination", _token_hash.cache_clear)
        held = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                own = batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part))
                at += len(part)
                tokens, bounds = token_hashes(part)
                places, hashes = [], []
                for p, h in seed_hashes(tokens, bounds, masks):
                    passed = _passes(held, h)
                    places.append(p[passed])
                    hashes.append(h[passed])
                if places:
                    text, found = _clusters(tokens, bounds, np.concatenate(places), np.concatenate(hashes), reach)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(text, pa.int64())) for c in own), *found.columns],
                                                     ["row", "key", *found.schema.names])
            batch = part = own = None  # else it is held until the next one is read
    return run


def _clusters(tokens: np.ndarray, bounds: np.ndarray, places: np.ndarray, hashes: np.ndarray,
              reach: int) -> tuple[list[int], pa.RecordBatch]:
    """Number of the text, and the row of _HITS, of every cluster."""
    order = np.argsort(places, kind="stable")
    places, hashes = places[order], hashes[order]
    text = np.searchsorted(bounds, places, side="right") - 1
    # a cluster ends with its text, where hits are far apart, and every so many tokens of the text, so that it stays small
    cut = (np.diff(text) != 0) | (np.diff(places) > reach) | (np.diff((places - bounds[text]) // max(CLUSTER, reach)) != 0)
    starts = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(places)]]) if len(places) else np.array([0])
    out, owner = [], []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        t = int(text[a])
        low, high = max(int(bounds[t]), int(places[a]) - reach), min(int(bounds[t + 1]), int(places[b - 1]) + reach)
        start = low - int(bounds[t])
        owner.append(t)
        out.append((int(places[a]) - int(bounds[t]), start, _signed(tokens[low:high]),
                    (places[a:b] - low).tolist(), _signed(hashes[a:b])))
    return owner, _batch(out, _HITS)


def compare(doc: np.ndarray, item: np.ndarray, shift: int, share: float = MIN_SHARE) -> tuple[int, int, int, int]:
    """Best stretch where ``item[i]`` lies on ``doc[i + shift]``: equal tokens, tokens, and its begin in doc and item.

    Of all stretches with the wanted share of equal tokens, the one with most equal tokens; of these the
    shortest, then the first. It begins and ends with an equal token.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high <= low:
        return 0, 0, 0, 0
    same = doc[low + shift:high + shift] == item[low:high]
    wanted = Fraction(share).limit_denominator(1 << 20)
    equal = np.concatenate([[0], np.cumsum(same)])
    sums = equal * wanted.denominator - np.arange(len(equal)) * wanted.numerator
    # for every end, the first begin with no higher sum: none has more equal tokens
    begin = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    found = equal - equal[begin]
    ends = np.flatnonzero(found == found.max())
    first, last = np.searchsorted(equal, equal[begin[ends]], side="right") - 1, np.searchsorted(equal, equal[ends])
    best = int(np.argmin(last - first))
    at = int(first[best])
    return int(found.max()), max(0, int(last[best]) - at), at + low + shift, at + low


def _comparer(share: float):
    @F.arrow_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("equal", "length", "begin", "item_begin")]))
    def compared(doc: pa.Array, item: pa.Array, shift: pa.Array) -> pa.Array:
        found = [compare(np.asarray(d.values), np.asarray(i.values), s.as_py(), share) for d, i, s in zip(doc, item, shift)]
        columns = list(zip(*found)) or [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], ["equal", "length", "begin", "item_begin"])
    return compared


def _filter_bits(hashes: DataFrame) -> bytes:
    """The bit filter of a table of hashes; FILTER_BITS / 8 bytes however many there are."""
    first = F.call_function("shiftrightunsigned", F.col("hash"), F.lit(40))
    place = F.explode(F.array(first, F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")))).alias("p")
    pieces = hashes.select(place).groupBy(F.floor(F.col("p") / _PIECE).alias("piece")).agg(
        F.bitmap_construct_agg((F.col("p") % _PIECE)).alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in pieces:
        out[r["piece"] * _PIECE // 8:(r["piece"] + 1) * _PIECE // 8] = r["bits"]
    return bytes(out)


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
             min_equal: int = MIN_EQUAL, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per row of ``docs`` and benchmark item that overlap.

    Columns: ``row`` (a long per row of ``docs``), ``key`` (of ``docs``), ``item``, ``equal`` (equal
    tokens of the best stretch), ``length`` (its tokens), ``begin`` (its first token in the document),
    ``places`` (stretches found). A stretch counts with at least ``min_equal`` equal tokens, or 4 of 5 of
    an item's tokens where that is less, and a share of ``min_share`` of its length; items of 5 to 11
    tokens must be there as they are. Null and empty texts and items, null item ids and items of under 5
    tokens overlap nothing. Repeated items count as one, repeated documents and null keys as rows.
    """
    spark = docs.sparkSession
    known = items.select(named(items, item).cast("long").alias("item"), F.coalesce(named(items, item_text), F.lit("")).alias("t"))
    seeds = staged(known.where("item is not null").distinct().mapInArrow(_seeds, _SEEDS), "benchmark-seeds")
    size = F.size("tokens")
    hashes = seeds.select("item", size.alias("n"), F.explode(F.arrays_zip("hash", "at")).alias("s")).select(
        "item", "n", "s.hash", F.col("s.at").alias("item_at"))
    sizes = seeds.agg(F.collect_set(F.when(size.between(SHORTEST, SPAN - 1), size)).alias("short"), F.max(size).alias("reach")).first()
    bits = spark.sparkContext.broadcast(_filter_bits(hashes))
    texts = docs.select(F.monotonically_increasing_id(), F.coalesce(named(docs, text), F.lit("")), named(docs, key).alias("key"))
    schema = T.StructType([T.StructField("row", T.LongType()), texts.schema["key"], *_HITS.fields])
    masks = [*MASKS, *("1" * n for n in sorted(sizes["short"]))]
    hits = staged(texts.mapInArrow(_finder(bits, masks, sizes["reach"] or 0), schema), "benchmark-hits")
    each = hits.select("row", "cluster", "start", F.explode(F.arrays_zip("hash", "at")).alias("s")).select(
        "row", "cluster", "s.hash", (F.col("start") + F.col("s.at")).alias("doc_at"))
    # the tokens of any one of its clusters hold a diagonal as a whole, so one is enough
    laid = balanced_join(each, hashes.distinct(), ["hash"]).groupBy(
        "row", "item", "n", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.min("cluster").alias("cluster"))
    first = F.greatest(F.col("shift"), F.lit(0))
    own = F.slice("tokens", (first - F.col("start") + 1).cast("int"), (F.col("shift") + F.col("n") - first).cast("int"))
    laid = laid.join(hits.select("row", "key", "cluster", "start", "tokens"), ["row", "cluster"]).select(
        "row", "key", "item", own.alias("doc_tokens"), first.alias("start"), F.least(F.col("shift"), F.lit(0)).cast("int").alias("shift"))
    laid = balanced_join(laid, seeds.select("item", "tokens"), ["item"])
    found = laid.withColumn("c", _comparer(min_share)("doc_tokens", "tokens", "shift"))
    need = F.when(size < SPAN, size).otherwise(F.least(F.lit(min_equal), F.ceil(size * 0.8)))
    good = found.where(F.col("c.equal") >= need)
    best = F.max(F.struct(F.col("c.equal").alias("equal"), (-F.col("c.begin") - F.col("start")).alias("before"), F.col("c.length").alias("length")))
    out = good.groupBy("row", "key", "item").agg(best.alias("b"), F.count_distinct(F.col("c.begin") + F.col("start")).alias("places"))
    return out.select("row", "key", "item", "b.equal", "b.length", (-F.col("b.before")).alias("begin"), "places")


def without_benchmark(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that overlap no item; all columns stay."""
    stored, row = numbered(docs, "benchmark-docs")
    hit = staged(overlaps(stored, items, row, text, **options).select(F.col("key").alias(row)).distinct(), "benchmark-rows")
    return stored.join(hit, row, "left_anti").drop(row)
