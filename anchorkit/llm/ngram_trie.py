"""Three-word language model as an Elias-Fano trie in mapped files.

Levels, each cut into shards by a hash so that a shard is built in one task and holds a bounded number
of entries on average:

* words: sorted 64-bit hashes; a word's number is its rank over all shards. Counts beside them;
* pairs, by first word: sorted first words, pointers to their successors, the successors;
* triples, by first two words: sorted pairs, pointers, successors. A successor isn't stored as a word
  but as its place among the successors of the second word (always there, as the triple's last two
  words are a pair), which are far fewer numbers than there are words.

All of these are monotone sequences in Elias-Fano code. Probabilities are interpolated absolute
discounting, P(w | uv) = max(c(uvw) - d, 0) / c(uv) + d n(uv) / c(uv) P(w | v), down to add-one for
single words; their logarithms, and those of the weights d n / c, are stored as 8-bit numbers of a
code book per shard. A triple is looked up by finding the place of the last word among the second
word's successors and searching that place among the successors of the pair.

Files lie below the shared folder. Where that is a mounted path tasks map them; from other stores
they are read. Only counts of shards and totals reach the driver.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorkit.llm import elias_fano as ef
from anchorkit.llm.rows import named
from anchorkit.llm.slices import slices, tidy
from anchorkit.llm.word_arrays import indices, word_arrays, xxh64
from anchorkit.session import scratch_path, staged

DISCOUNT = 0.75
#: Tokens per shard of a level, and words per shard of the first.
SHARD_TOKENS, SHARD_WORDS = 1_000_000, 2_000_000
#: Triples gathered before a task hands them on.
CHUNK_TOKENS = 1_000_000
#: Bytes of text handled at once.
SLICE = 8 << 20
#: Entries looked up at once while a level is built.
BLOCK = 300_000
#: The token at the end of every text has this hash; no word hashes to it.
END = 0
BLOBS = "shard int, kind string, data binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)


# ---- files

def _write(folder: str, name: str, data: bytes) -> None:
    """A whole file under its name, or none: a task that runs twice writes the same file twice."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, f"{path}/{name}")


def _read(folder: str, name: str) -> dict[str, np.ndarray]:
    fs, path = pa.fs.FileSystem.from_uri(folder)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return ef.from_buffer(np.asarray(np.memmap(f"{path}/{name}", np.uint8, "r")))
    with fs.open_input_file(f"{path}/{name}") as f:
        return ef.from_buffer(np.frombuffer(f.read(), np.uint8))


def _uri(path: str) -> str:
    return path if ":/" in path else "file://" + os.path.abspath(path)


def _blob(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays with their bytes in planes, compressed; sorted ones as differences."""
    out = io.BytesIO()
    for k, v in arrays.items():
        v = np.ascontiguousarray(np.diff(v, prepend=v[:1] * 0) if k == "context" else v)
        raw = v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes() if len(v) else b""
        packed = pa.compress(raw, "zstd", asbytes=True) if raw else b""
        out.write(len(raw).to_bytes(8, "little") + len(packed).to_bytes(8, "little") + packed)
    return out.getvalue()


def _array(data: pa.Buffer, kinds: dict[str, type], name: str) -> np.ndarray:
    """One array of a blob; the others stay packed."""
    at = 0
    for k, kind in kinds.items():
        size, packed = np.frombuffer(data, np.int64, 2, at).tolist()
        if k == name:
            raw = pa.decompress(data.slice(at + 16, packed), size, "zstd", asbytes=True) if size else b""
            v = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
            return np.cumsum(v, dtype=kind) if k == "context" else v
        at += 16 + packed
    raise KeyError(name)


# ---- words

def _hashes(words: pa.DictionaryArray) -> np.ndarray:
    """64-bit hashes of the distinct words; two words share one with a chance of 2^-64 a pair."""
    return np.maximum(xxh64(words.dictionary), np.uint64(1))


def _halves(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of pairs kept as numbers plus one in one 64-bit number."""
    return (key >> np.uint64(32)).astype(np.int64) - 1, (key & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys by shard, in order within one, and where each shard's begin."""
    shard = _spread(keys, shards)
    if shards <= 1 << 16:  # sorted by counting
        shard = shard.astype(np.uint16)
    return np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _spread(values: np.ndarray, shards: int) -> np.ndarray:
    mixed = (values.astype(np.uint64) + np.uint64(1)) * _MIX
    return ((mixed ^ mixed >> np.uint64(31)) % np.uint64(shards)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Where a trained model lies, and its totals."""

    folder: str
    starts: tuple[int, ...]
    words: int
    tokens: int
    shards: int


class Words:
    """Numbers and counts of words, from their hashes."""

    def __init__(self, model: Model) -> None:
        self._starts = np.array(model.starts, np.int64)
        shards = len(model.starts)
        self._shift = np.uint64(64 - (shards.bit_length() - 1)) if shards > 1 else None
        self._held = [_read(model.folder, f"words-{i}") if n else None for i, n in enumerate(np.diff([*model.starts, model.words]))]
        self._codes = [h and ef.EliasFano(ef.part("hash", h)) for h in self._held]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and training count of each hash."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> self._shift).astype(np.int64) if self._shift is not None else np.zeros(len(hashes), np.int64)
        for i in np.unique(shard).tolist():
            if self._codes[i] is None:
                continue
            own = np.flatnonzero(shard == i)
            at = self._codes[i].find(hashes[own])
            hit = at >= 0
            number[own[hit]] = at[hit] + self._starts[i]
            count[own[hit]] = self._held[i]["count"][at[hit]]
        return number, count


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task's texts by their hashes, summed in chunks."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        hashes, back = _distinct(np.concatenate([h for h, _ in held]))
        n = np.bincount(back, weights=np.concatenate([n for _, n in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["hash", "n"])

    for batch in batches:
        for part in slices(batch.column(0), SLICE):
            words, _ = word_arrays(part)
            counts = np.bincount(indices(words), minlength=len(words.dictionary))
            held.append((np.append(_hashes(words), np.uint64(END)), np.append(counts, len(part))))
            size += len(counts)
            if size > CHUNK_TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _word_shard(folder: str):
    def write(key: tuple, table: pa.Table) -> pa.Table:
        hashes = table["hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        arrays = ef.named("hash", ef.encode(hashes[order], 1 << 64))
        arrays["count"] = table["n"].to_numpy()[order].astype(np.int64)
        _write(folder, f"words-{key[0].as_py()}", ef.to_bytes(arrays))
        return pa.table({"shard": [key[0].as_py()], "n": [len(hashes)]}, schema=pa.schema([("shard", pa.int32()), ("n", pa.int64())]))
    return write


# ---- counts of triples

_LOADED: dict[str, object] = {}


def _loaded(kind: type, model: Model):
    """The reader of a model in this Python worker."""
    key = f"{kind.__name__} {model.folder}"
    if key not in _LOADED:
        for old in [k for k in _LOADED if not k.endswith(model.folder)]:
            del _LOADED[old]
        _LOADED[key] = kind(model)
    return _LOADED[key]


def _numbers(words: Words, part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts, each with its end token, their training counts, and the bounds."""
    coded, bounds = word_arrays(part)
    number, count = words.find(np.append(_hashes(coded), np.uint64(END)))
    place = np.concatenate([indices(coded), [len(number) - 1]])
    take = np.insert(np.arange(len(coded)), bounds[1:], len(coded))
    place = place[take]
    return number[place], count[place], bounds + np.arange(len(bounds))


_TRIPLES = {"context": np.uint64, "size": np.uint32, "word": np.uint32, "count": np.uint32}
_PAIRS = {"context": np.uint64, "size": np.uint32, "word": np.uint32, "count": np.uint64, "follow": np.uint64, "kinds": np.uint64}


def _ordered(key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, the sorted keys, and the rank of each sorted key beside its word in one number."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    keys = key[new]
    del key
    both = np.cumsum(new, dtype=np.uint64)
    both -= np.uint64(1)
    both <<= np.uint64(32)
    both |= word[order]
    return order, keys, both


def _summed(key: np.ndarray, word: np.ndarray, count: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (key, word) as one with the sum of counts (None: one each), sorted."""
    order, keys, both = _ordered(key, word)
    del key, word
    if count is None:
        del order
        both.sort()
    else:
        inner = np.argsort(both)
        both = both[inner]
        order = order[inner]
        del inner
        count = count[order]
        del order
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    sums = np.diff(np.append(at, len(both))) if count is None else np.add.reduceat(count, at) if len(at) else count
    both = both[at]
    return keys[(both >> np.uint64(32)).astype(np.int64)], (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), sums


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, sorted, and the place of each value among them."""
    order = np.argsort(values)
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return values[new], back


def _by_context(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and how many rows each has."""
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.diff(np.append(at, len(key)))


def _count_triples(model: Model):
    """Triples of a task's texts, summed in chunks, by shard. The last two words of a text are a triple without a last word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = _loaded(Words, model), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, word, count = _summed(*(np.concatenate(x) for x in zip(*held)), None)
            order, edges = _dealt(key, model.shards)
            for s in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[s]:edges[s + 1]]
                context, sizes = _by_context(key[own])
                yield _row(s, "triples", {"context": context, "size": sizes.astype(np.uint32), "word": word[own],
                                            "count": count[own].astype(np.uint32)})

        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                number, _, bounds = _numbers(words, part)
                a, b = number[:-1].astype(np.uint64), number[1:].astype(np.uint64)
                last = np.append(number[2:] + 1, 0).astype(np.uint32)[:len(a)]
                ends = bounds[1:] - 1
                last[ends[ends >= 1] - 1] = 0  # nothing follows the end token
                inside = np.ones(len(a), bool)
                inside[ends[ends < len(a)]] = False
                pairs = (a << np.uint64(32) | b)[inside]
                held.append((pairs, last[inside]))
                size += len(pairs)
                if size > CHUNK_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()
    return run


def _row(shard: int, kind: str, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([kind]), pa.array([_blob(arrays)], pa.binary())], ["shard", "kind", "data"])


def _joined(blobs: list, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """Rows of all blobs: contexts repeated for their entries."""
    held = [b.as_buffer() for b in blobs]
    out = {k: np.concatenate([_array(b, kinds, k) for b in held]) for k in kinds if k not in ("context", "size")}
    out["context"] = np.concatenate([np.repeat(_array(b, kinds, "context"), _array(b, kinds, "size")) for b in held])
    return out


def _sum_triples(model: Model):
    """One shard's triples, summed; and its pairs with their totals, for the shards of their first words."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        rows = _joined(list(table["data"]), _TRIPLES)
        context, word, count = _summed(*(rows.pop(k) for k in ("context", "word")), rows.pop("count").astype(np.uint64))
        pairs, sizes = _by_context(context)
        del context
        at = np.cumsum(sizes) - sizes
        follows = word > 0
        total = np.add.reduceat(count, at) if len(at) else count
        followed = np.add.reduceat(np.where(follows, count, 0), at) if len(at) else count
        kinds = np.add.reduceat(follows, at, dtype=np.uint64) if len(at) else count
        del at, sizes
        word, count = word[follows] - 1, np.minimum(count[follows], 2**32 - 1).astype(np.uint32)
        del follows
        kept = np.flatnonzero(kinds)
        out = [_row(shard, "triples", {"context": pairs[kept], "size": kinds[kept].astype(np.uint32), "word": word, "count": count})]
        del word, count, kept
        target = _spread(pairs >> np.uint64(32), model.shards)
        for s in np.unique(target).tolist():
            own = np.flatnonzero(target == s)
            firsts, n = _by_context(pairs[own] >> np.uint64(32))
            out.append(_row(s, "pairs", {"context": firsts, "size": n.astype(np.uint32), "word": (pairs[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                                         "count": total[own], "follow": followed[own], "kinds": kinds[own]}))
        del pairs, total, followed, kinds, target
        tidy()
        return pa.Table.from_batches(out)
    return run


# ---- levels

def _runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of entries, one run after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their values: 256 equal steps from least to most, each standing for the mean of what it holds.

    No value is off by more than a step, and their sum isn't off at all.
    """
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.float64)
    low, span = values.min(), np.ptp(values)
    codes = np.minimum((values - low) * (256 / span) if span > 0 else values * 0, 255).astype(np.uint8)
    n = np.bincount(codes, minlength=256)
    return codes, np.bincount(codes, weights=values, minlength=256) / np.maximum(n, 1)


def _add_one(count: np.ndarray, model: Model) -> np.ndarray:
    return (count + 1) / (model.tokens + 1.0 * (model.words + 1))


def _level(context: np.ndarray, sizes: np.ndarray, successors: np.ndarray, p: np.ndarray, weight: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a level: contexts, pointers, and successors made monotone by the rank of their context."""
    rank = np.repeat(np.arange(len(context), dtype=np.uint64), sizes)
    span = int(successors.max(initial=0)) + 1
    codes, book = _quantised(np.log10(p))
    weights, weight_book = _quantised(np.log10(weight))
    return {
        **ef.named("context", ef.encode(context, universe)),
        **ef.named("pointer", ef.encode(np.concatenate([[0], np.cumsum(sizes)]), len(successors) + 1)),
        **ef.named("successor", ef.encode(rank * np.uint64(span) + successors.astype(np.uint64), len(context) * span + 1)),
        "span": np.array([span], np.int64), "code": codes, "book": book, "weight": weights, "weight_book": weight_book}


class Level:
    """Readers of one shard of a level."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.context, self.pointer, self.successor = (ef.EliasFano(ef.part(k, arrays)) for k in ("context", "pointer", "successor"))
        self._span, self._code, self._book = int(arrays["span"][0]), arrays["code"], arrays["book"]
        self._weight, self._weight_book = arrays["weight"], arrays["weight_book"]

    def place(self, rank: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Index of ``successor`` after the context of that rank, or -1."""
        out = np.full(len(rank), -1, np.int64)
        may = np.flatnonzero((rank >= 0) & (successor >= 0) & (successor < self._span))
        out[may] = self.successor.find(rank[may].astype(np.uint64) * np.uint64(self._span) + successor[may].astype(np.uint64))
        return out

    def begins(self, rank: np.ndarray) -> np.ndarray:
        return self.pointer.get(rank).astype(np.int64)

    def log_p(self, place: np.ndarray) -> np.ndarray:
        return self._book[self._code[place]]

    def log_weight(self, rank: np.ndarray) -> np.ndarray:
        return self._weight_book[self._weight[rank]]


class Trie:
    """Lookups of pairs and triples; shards are opened when first needed."""

    def __init__(self, model: Model) -> None:
        self._model, self._open = model, {}

    def _shard(self, kind: str, i: int) -> Level | None:
        if (kind, i) not in self._open:
            try:
                self._open[kind, i] = Level(_read(self._model.folder, f"{kind}-{i}"))
            except FileNotFoundError:  # no entry fell into this shard
                self._open[kind, i] = None
        return self._open[kind, i]

    def _each(self, kind: str, keys: np.ndarray) -> Iterator[tuple[Level, np.ndarray]]:
        """Shards that exist, each with the places of its keys, in order."""
        order, edges = _dealt(keys, self._model.shards)
        for s in np.flatnonzero(np.diff(edges)).tolist():
            if (level := self._shard(kind, s)) is not None:
                yield level, order[edges[s]:edges[s + 1]]

    def pairs(self, key: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(b | a) with the add-one log ``single`` of b below it, and b's place among a's successors (-1: none).

        ``key`` is sorted: a + 1 in the high half, b + 1 in the low one, zero for unknown words.
        """
        a, b = _halves(key)
        log_p, place = single.copy(), np.full(len(a), -1, np.int64)
        firsts, sizes = _by_context(a)
        begins = np.cumsum(sizes) - sizes
        for level, own in self._each("pairs", firsts):
            rank = level.context.find(firsts[own])
            own, rank = own[rank >= 0], rank[rank >= 0]
            size, begin = sizes[own], level.begins(rank)
            own = _runs(begins[own], size)
            rank, begin = np.repeat(rank, size), np.repeat(begin, size)
            at = level.place(rank, b[own])
            hit, miss = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            place[own[hit]] = at[hit] - begin[hit]
            log_p[own[hit]] = level.log_p(at[hit])
            log_p[own[miss]] += level.log_weight(rank[miss])
        return log_p, place

    def triples(self, key: np.ndarray, pair: np.ndarray, place: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 P(c | a b), a and b as ``key[pair]``, c given by its ``place`` among b's successors, ``lower`` log10 P(c | b).

        ``key`` (a in the high half) is sorted and has every pair once. A triple is looked up once, in order.
        """
        both, back = _distinct(pair.astype(np.uint64) << np.uint64(32) | (place + 1).astype(np.uint64))
        place = (both & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1
        asked, sizes = _by_context(both >> np.uint64(32))
        begins, key = np.cumsum(sizes) - sizes, key[asked.astype(np.int64)]
        found, value = np.zeros(len(both), bool), np.zeros(len(both))
        for level, own in self._each("triples", key):
            rank = level.context.find(key[own])
            own, rank = own[rank >= 0], rank[rank >= 0]
            size = sizes[own]
            own, rank = _runs(begins[own], size), np.repeat(rank, size)
            at = level.place(rank, place[own])
            hit, miss = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
            found[own[hit]] = True
            value[own[hit]] = level.log_p(at[hit])
            value[own[miss]] = level.log_weight(rank[miss])
        return np.where(found[back], 0, lower) + value[back]


def _build_pairs(model: Model):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        rows = _joined(list(table["data"]), _PAIRS)
        order = np.argsort(rows["context"] << np.uint64(32) | rows["word"].astype(np.uint64))
        context, word, count = rows["context"][order], rows["word"][order].astype(np.int64), rows["count"][order].astype(np.float64)
        firsts, sizes = _by_context(context)
        total = np.add.reduceat(count, np.cumsum(sizes) - sizes)
        weight = DISCOUNT * sizes / total
        single = _add_one(_loaded(Singles, model).counts(word), model)
        p = np.maximum(count - DISCOUNT, 0) / np.repeat(total, sizes) + np.repeat(weight, sizes) * single
        _write(model.folder, f"pairs-{shard}", ef.to_bytes(_level(firsts, sizes, word, p, weight, model.words + 1)))
        tidy()
        return _done(shard, len(word))
    return run


def _done(shard: int, n: int) -> pa.Table:
    return pa.table({"shard": [shard], "n": [n]}, schema=pa.schema([("shard", pa.int32()), ("n", pa.int64())]))


class Singles:
    """Training counts by word number."""

    def __init__(self, model: Model) -> None:
        sizes = np.diff([*model.starts, model.words])
        self._starts = np.array(model.starts, np.int64)
        self._counts = [_read(model.folder, f"words-{i}")["count"] if n else np.zeros(0, np.int64) for i, n in enumerate(sizes)]

    def counts(self, number: np.ndarray) -> np.ndarray:
        out = np.zeros(len(number), np.int64)
        shard = np.searchsorted(self._starts, number, side="right") - 1
        for i in np.unique(shard).tolist():
            own = np.flatnonzero(shard == i)
            out[own] = self._counts[i][number[own] - self._starts[i]]
        return out


def _blocks(context: np.ndarray) -> Iterator[slice]:
    """Runs of sorted contexts of about BLOCK entries; no context is cut."""
    at = 0
    while at < len(context):
        to = int(np.searchsorted(context, context[min(at + BLOCK, len(context)) - 1], side="right"))
        yield slice(at, to)
        at = to


def _build_triples(model: Model):
    """Levels of the shards given as rows: one row has all triples of a shard, sorted by context."""
    def build(shard: int, data: pa.Scalar) -> int:
        rows = _joined([data], _TRIPLES)
        context, word, count = rows.pop("context"), rows.pop("word"), rows.pop("count")
        lower, place = np.empty(len(word)), np.empty(len(word), np.int64)
        for own in _blocks(context):
            second = (context[own] & np.uint64(0xFFFFFFFF)) + np.uint64(1)
            pair, back = _distinct(second << np.uint64(32) | (word[own].astype(np.uint64) + np.uint64(1)))
            single = np.log10(_add_one(_loaded(Singles, model).counts(_halves(pair)[1]), model))
            low, at = (x[back] for x in _loaded(Trie, model).pairs(pair, single))
            sizes = _by_context(context[own])[1]
            order = np.argsort(np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(32), sizes) | at.astype(np.uint64))
            lower[own], place[own], count[own] = low[order], at[order], count[own][order]
        del word
        pairs, sizes = _by_context(context)
        del context
        p = count.astype(np.float64)
        total = np.add.reduceat(p, np.cumsum(sizes) - sizes)
        weight = DISCOUNT * sizes / total
        p -= DISCOUNT
        np.maximum(p, 0, out=p)
        p /= np.repeat(total, sizes)
        np.power(10, lower, out=lower)
        lower *= np.repeat(weight, sizes)
        p += lower
        del count, lower, total
        # the first word in the high half: the universe of pairs is words times 2^32
        _write(model.folder, f"triples-{shard}", ef.to_bytes(_level(pairs, sizes, place, p, weight, (model.words + 1) << 32)))
        return len(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch["shard"].to_pylist(), batch["data"]):
                n = build(shard, data)
                tidy()
                yield from _done(shard, n).to_batches()
    return run


def train(docs: DataFrame, text: str = "text", shard_tokens: int = SHARD_TOKENS, shard_words: int = SHARD_WORDS) -> Model:
    """Counts all texts of ``docs`` (null: empty) and writes the levels below the shared folder."""
    spark: SparkSession = docs.sparkSession
    folder = _uri(scratch_path(spark, "ngram-trie"))
    texts = docs.select(F.coalesce(named(docs, text), F.lit("")).alias("text"))
    found = staged(texts.mapInArrow(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "ngram-words")
    sums = found.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if sums["v"] >= 1 << 32:
        raise ValueError("pairs of word numbers are kept in 64 bits")
    bits = max(0, (-(-sums["v"] // shard_words) - 1).bit_length())
    of = F.call_function("shiftrightunsigned", F.col("hash"), F.lit(64 - bits)).cast("int") if bits else F.lit(0)
    sizes = {r["shard"]: r["n"] for r in found.withColumn("shard", of).groupBy("shard").applyInArrow(
        _word_shard(folder), "shard int, n long").collect()}
    starts = np.cumsum([0] + [sizes.get(i, 0) for i in range(1 << bits)])[:-1]
    model = Model(folder, tuple(int(x) for x in starts), sums["v"], sums["n"], max(1, -(-sums["n"] // shard_tokens)))
    blobs = texts.mapInArrow(_count_triples(model), BLOBS)
    summed = staged(blobs.groupBy("shard").applyInArrow(_sum_triples(model), BLOBS), "ngram-counts")
    summed.where(F.col("kind") == "pairs").groupBy("shard").applyInArrow(_build_pairs(model), "shard int, n long").agg(F.sum("n")).collect()
    # a shard's triples are one row already
    summed.where(F.col("kind") == "triples").select("shard", "data").mapInArrow(_build_triples(model), "shard int, n long").agg(F.sum("n")).collect()
    return model


RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                       T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _scores(model: Model, part: pa.Array) -> list[np.ndarray]:
    words, trie = _loaded(Words, model), _loaded(Trie, model)
    number, count, bounds = _numbers(words, part)
    single = np.log10(_add_one(count, model))
    at = np.arange(len(number)) - np.repeat(bounds[:-1], np.diff(bounds))  # place in the text
    second, third = np.flatnonzero(at >= 1), np.flatnonzero(at >= 2)
    del at
    # every distinct pair is looked up once
    distinct, back = _distinct((number[second - 1] + 1).astype(np.uint64) << np.uint64(32) | (number[second] + 1).astype(np.uint64))
    third = third[(number[third - 1] >= 0) & (number[third - 2] >= 0)]
    del number
    alone = np.zeros(len(distinct))
    alone[back] = single[second]
    lower, place = trie.pairs(distinct, alone)
    log_p = single.copy()
    log_p[second] = lower[back]
    of = np.zeros(len(single), np.int64)  # number of the pair that ends here
    of[second] = back
    del alone, lower, second, back
    known = np.flatnonzero((distinct >> np.uint64(32) > 0) & (distinct & np.uint64(0xFFFFFFFF) > 0))
    dense = np.zeros(len(distinct), np.int64)
    dense[known] = np.arange(len(known))
    key = distinct[known] - np.uint64((1 << 32) + 1)
    pair, place = dense[of[third - 1]], place[of[third]]
    del of, known, dense, distinct
    log_p[third] = trie.triples(key, pair, place, log_p[third])
    total = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has its end token
    return [np.diff(bounds), total((count > 0).astype(np.int64)), total(single), total(log_p)]


def score(df: DataFrame, model: Model, text: str = "text", to: str = "lm") -> DataFrame:
    """``df`` plus the struct ``to``: n_tokens (with the end token), n_known (seen in training), base_score (add-one
    single words) and score, the model's log10 probability of the whole text. Null texts are empty; all rows stay."""
    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, kinds = RESULT.fieldNames(), [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            for part in slices(batch, SLICE):
                yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(_scores(model, part), kinds)], names)
            if not len(batch):
                yield pa.StructArray.from_arrays([pa.array([], k) for k in kinds], names)

    return df.withColumn(to, run(named(df, text)))
