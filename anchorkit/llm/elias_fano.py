"""Elias-Fano coding of sorted numbers, read in place by array operations, and a file of named arrays.

n numbers below u take about 2 + log2(u / n) bits each: the low bits are packed one after the other,
the high bits are counted in unary. All queries take arrays.
"""

from __future__ import annotations

import json

import numpy as np

_ONE = np.uint64(1)
_LOWEST, _HIGHEST = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_TWOS, _FOURS, _EIGHTS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
#: Place of the one number k in a byte b, at 8 b + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).reshape(-1)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """``values`` of ``width`` bits each, as 64-bit words (one spare word at the end)."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width and len(values):
        bit = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        values = values.astype(np.uint64)
        # no width is above 64: a number begins in every word but the spare ones
        first = -(-64 * np.arange(int(word[-1]) + 1) // width)
        out[:len(first)] = np.bitwise_or.reduceat(values << shift, first)
        over = shift + np.uint64(width) > np.uint64(64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])  # one a word
    return out


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of numbers below ``universe``."""
    n = len(values)
    values = values.astype(np.uint64)
    width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    high = values >> np.uint64(width)
    size = n + int(max(universe - 1, 0) >> width) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[(high + np.arange(n, dtype=np.uint64)).astype(np.int64)] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))])
    zeros = zeros.astype(np.uint32 if size < 1 << 31 else np.int64)  # before each word
    low = values & np.uint64((1 << width) - 1)
    return {"head": np.array([n, width], np.int64), "low": _packed(low, width), "high": words, "zeros": zeros}


def _one(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the one number ``k`` (from 0) of each word: its byte from sums of all bytes at once, the rest from a table."""
    sums = word - (word >> _ONE & _TWOS)
    sums = (sums & _FOURS) + (sums >> np.uint64(2) & _FOURS)
    sums = (sums + (sums >> np.uint64(4)) & _EIGHTS) * _LOWEST  # ones up to each byte
    k = k.astype(np.uint64)
    # bytes whose sum isn't above k; 64 ones and k under 64 fit beside the highest bit
    place = np.bitwise_count((k * _LOWEST | _HIGHEST) - sums & _HIGHEST).astype(np.uint64) << np.uint64(3)
    k -= (sums << np.uint64(8)) >> place & np.uint64(0xFF)
    return (place + _IN_BYTE[(word >> place & np.uint64(0xFF)) << np.uint64(3) | k]).astype(np.int64)


class EliasFano:
    """A coded sequence; the arrays may be views of a mapped file."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.n, self._width = (int(x) for x in arrays["head"])
        self._low, self._high, self._zeros = arrays["low"], arrays["high"], arrays["zeros"]
        self._eight = np.ndarray(len(self._low) * 8 - 7, "<u8", self._low, strides=(1,))  # from every byte on

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self._width:
            return np.zeros(len(i), np.uint64)
        mask = np.uint64((1 << self._width) - 1)
        if self._width <= 57:  # within the 8 bytes that begin with its first one
            bit = i * self._width
            return self._eight[bit >> 3] >> (bit & 7).astype(np.uint64) & mask
        bit = i.astype(np.uint64) * np.uint64(self._width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        # a shift by 64 isn't defined, hence two steps
        return (self._low[word] >> shift | (self._low[word + 1] << (np.uint64(63) - shift)) << _ONE) & mask

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero number ``k`` (from 0)."""
        k = k.astype(self._zeros.dtype)
        at = np.searchsorted(self._zeros, k, side="right") - 1
        return at * 64 + _one(~self._high[at], k - self._zeros[at])

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value (the first of equal ones), or -1: a successor search in the bucket of its high bits."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        if len(values) > 1000 and (values[1:] < values[:-1]).any():  # sorted questions read the arrays from front to back
            order = np.argsort(values)
            out[order] = self.find(values[order])
            return out
        high, inside, limit = values >> np.uint64(self._width), None, np.uint64(int(self._zeros[-1]) - 1)
        if high.max() >= limit:
            inside = np.flatnonzero(high < limit)
            high, values = high[inside], values[inside]
        high = high.astype(np.int64)
        low = values & np.uint64((1 << self._width) - 1)
        # a bucket begins after the zero that ends the one before, and holds as many numbers as ones follow
        start = self._select0(np.maximum(high - 1, 0)) + 1
        start[high == 0] = 0
        begin = start - high
        shift = start & 63
        ones = self._high[start >> 6] >> shift.astype(np.uint64)
        run = np.bitwise_count(ones & ~(ones + _ONE)).astype(np.int64)  # trailing ones
        end = begin + run
        cut = np.flatnonzero(run >= 64 - shift)  # the run may go on in the next word
        end[cut] = self._select0(high[cut]) - high[cut]
        stop = end.copy()
        many = np.flatnonzero(end - begin > 1)
        first, last, sought = begin[many], end[many], low[many]
        while len(many):
            middle = (first + last) >> 1
            less = self._lows(middle) < sought
            first, last = np.where(less, middle + 1, first), np.where(less, last, middle)
            open_ = first < last
            if not open_.all():
                shut = ~open_
                begin[many[shut]] = first[shut]
                many, first, last, sought = many[open_], first[open_], last[open_], sought[open_]
        at = np.flatnonzero(begin < stop)
        hit = at[self._lows(begin[at]) == low[at]]
        out[hit if inside is None else inside[hit]] = begin[hit]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``: the high part is the number of zeros before the one number ``i``."""
        if not len(i):
            return np.zeros(0, np.uint64)
        # ones before a word: its bits less its zeros
        ones = np.arange(len(self._zeros), dtype=np.int64) * 64 - self._zeros
        at = np.searchsorted(ones, i, side="right") - 1
        high = (at * 64 + _one(self._high[at], i - ones[at]) - i).astype(np.uint64)
        return high << np.uint64(self._width) | self._lows(i)


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one block: a description, then the arrays at multiples of 8 bytes."""
    at, entries, parts = 0, [], []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        entries.append((name, a.dtype.str, len(a), at))
        parts.append(raw + b"\0" * (-len(raw) % 8))
        at += len(parts[-1])
    head = json.dumps(entries).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(parts)


def from_buffer(data: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the arrays of :func:`to_bytes` in a byte array, mapped or not."""
    size = int.from_bytes(data[:8].tobytes(), "little")
    base = 8 + size
    return {name: data[base + at:base + at + n * np.dtype(kind).itemsize].view(kind)
            for name, kind, n, at in json.loads(data[8:base].tobytes())}


def named(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def part(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k[len(prefix) + 1:]: v for k, v in arrays.items() if k.startswith(prefix + ".")}
