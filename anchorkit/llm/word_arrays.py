"""Words of Arrow text arrays, found with array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def word_arrays(texts: pa.Array, lower: bool = True) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts one after the other, and where each text's words begin and end.

    ``lower`` puts A-Z into lower case. Text i has the words ``bounds[i]:bounds[i + 1]``; null texts have
    none. The words are dictionary-encoded UTF-8 bytes.
    """
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = (data != 32) & ((data < 9) | (data > 13))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[first[first > 0] - 1] = inside[first[first > 0] - 1]
    at = np.flatnonzero(begins)
    kept = data[inside]
    if lower:
        kept = np.where((kept >= 65) & (kept <= 90), kept + 32, kept).astype(np.uint8)
    word_offsets = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - at)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(word_offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    return words.dictionary_encode(), np.searchsorted(at, offsets)


def indices(words: pa.DictionaryArray) -> np.ndarray:
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxh64(words: pa.Array) -> np.ndarray:
    """XXH64 (seed 0) of every value of a binary array: values under 32 bytes all together, 8 bytes a step, longer ones singly."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    held = words.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    data = np.zeros(len(raw) + 8, np.uint8)
    data[:len(raw)] = raw
    eight = np.ndarray(len(raw) + 1, "<u8", data, strides=(1,))  # from every byte on
    begin, size = offsets[:-1] - offsets[0], np.diff(offsets)
    out = size.astype(np.uint64) + _P5
    for lane in range(3):
        own = np.flatnonzero((size >= 8 * lane + 8) & (size < 32))
        if not len(own):
            break
        k = _turned(eight[begin[own] + 8 * lane] * _P2, 31) * _P1
        out[own] = _turned(out[own] ^ k, 27) * _P1 + _P4
    own = np.flatnonzero(size & 4)
    k = (eight[begin[own] + (size[own] & ~7)] & np.uint64(0xFFFFFFFF)) * _P1
    out[own] = _turned(out[own] ^ k, 23) * _P2 + _P3
    for byte in range(3):
        own = np.flatnonzero((size & 3) > byte)
        k = data[begin[own] + (size[own] & ~3) + byte].astype(np.uint64) * _P5
        out[own] = _turned(out[own] ^ k, 11) * _P1
    out ^= out >> np.uint64(33)
    out *= _P2
    out ^= out >> np.uint64(29)
    out *= _P3
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[begin[i]:begin[i] + size[i]])
    return out
