"""Pieces of Arrow batches that keep temporary arrays small, whatever the texts' lengths."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library keeps its own house
    _trim = None


def tidy() -> None:
    """Give back freed memory: Python workers outlive their task and wait beside the next one's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_HELD: dict[str, Callable[[], None]] = {}


def alone(owner: str, release: Callable[[], None] | None = None) -> None:
    """Let go what other operators keep in this worker; a task of ``owner`` says so before it begins.

    ``release`` drops what ``owner`` keeps from one of its tasks to the next, tables and remembered words.
    """
    others = [k for k in _HELD if k != owner]
    for k in others:
        _HELD.pop(k)()
    if others:
        tidy()
    if release:
        _HELD[owner] = release


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """``texts`` in order, in runs of at most ``most`` bytes (one text at least)."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(ends.searchsorted(base + most, side="right")))
        yield texts.slice(at, to - at)
        at = to
    tidy()
