"""Token counts of a byte-level BPE vocabulary by finite-state transducers.

Two deterministic machines read a text:

* the *splitter* reads character classes and marks where pre-tokens begin. It is a table of 11 states;
  a chunk of text is a map of its states (where does each start state end up), maps of neighbouring
  chunks compose, so all chunks are read at once, a prefix scan gives every chunk its start state,
  and a second reading marks the borders;
* the *counter* reads the bytes of one pre-token and adds a number of tokens on every transition, so
  that the sum after each byte is the number of tokens of the prefix read so far. Its states are the
  weighted determinisation of "which token is being read after which token": a token may follow
  another exactly if the pair encodes to itself, and a sequence of such pairs is the encoding. States
  are compiled when first met, as rows of a table, and dropped together when the table is full.

All pre-tokens of a slice go through the counter in step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorkit.llm.rows import named
from anchorkit.llm.slices import slices

# Character classes of the splitter. Letters of contractions have classes of their own.
LETTER, S, T_, R, E, V, M, L, D, NUMBER, SPACE, WHITE, MARK, OTHER, END = range(15)
_LETTERS = {LETTER, S, T_, R, E, V, M, L, D}
_CONTRACTION = {"s": S, "t": T_, "r": R, "e": E, "v": V, "m": M, "l": L, "d": D}
# States of the splitter: what the last character was part of. RE and LL wait for the last letter of a contraction.
FRESH, WORD, DIGITS, SIGNS, SPACE_1, WHITE_1, SPACE_N, WHITE_N, QUOTE, RE, LL = range(11)
STATES = 11
CHUNK = 512
#: States of the counter kept at once (256 transitions of 5 bytes each).
MAX_STATES = 1 << 16
START = -1
#: Last tokens are told apart only by the tokens they allow, below nodes with so many tokens at most.
FEW = 48


def _begin(c: int) -> int:
    if c in _LETTERS:
        return WORD
    return {NUMBER: DIGITS, SPACE: SPACE_1, WHITE: WHITE_1, MARK: QUOTE, OTHER: SIGNS, END: FRESH}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state; bit 0: a pre-token begins at this character, bit 1: one began at the character before."""
    new = (_begin(c), 0 if c == END else 1)
    white = {SPACE: SPACE_N, WHITE: WHITE_N}
    attached = WORD if c in _LETTERS else DIGITS if c == NUMBER else SIGNS
    if state in (RE, LL):
        if c == (E if state == RE else L):
            return FRESH, 0
        return (WORD, 2) if c in _LETTERS else (new[0], new[1] | 2)
    if c == END or state == FRESH:
        return new
    if state == WORD:
        return (WORD, 0) if c in _LETTERS else new
    if state == DIGITS:
        return (DIGITS, 0) if c == NUMBER else new
    if state == SIGNS:
        return (SIGNS, 0) if c in (OTHER, MARK) else new
    if state == QUOTE:
        if c in (S, T_, M, D):
            return FRESH, 0
        if c in (R, V):
            return RE, 0
        if c == L:
            return LL, 0
        return (SIGNS, 0) if c in (OTHER, MARK) else new
    if c in white:
        return white[c], 0
    if state == SPACE_1:
        return attached, 0
    if state == SPACE_N:
        return attached, 2
    return new if state == WHITE_1 else (new[0], new[1] | 2)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output, indexed by state + 16 * class."""
    to, out = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for c in range(15):
        for s in range(STATES):
            to[s + 16 * c], out[s + 16 * c] = _step(s, c)
    return to, out


def _classes() -> np.ndarray:
    """Class of every code point, shifted for the tables."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", WHITE)):
        table[[ord(x) for x in regex.findall(pattern, every)]] = c
    table[ord(" ")], table[ord("'")] = SPACE, MARK
    for x, c in _CONTRACTION.items():
        table[ord(x)] = c
    return table * 16


def borders(classes: np.ndarray, to: np.ndarray, out: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a pre-token begins at each place of ``classes`` (shifted; each text ends with END)."""
    n = -(-len(classes) // chunk)
    grid = np.full(n * chunk, END * 16, np.uint8)
    grid[:len(classes)] = classes
    grid = np.ascontiguousarray(grid.reshape(n, chunk).T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (n, 1))
    for row in grid:
        maps = to[maps + row[:, None]]
    # scan: after round r, maps[i] is the composition of the 2^r chunks up to i
    reach = 1
    while reach < n:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.concatenate([np.array([FRESH], np.uint8), maps[:-1, FRESH]])
    marks = np.empty((chunk, n), np.uint8)
    for j, row in enumerate(grid):
        at = state + row
        marks[j], state = out[at], to[at]
    marks = marks.T.ravel()[:len(classes)]
    begins = (marks & 1).astype(bool)
    begins[:-1] |= marks[1:] > 1
    return begins


class Counter:
    """The counting transducer of one vocabulary; compiles its states when they are met."""

    def __init__(self, merges: list[tuple[bytes, bytes]], max_states: int = MAX_STATES) -> None:
        # a token is its number: bytes first, then the results of the merges in order of rank
        number = {bytes([b]): b for b in range(256)}
        self._halves: list[tuple[int, int] | None] = [None] * 256
        self._merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = (number[left], number[right])
            if left + right not in number:
                number[left + right] = len(self._halves)
                self._halves.append(pair)
            self._merged.setdefault(pair, number[left + right])
        self._children: list[dict[int, int]] = [{}]
        self._token: list[int | None] = [None]
        for token, n in number.items():
            node = 0
            for b in token:
                child = self._children[node].get(b)
                if child is None:
                    child = self._children[node][b] = len(self._children)
                    self._children.append({})
                    self._token.append(None)
                node = child
            self._token[node] = n
        #: Tokens that start with a node's bytes, where they are few.
        self._below: list[tuple[int, ...] | None] = [() for _ in self._children]
        for node in range(len(self._children) - 1, -1, -1):
            parts = [self._below[c] for c in self._children[node].values()]
            own = () if self._token[node] is None else (self._token[node],)
            found = None if None in parts else sum(parts, ())
            self._below[node] = None if found is None or len(found) + len(own) > FEW else found + own
        self._alike: dict[tuple[int, int], int | None] = {}
        self._first: dict[tuple, int] = {}
        self._max = max_states
        self._forget()

    def _forget(self) -> None:
        self._states: list[tuple] = []
        self._known: dict[tuple, int] = {}
        self._to = np.full((1024, 256), -1, np.int32)
        self._add = np.zeros((1024, 256), np.int8)
        self._intern(((START, 0, 0),))

    def _intern(self, state: tuple) -> int:
        found = self._known.get(state)
        if found is None:
            found = self._known[state] = len(self._states)
            self._states.append(state)
            if found == len(self._to):
                self._to = np.concatenate([self._to, np.full(self._to.shape, -1, np.int32)])
                self._add = np.concatenate([self._add, np.zeros(self._add.shape, np.int8)])
        return found

    def _follows(self, before: int, token: int) -> bool:
        """Whether the two tokens side by side are an encoding.

        Merges next to the border are undone from the latest to the earliest. If the tokens that are
        then at the border would merge before the one undone last, merging would have crossed it.
        """
        if before == START:
            return True
        undone_left, undone_right = 1 << 40, 1 << 40
        while True:
            crossing = self._merged.get((before, token))
            # of two equal merges the left one goes first
            if crossing is not None and crossing < undone_left and crossing <= undone_right:
                return False
            if before > token and self._halves[before] or not self._halves[token]:
                if not self._halves[before]:
                    return True
                undone_left, before = before, self._halves[before][1]
            else:
                undone_right, token = token, self._halves[token][0]

    def _class_of(self, last: int, node: int) -> int | None:
        """One of the tokens that allow the same tokens further below ``node`` as ``last`` does; None if there are none."""
        key = (last, node)
        if key not in self._alike:
            if len(self._alike) > 4 * self._max:
                self._alike.clear()
                self._first.clear()
            below = [self._below[c] for c in self._children[node].values()]
            if None in below:
                self._alike[key] = last
            else:
                allowed = tuple(self._follows(last, t) for part in below for t in part)
                self._alike[key] = self._first.setdefault((node, allowed), last) if any(allowed) else None
        return self._alike[key]

    def _compile(self, state: int, byte: int) -> None:
        """A state is what may still be read: (last token, node of the next one, its count less the count so far)."""
        alive, done = [], None
        for last, node, count in self._states[state]:
            node = self._children[node].get(byte)
            if node is None:
                continue
            if self._children[node] and (like := self._class_of(last, node)) is not None:
                alive.append((like, node, count))
            token = self._token[node]
            if token is not None and done is None and self._follows(last, token):
                done = (token, count + 1)
        token, gain = done
        reached = (*((a, b, c - gain) for a, b, c in alive), (token, 0, 0))
        self._add[state, byte] = gain
        self._to[state, byte] = self._intern(reached)

    def counts(self, words: pa.Array) -> np.ndarray:
        """Number of tokens of each binary value; values of any length, none empty."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        start, length = offsets[:-1][order], length[order]
        total = np.zeros(len(order), np.int64)
        state = np.zeros(len(order), np.int64)
        active = len(order)
        for j in range(int(length[0]) if active else 0):
            while length[active - 1] <= j:
                active -= 1
            now, byte = state[:active], data[start[:active] + j]
            reached = self._to[now, byte]
            if (lacking := reached < 0).any():
                if len(self._states) > self._max:
                    held, back = np.unique(now, return_inverse=True)
                    kept = [self._states[s] for s in held]
                    self._forget()
                    state[:active] = np.array([self._intern(s) for s in kept])[back]
                    now, lacking = state[:active], np.ones(active, bool)
                for key in np.unique(now[lacking] << 8 | byte[lacking]).tolist():
                    if self._to[key >> 8, key & 255] < 0:
                        self._compile(key >> 8, key & 255)
                reached = self._to[now, byte]
            total[:active] += self._add[now, byte]
            state[:active] = reached
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


class TokenCounter:
    """Number of tokens of whole texts, as a byte-level BPE file of the tokenizers library gives them."""

    def __init__(self, definition: str, max_states: int = MAX_STATES) -> None:
        spec = json.loads(definition)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level BPE without a normaliser is compiled")
        added = spec.get("added_tokens") or []
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError("added tokens that look at their surroundings aren't compiled")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        signs = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        raw = lambda token: bytes(signs[x] for x in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._counter = Counter([(raw(a), raw(b)) for a, b in pairs], max_states)
        texts = sorted((t["content"] for t in added), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, texts))) if texts else None
        self._to, self._out = _tables()
        self._class = _classes()

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens per text; strings of added tokens count one and separate what is around them."""
        pieces, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = self._special.split(text) if self._special else [text]
            extra[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        joined = "\0".join(pieces) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self._class[points]
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        classes[ends] = END * 16
        begins = borders(classes, self._to, self._out)
        begins[ends] = True
        data = joined.encode("utf-8", "surrogatepass")
        at = np.flatnonzero(begins)
        if len(data) != len(points):
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            offsets = np.concatenate([[0], np.cumsum(width)])[at]
        else:
            offsets = at
        offsets = np.append(offsets, len(data))
        kind = pa.binary() if len(data) < 2**31 else pa.large_binary()
        words = pa.Array.from_buffers(kind, len(at), [None, pa.py_buffer(
            offsets.astype(np.int32 if kind == pa.binary() else np.int64)), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary())
        tokens = self._counter.counts(distinct)[coded.indices.to_numpy(zero_copy_only=False)]
        separators = np.searchsorted(at, ends)
        tokens[separators] = 0
        sums = np.concatenate([[0], np.cumsum(tokens)])
        per_piece = np.diff(np.concatenate([[0], sums[separators]]))
        np.add.at(extra, np.array(owner, np.int64), per_piece)
        return extra


_LOADED: dict[int, TokenCounter] = {}


def count_tokens(df: DataFrame, definition: str, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """``df`` plus ``to`` (long): the tokens of ``text``, null and empty texts zero; all rows and columns stay.

    ``definition`` is the path of a tokenizer file on the driver. The compiled machines live in the
    Python workers and are used again by later tasks.
    """
    with open(definition, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf(T.LongType())
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = hash(shared.value)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = TokenCounter(shared.value)
        counter = _LOADED[key]
        for batch in batches:
            found = [counter.counts([x or "" for x in part.to_pylist()]) for part in slices(batch)]
            yield pa.array(np.concatenate(found) if found else [], pa.int64())

    return df.withColumn(to, tokens(named(df, text)))
