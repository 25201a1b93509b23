"""SentencePiece BPE encoding that keeps, for every piece, the bytes of the source it stands for, and decoding.

A text is normalised by the model's compiled character map: at each place the longest prefix that the
map knows is replaced, everything else is copied, and the source offset of every normalised character
is recorded. Pieces are found on the normalised text and projected back through these offsets. Their
source spans tile the text: a piece begins where the one before ends, so ends are enough.

Segments that no piece can cross (a run of word marks and what follows) are encoded once and kept,
within a bound, by the Python worker.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from anchorkit.llm.rows import named
from anchorkit.llm.slices import alone, slices

MARK = "▁"
#: Segments remembered by a worker, in two generations of this size: some 190 bytes each, and an executor has a worker per core.
REMEMBERED = 125_000
RESULT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
                       T.StructField("decoded", T.StringType())])


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes whose values point to replacement strings."""

    def __init__(self, compiled: bytes) -> None:
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self._units = struct.unpack_from(f"<{size // 4}I", compiled, 4) if compiled else ()
        self._strings = compiled[4 + size:]

    def __bool__(self) -> bool:
        return bool(self._units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``data[at:]`` and its replacement."""
        units, found = self._units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self._strings[found[1]:self._strings.index(b"\0", found[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Pieces:
    """Encoder and decoder of one BPE model file."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED) -> None:
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        norm, kind = spec.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if spec.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with leading word marks are read")
        if not norm.escape_whitespaces or any(p.type in (kind.UNUSED, kind.USER_DEFINED) for p in spec.pieces):
            raise ValueError("models with unused or user-defined pieces or plain spaces aren't read")
        self.map = CharacterMap(norm.precompiled_charsmap)
        self._prefix, self._squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self._score, self._id, self._byte, self._shown = {}, {}, {}, []
        self.end_id, self._unknown = spec.trainer_spec.eos_id, spec.trainer_spec.unk_id
        for i, p in enumerate(spec.pieces):
            if p.type == kind.NORMAL:
                self._id[p.piece], self._score[p.piece] = i, p.score
                self._shown.append(p.piece.replace(MARK, " ").encode())
            elif p.type == kind.BYTE:
                self._byte[int(p.piece[3:5], 16)] = i
                self._shown.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self._shown.append(spec.trainer_spec.unk_surface.encode() if i == self._unknown else b"")
        self._table = pa.array(self._shown, pa.binary())
        self._number_pairs()
        self._bytes = frozenset(self._byte.values())
        self._fallback = spec.trainer_spec.byte_fallback
        # a word mark after another character ends a segment if no piece holds such a pair
        self._apart = not any(MARK in p.lstrip(MARK) for p in self._id)
        self._segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._remembered = remembered

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and the source byte offset of each of its characters and of its end."""
        data = text.encode("utf-8", "surrogatepass")
        out: list[str] = []
        source: list[int] = []
        at, space = 0, self._squeeze

        def put(part: str, begin: int) -> None:
            nonlocal space
            for x in part:
                if x == " ":
                    if space and self._squeeze:
                        continue
                    x = MARK
                space = x == MARK
                out.append(x)
                source.append(begin)

        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                width, part = hit[0], hit[1].decode("utf-8")
            else:
                lead = data[at]
                width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                part = data[at:at + width].decode("utf-8", "surrogatepass")
            if not out and self._prefix and (not self._squeeze or part.strip(" ")):
                out.append(MARK)
                source.append(at)
            put(part, at)
            at += width
        end = len(data)
        while self._squeeze and out and out[-1] == MARK:
            out.pop()
            end = source.pop()
        return "".join(out), np.array([*source, end], np.int64)

    def _number_pairs(self) -> None:
        """Numbers for pieces and their characters, and for every pair that makes a piece: its place by score and its number.

        Merging numbers needs no strings. Of pieces with one score the leftmost comes first, which numbers
        don't say: a segment that comes to one of them is merged as strings.
        """
        self._pair: dict[int, int] = {}
        self._number: dict[str, int] = {}
        self._packed: list[bytes] = []
        merged = [p for p in self._score if len(p) > 1]
        times = Counter(self._score[p] for p in merged)
        self._shared: set[int] = set()
        for piece in [*self._id, *{c for p in self._id for c in p if c not in self._id}]:
            self._number[piece] = len(self._packed)
            self._packed.append(struct.pack("2i", self._id[piece], len(piece)) if piece in self._id else self._unpieced(piece))
        self._base = len(self._packed) + 1
        number = self._number.get
        for place, piece in enumerate(sorted(merged, key=self._score.get, reverse=True)):
            value = place << 32 | self._number[piece]
            if times[self._score[piece]] > 1:
                self._shared.add(value)
            for cut in range(1, len(piece)):
                a, b = number(piece[:cut]), number(piece[cut:])
                if a is not None and b is not None:
                    self._pair[a * self._base + b] = value

    def _unpieced(self, part: str) -> bytes:
        """(id, number of characters) of a character that is no piece: its bytes, the last of which holds it, or the unknown id."""
        if not self._fallback:
            return struct.pack("2i", self._unknown, len(part))
        pairs = [x for b in part.encode("utf-8", "surrogatepass") for x in (self._byte[b], 0)]
        pairs[-1] = len(part)
        return struct.pack(f"{len(pairs)}i", *pairs)

    def _encode_short(self, segment: str) -> bytes | None:
        """As :meth:`_encode`, over a plain list of numbers, linear in the length for every merge; None if numbers don't decide."""
        get, base, none, shared = self._pair.get, self._base, 1 << 62, self._shared
        number = self._number
        try:
            at = [number[c] for c in segment]
        except KeyError:  # a character of no piece
            return None
        values = [get(a * base + b, none) for a, b in zip(at, at[1:])]
        while values and (best := min(values)) != none:
            if best in shared:
                return None
            i = values.index(best)
            joined = at[i] = best & 0xFFFFFFFF
            del at[i + 1], values[i]
            if i < len(values):
                values[i] = get(joined * base + at[i + 1], none)
            if i:
                values[i - 1] = get(at[i - 1] * base + joined, none)
        packed = self._packed
        return b"".join([packed[x] for x in at])

    def _merge(self, parts: list[str]) -> list[str]:
        """The same over a heap, for long segments."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score = self._score
        heap = [(-s, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (s := score.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(joined + parts[k])) is not None:
                    heapq.heappush(heap, (-s, i, joined + parts[k]))
            h = before[i]
            if h >= 0 and (s := score.get(parts[h] + joined)) is not None:
                heapq.heappush(heap, (-s, h, parts[h] + joined))
        return parts

    def _encode(self, segment: str) -> bytes:
        """(id, number of characters) of the pieces as int32 pairs; merges with the best score first, then leftmost.

        A character that is no piece stands for its bytes; the last of them holds the character.
        """
        if len(segment) <= 64 and (short := self._encode_short(segment)) is not None:
            return short
        found = []
        for part in self._merge(list(segment)):
            if part:
                number = self._id.get(part)
                found.append(self._unpieced(part) if number is None else struct.pack("2i", number, len(part)))
        return b"".join(found)

    def _segment(self, segment: str) -> bytes:
        found = self._young.get(segment)
        if found is None:
            found = self._old.get(segment) or self._encode(segment)
            if len(segment) <= 64:
                if len(self._young) >= self._remembered:
                    self._old, self._young = self._young, {}
                self._young[segment] = found
        return found

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int32, no begin or end id) and the source byte offset where each piece ends."""
        if self.map or self._squeeze or MARK in text:
            body, source = self.normalise(text)
        else:  # nothing is replaced: characters keep their order and spaces become marks
            body = (MARK if self._prefix and text else "") + text.replace(" ", MARK)
            source = None
        parts = self._segments.findall(body) if self._apart else [body] if body else []
        young = self._young
        found = [young.get(p) or self._segment(p) for p in parts]
        pairs = np.frombuffer(b"".join(found), np.int32)
        ids, places = pairs[::2], np.cumsum(pairs[1::2])
        if source is None:
            shift = len(body) - len(text)
            if text.isascii():
                return ids, places - shift
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            source = np.concatenate([np.zeros(shift, np.int64), [0], np.cumsum(width)])
        return ids, source[places]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: control ids show nothing, marks are spaces, the first piece loses its leading one."""
        return self.decode_all(ids, np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """:meth:`decode` of the runs of ``ids`` between ``bounds``: what all ids show is put together at once."""
        shown = self._table.take(pa.array(ids, pa.int32()))
        offsets = np.frombuffer(shown.buffers()[1], np.int32)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        data = memoryview(shown.buffers()[2]) if len(ids) and shown.buffers()[2] is not None else memoryview(b"")
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            try:
                text = str(data[offsets[a]:offsets[b]], "utf-8")
            except UnicodeDecodeError:  # byte pieces that are no UTF-8: each wrong byte shows the replacement sign
                text = "".join(self._runs(ids[a:b].tolist()))
            if (self._prefix or self._squeeze) and text.startswith(" "):
                first = next((i for i in ids[a:b].tolist() if self._shown[i] or i in self._bytes), None)
                text = text[1:] if first is not None and first not in self._bytes and first != self._unknown else text
            out.append(text)
        return out

    def _runs(self, ids: list[int]) -> Iterator[str]:
        run = b""
        for i in [*ids, -1]:
            if i in self._bytes:
                run += self._shown[i]
                continue
            while run:
                for width in (1, 2, 3, 4):
                    try:
                        yield run[:width].decode("utf-8")
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    yield "�"
                    width = 1
                run = run[width:]
            if i >= 0:
                yield self._shown[i].decode("utf-8")


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model's pieces, kept by the worker for its next task. A function of the module: what a task's own function names
    comes with it as a copy, and a copy of ``_LOADED`` would be empty in every task."""
    alone("piece_spans", _LOADED.clear)
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values).astype(np.int32), pa.int32()))


def encode_decode(df: DataFrame, model: str, text: str = "text", to: str = "pieces", end_id: bool = True) -> DataFrame:
    """``df`` plus the struct ``to``: ``ids``, ``ends`` (source bytes before the end of each piece; the end id ends with
    the text) and ``decoded``, the text that the ids decode to. Null texts are empty ones; all rows and columns stay.

    ``model`` is the path of a model file on the driver. Texts are handled in slices of bounded size.
    """
    with open(model, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = loaded(shared.value)
        for batch in batches:
            if not len(batch):
                yield pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("decoded", pa.string())]))
            for part in slices(batch):
                ids, ends = [], []
                for x in part.to_pylist():
                    found, at = pieces.encode(x or "")
                    if end_id:
                        found, at = np.append(found, pieces.end_id), np.append(at, at[-1] if len(at) else 0)
                    ids.append(found)
                    ends.append(at)
                lists = _lists(ids)
                shown = pieces.decode_all(lists.values.to_numpy(), np.frombuffer(lists.buffers()[1], np.int32))
                yield pa.StructArray.from_arrays([lists, _lists(ends), pa.array(shown, pa.string())], ["ids", "ends", "decoded"])
            batch = part = None  # else it is held until the next one is read

    return df.withColumn(to, run(named(df, text)))
