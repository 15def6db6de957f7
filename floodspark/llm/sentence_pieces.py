"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map holds; for each
byte of the normalised text the place in the original bytes is recorded. The normalised text is cut
where no piece of the vocabulary can reach over (before a run of word marks), each part is merged by
the vocabulary's scores, and every piece is projected to its span of original bytes. The parts recur
over all texts, so their pieces are remembered, for at most ``REMEMBERED`` parts of a worker.

Any BPE model with byte fallback and without user-defined pieces is read from its file's bytes, which
travel to the tasks as a broadcast of at most ``MODEL_BYTES``. Nothing is shuffled; a task holds one
block of texts of about a megabyte, or one longer text.

Defined cases: a null text is encoded as an empty one (the end id alone), a null list of ids is
decoded as an empty one; the end id has the empty span at the text's end; of a character without a
piece the last byte's piece holds its span and those before are empty; bytes that are no UTF-8 are
decoded as U+FFFD each; ids outside the vocabulary, null ones too, make the decoded text null. Rows keep their order
and number, repeated rows repeat the result, and columns of any name pass through.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MARK = "▁"
MODEL_BYTES, REMEMBERED, REMEMBERED_CHARS = 64 << 20, 200_000, 48
SCANNED_CHARS, BLOCK_BYTES = 64, 1 << 20
#: The kinds of pieces and the replacement of an unknown piece in the model's format.
UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 2, 3, 4, 5, 6
UNKNOWN_SURFACE = " ⁇ "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield tag >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The longest key of a compiled map (a double array of UTF-8 bytes) that a text starts with."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if compiled else []
        self.values = compiled[4 + size :]
        #: Bytes that start no key.
        self.plain = bytes(b for b in range(128) if self._step(self._root(), b) is None)

    def _root(self) -> int:
        return self._child(0, self.units[0]) if self.units else 0

    @staticmethod
    def _child(node: int, unit: int) -> int:
        return node ^ ((unit >> 10) << (8 if unit >> 9 & 1 else 0))

    def _step(self, node: int, byte: int) -> tuple[int, bool] | None:
        """(node after ``byte``, a key ends there), or None."""
        if not self.units or node ^ byte >= len(self.units):
            return None
        unit = self.units[node ^ byte]
        if unit & 0x800000FF != byte:
            return None
        return self._child(node ^ byte, unit), bool(unit >> 8 & 1)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, length of the key) of the longest key at ``at``, or None."""
        node, found = self._root(), None
        for end in range(at, len(text)):
            step = self._step(node, text[end])
            if step is None:
                break
            node = step[0]
            if step[1]:
                found = self.units[node] & 0x7FFFFFFF, end + 1 - at
        if found is None:
            return None
        start = found[0]
        return self.values[start : self.values.index(b"\0", start)], found[1]


class Normaliser:
    """Replaces by a character map, marks spaces, and records where each byte came from."""

    def __init__(self, spec: bytes):
        fields = dict(_fields(spec))
        self.map = CharacterMap(fields.get(2, b""))
        self.dummy_prefix = bool(fields.get(3, 1))
        self.strip = bool(fields.get(4, 1))
        self.space = MARK.encode() if fields.get(5, 1) else b" "
        kept = bytes(b for b in self.map.plain if not (self.strip and b == 32))
        self.run = re.compile(b"[" + re.escape(kept) + b"]+") if kept else None

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised text, place in ``text`` of each of its bytes and of its end)."""
        if not text:
            return b"", np.zeros(1, np.int32)
        if not self.map.units and not self.strip:
            return self._identity(text)
        return self._mapped(text)

    def _identity(self, text: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(text, np.uint8)
        widths = np.where(raw == 32, np.int32(len(self.space)), np.int32(1))
        lead = len(self.space) if self.dummy_prefix else 0
        origin = np.zeros(lead + int(widths.sum()) + 1, np.int32)
        origin[lead:-1] = np.repeat(np.arange(len(raw), dtype=np.int32), widths)
        origin[-1] = len(raw)
        return (self.space if lead else b"") + text.replace(b" ", self.space), origin

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        found = self.map.longest(text, at)
        if found:
            return found
        lead = text[at]
        size = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
        return text[at : at + size], size

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        at, n, parts = 0, len(text), []
        # (bytes of the result, the place that they start from, whether they run along with the text)
        pieces: list[tuple[int, int, bool]] = []

        def put(piece: bytes, start: int, along: bool) -> None:
            widths = np.where(np.frombuffer(piece, np.uint8) == 32, len(self.space), 1)
            if along and len(widths) == widths.sum():
                pieces.append((len(widths), start, True))
            else:
                for i, width in enumerate(widths.tolist()):
                    pieces.append((width, start + i * along, False))
            parts.append(piece.replace(b" ", self.space))

        if self.strip:
            while at < n:
                piece, used = self._prefix(text, at)
                if piece != b" ":
                    break
                at += used
            if at == n:
                return b"", np.zeros(1, np.int32)
        if self.dummy_prefix:
            put(b" ", at, False)
        after_space = self.strip
        while at < n:
            run = self.run.match(text, at) if self.run else None
            piece, used = (run.group(), run.end() - at) if run else self._prefix(text, at)
            if not run and after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece, at, bool(run))
                after_space = self.strip and piece.endswith(b" ")
            at += used
        out = b"".join(parts)
        widths, starts, along = (np.array(c) for c in zip(*pieces)) if pieces else (np.zeros(0, int),) * 3
        first = np.repeat(np.cumsum(widths) - widths, widths)
        origin = np.repeat(starts, widths) + np.where(np.repeat(along, widths), np.arange(len(out)) - first, 0)
        origin = np.append(origin, at).astype(np.int32)
        if self.strip:
            while out.endswith(self.space):
                out = out[: -len(self.space)]
                origin = origin[: len(out) + 1]
        return out, origin


class Vocabulary:
    """Pieces, scores and normaliser of a model file."""

    def __init__(self, model: bytes):
        self.pieces, self.kinds, self.scores, trainer, spec = [], [], [], b"", b""
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, 1))
            elif number == 2:
                trainer = value
            elif number == 3:
                spec = value
        training = dict(_fields(trainer))
        if training.get(3, 1) != 2 or not training.get(35, 0) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces are read")
        self.normaliser = Normaliser(spec)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 1}
        inner = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces with a mark after another character, such as {inner[0]!r}, can't be merged in parts")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.end_id = self.pieces.index(training.get(47, b"</s>").decode())
        self.part = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        order = {score: i for i, score in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.ranks = {p: order[self.scores[i]] for p, i in self.ids.items()}
        #: (id, bytes of the normalised text) of each piece, as 32-bit integers.
        self.packed = {p: struct.pack("ii", i, len(p.encode())) for p, i in self.ids.items()}
        #: What each id adds to a decoded text, in bytes.
        said = [
            b"" if k == CONTROL else UNKNOWN_SURFACE.encode() if k == UNKNOWN
            else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode()
            for p, k in zip(self.pieces, self.kinds)
        ]
        self.said_bytes = np.frombuffer(b"".join(said), np.uint8)
        self.said_sizes = np.array([len(b) for b in said])
        self.said_starts = np.cumsum(self.said_sizes) - self.said_sizes
        self.kind_of = np.array(self.kinds)

    def surface(self, ids: np.ndarray) -> bytes:
        """What ``ids`` add to a text, one after another."""
        sizes = self.said_sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.said_starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.said_bytes[at].tobytes()

    def merged(self, part: str) -> list[str]:
        """The pieces of a part: the best pair of neighbours is merged, of equals the leftmost, until none is known."""
        if len(part) > SCANNED_CHARS:
            return self._merged_by_heap(part)
        symbols, known, none = list(part), self.ranks.get, len(self.ranks)
        ranks = [known(part[i : i + 2], none) for i in range(len(part) - 1)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i] = both = symbols[i] + symbols[i + 1]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = known(both + symbols[i + 1], none)
            if i:
                ranks[i - 1] = known(symbols[i - 1] + both, none)
        return symbols

    def _merged_by_heap(self, part: str) -> list[str]:
        symbols: list[str | None] = list(part)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap: list[tuple[int, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                both = symbols[left] + symbols[right]
                rank = self.ranks.get(both)
                if rank is not None:
                    heapq.heappush(heap, (rank, left, right, both))

        for i in range(1, len(symbols)):
            offer(i - 1, i)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            if symbols[left] is None or symbols[right] is None or after[left] != right or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, None
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s is not None]

    def numbered(self, part: str) -> bytes:
        """(id, bytes of the normalised text) of each piece of a part, as 32-bit integers in a row."""
        pieces = self.merged(part)
        try:
            return b"".join([self.packed[p] for p in pieces])
        except KeyError:
            out = []
            for piece in pieces:
                raw = piece.encode()
                last = len(raw) - 1
                out.append(self.packed.get(piece) or b"".join(struct.pack("ii", self.bytes[b], len(raw) * (i == last)) for i, b in enumerate(raw)))
            return b"".join(out)


class _Known(dict):
    """The numbered pieces of parts, computed when first met; those of the generation before are kept if met again."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.before = vocabulary, {}

    def __missing__(self, part: str) -> bytes:
        found = self.before.get(part)
        if found is None:
            found = self.vocabulary.numbered(part)
        if len(part) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[part] = found
        return found


@lru_cache(2)
def _loaded(model: bytes) -> tuple[Vocabulary, _Known]:
    vocabulary = Vocabulary(model)
    return vocabulary, _Known(vocabulary)


def encode_text(vocabulary: Vocabulary, known: dict[str, bytes], text: str, add_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, starts, ends) of one text; the spans are of its UTF-8 bytes."""
    raw = text.encode()
    normal, origin = vocabulary.normaliser(raw)
    parts = vocabulary.part.findall(normal.decode())
    ids, widths = np.frombuffer(b"".join(map(known.__getitem__, parts)), np.int32).reshape(-1, 2).T
    ends = np.cumsum(widths)
    starts, ends = origin[ends - widths], origin[ends]
    if add_end:
        ids, starts, ends = np.append(ids, vocabulary.end_id), np.append(starts, len(raw)), np.append(ends, len(raw))
    return ids.astype(np.int32), starts.astype(np.int32), ends.astype(np.int32)


def _text_of(raw: bytes) -> str:
    """UTF-8 decoded, with U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(raw[at : at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(out)


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray | list[int]) -> str | None:
    """The text of ``ids``; the mark that normalisation put in front goes. A control id ends a run of byte pieces."""
    ids = np.asarray(ids, np.int64)
    if not len(ids):
        return ""
    if ids.min() < 0 or ids.max() >= len(vocabulary.pieces):
        return None
    controls = vocabulary.kind_of[ids] == CONTROL
    normal, joined = vocabulary.normaliser, vocabulary.surface(ids)
    first = vocabulary.kind_of[ids[np.argmin(controls)]]
    mark = int(first == 1 and joined[:1] == b" " and (normal.dummy_prefix or normal.strip))
    try:
        text = joined.decode()
        if not controls[1:-1].any():
            return text[mark:]
    except UnicodeDecodeError:
        pass
    runs = np.split(ids, np.flatnonzero(controls))
    return "".join(_text_of(vocabulary.surface(run)) for run in runs)[mark:]


def decode_lists(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[str | None]:
    """The texts of many lists of ids, one after another in ``ids`` up to ``ends``; the surfaces of all are made at once."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.pieces)):
        return [decode_ids(vocabulary, part) for part in np.split(ids, ends[:-1])]
    normal = vocabulary.normaliser
    kinds = vocabulary.kind_of[ids]
    raw = vocabulary.surface(ids)
    controls = np.concatenate([[0], np.cumsum(kinds == CONTROL)])
    stops = np.concatenate([[0], np.cumsum(vocabulary.said_sizes[ids])])
    starts = np.concatenate([[0], ends[:-1]])
    # Of these the first piece is ordinary and no id but the last is a control.
    last = kinds[np.maximum(ends - 1, 0)] == CONTROL if len(ids) else np.zeros(len(ends), bool)
    filled = ends > starts
    plain = filled & (controls[ends] - controls[starts] == last)
    if len(ids):
        plain &= kinds[np.minimum(starts, len(ids) - 1)] == 1
    out: list[str | None] = []
    for first, end, simple, a, b in zip(starts.tolist(), ends.tolist(), plain.tolist(), stops[starts].tolist(), stops[ends].tolist()):
        text = None
        if simple:
            lead = a + (raw[a : a + 1] == b" " and (normal.dummy_prefix or normal.strip))
            try:
                text = raw[lead:b].decode()
            except UnicodeDecodeError:
                pass
        out.append(decode_ids(vocabulary, ids[first:end]) if text is None else text)
    return out


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BLOCK_BYTES in all, or of one larger row."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, "right")))
        yield first, last
        first = last


def _mapped(df: DataFrame, column: str, model: bytes, added: str, work: Callable) -> DataFrame:
    """``df`` with the struct ``added`` that ``work`` makes of ``column``; other columns pass in a struct, so names don't clash."""
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the model has {len(model)} bytes, more than {MODEL_BYTES}")
    shared = df.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*[df[f"`{c}`"] for c in df.columns]) if df.columns else F.struct(F.lit(None))
    packed = df.select(F.col(f"`{column}`").alias("value"), row.alias("row"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = _loaded(shared.value)
        for batch in batches:
            values = batch.column("value")
            text = pa.types.is_string(values.type) or pa.types.is_large_string(values.type)
            sizes = pc.binary_length(values) if text else pc.list_value_length(values)
            for first, last in _blocks(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)):
                made = work(vocabulary, known, values.slice(first, last - first))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, last - first), made], names=["row", "made"])

    typed = StructType([packed.schema["row"], StructType.fromDDL(f"made {added}")["made"]])
    return packed.mapInArrow(mapped, typed)


def encode(df: DataFrame, model: bytes, text: str = "text", add_end: bool = True, out: str = "pieces") -> DataFrame:
    """``df`` with a struct ``out`` of ids, starts and ends (spans of the text's UTF-8 bytes), one of each for every piece."""

    def work(vocabulary: Vocabulary, known: dict[str, bytes], texts: pa.Array) -> pa.Array:
        found = [encode_text(vocabulary, known, t or "", add_end) for t in texts.to_pylist()]
        edges = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([f[i] for f in found]))) for i in range(3)]
        return pa.StructArray.from_arrays(lists, names=["ids", "starts", "ends"])

    made = _mapped(df, text, model, "struct<ids: array<int>, starts: array<int>, ends: array<int>>", work)
    return made.select("row.*", F.col("made").alias(out))


def decode(df: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text ``out`` of the list of ids in column ``ids``."""

    def work(vocabulary: Vocabulary, known: dict[str, bytes], lists: pa.Array) -> pa.Array:
        numbers = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        texts = decode_lists(vocabulary, numbers.astype(np.int64), ends)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string())], names=["text"])

    return _mapped(df, ids, model, "struct<text: string>", work).select("row.*", F.col("made.text").alias(out))
