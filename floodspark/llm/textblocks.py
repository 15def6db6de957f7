"""Whole-column tokenising of Arrow text batches with NumPy, used inside ``mapInArrow`` tasks.

A batch is handled in blocks of about one megabyte, so that memory does not depend on how many rows
Spark puts in a batch. Within a block all documents are tokenised at once: a token is a maximal run
of bytes of one class, and its 64-bit hash comes from prefix sums of a polynomial over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_SPACES = b" \t\n\v\f\r"


def _classes(symbols: bool) -> np.ndarray:
    """Class of each byte: 0 separates, 1 letters and digits (all of non-ASCII too), 2 symbols."""
    out = np.full(256, 2 if symbols else 0, np.uint8)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            out[b] = 1
    out[list(_SPACES)] = 0
    out[0] = 0
    return out


SOLID = np.array([b not in _SPACES for b in range(256)], np.uint8)
ALNUM = _classes(symbols=False)
ALNUM_AND_SYMBOLS = _classes(symbols=True)

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(U64)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, BLOCK_BYTES + BLOCK_BYTES // 4)
        steps = np.full(size, _BASE if kind == "up" else _BASE_INVERSE, U64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit result."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


@dataclass
class Block:
    """Texts ``first`` to ``last`` of a batch; ``offsets`` delimit them in ``data``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return self.last - self.first


def blocks(texts: pa.Array, lower: bool = True, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts, of about ``block_bytes`` (or one longer text); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    first = 0
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + block_bytes, "right")))
        part = texts.slice(first, last - first)
        part = pc.utf8_lower(part) if lower else pa.concat_arrays([part])
        _, offs, data = part.buffers()
        offsets = np.frombuffer(offs, np.int64, part.offset + len(part) + 1)[part.offset :]
        raw = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
        yield Block(first, last, raw[offsets[0] : offsets[-1]], offsets - offsets[0])
        first = last


@dataclass
class Tokens:
    """Tokens of a block. ``bounds[d]:bounds[d+1]`` are the tokens of its document ``d``."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def tokens(block: Block, classes: np.ndarray = ALNUM, prefix: int | None = None) -> Tokens:
    """Maximal runs of one byte class; with ``prefix``, hashes are of the first so many bytes."""
    data, n = block.data, len(block.data)
    kind = classes[data]
    change = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[block.offsets] = True
    edges = np.flatnonzero(change)
    starts = edges[:-1][kind[edges[:-1]] != 0] if n else edges[:0]
    ends = edges[1:][kind[edges[:-1]] != 0] if n else edges[:0]
    bounds = np.searchsorted(starts, block.offsets)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * _power("up", n), out=sums[1:])
    stop = ends if prefix is None else np.minimum(ends, starts + prefix)
    hashes = mix((sums[stop] - sums[starts]) * _power("down", n + 1)[starts])
    return Tokens(starts, ends, hashes, bounds)


def shingles(words: Tokens, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words of each document, and their bounds by document.

    A document of fewer than ``k`` words, but one at least, has one shingle of all its words.
    """
    n, h = len(words.hashes), words.hashes
    total = np.zeros(max(n - k + 1, 0), U64)
    for i in range(k if n >= k else 0):
        total = total * U64(0xC2B2AE3D27D4EB4F) + h[i : n - k + 1 + i]
    counts = words.counts
    short = (counts > 0) & (counts < k)
    room = np.repeat(words.bounds[1:], counts) - np.arange(n)
    if not short.any():
        out = total[room[: len(total)] >= k]
    else:
        full = np.zeros(n, U64)
        full[: len(total)] = total
        for d in np.flatnonzero(short):
            value = U64(0)
            with np.errstate(over="ignore"):
                for x in h[words.bounds[d] : words.bounds[d + 1]]:
                    value = value * U64(0xC2B2AE3D27D4EB4F) + x
            full[words.bounds[d]] = value
        take = room >= k
        take[words.bounds[:-1][short]] = True
        out = full[take]
    sizes = np.where(short, 1, np.maximum(counts - k + 1, 0))
    return mix(out), np.concatenate([[0], np.cumsum(sizes)])


def occurrences(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each key stood earlier in its own document (0 for the first time)."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(U64)
    both = mix(keys ^ mix(doc + U64(1)))
    order = np.argsort(both, kind="stable")
    same = both[order]
    head = np.ones(len(same), bool)
    head[1:] = same[1:] != same[:-1]
    at = np.arange(len(same))
    rank = at - np.maximum.accumulate(np.where(head, at, 0))
    out = np.empty(len(same), np.int64)
    out[order] = rank
    return out
