"""Vectorised words and word windows of UTF-8 texts.

Texts of an Arrow column are read as one byte buffer; words, their hashes and
windows of words are arrays over that buffer, so the cost per word is a few array
operations instead of Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def lowered_bytes() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves every other byte."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


LOWER = lowered_bytes()
_CODES = np.arange(1, 257, dtype=np.uint64)


def non_space() -> np.ndarray:
    """Bytes of words that end at a space, tab, or one of the line and page breaks."""
    out = np.ones(256, dtype=bool)
    out[32] = False
    out[9:14] = False
    return out


def alphanumeric() -> np.ndarray:
    """Digits, a-z and every byte of a non-ASCII character."""
    out = np.zeros(256, dtype=bool)
    out[0x30:0x3A] = True
    out[0x61:0x7B] = True
    out[0x80:] = True
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (in place on a copy)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES * 2)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, dtype=np.uint64)
            out[1:] = np.uint64(base & _MASK)
            np.multiply.accumulate(out, out=out)
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Texts:
    """Some rows' texts: bytes, and where each text begins (one more entry at the end)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts_of(column, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Pieces of a string column, whole rows each, of about ``chunk_bytes`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = buffers[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    null = np.asarray(column.is_null())
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + chunk_bytes, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        part = offsets[start : stop + 1]
        yield Texts(start, data[part[0] : part[-1]], part - part[0], null[start:stop])
        start = stop


@dataclass
class Words:
    """Words of some texts: hashes and byte ranges; ``ptr`` has each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray


def words(texts: Texts, is_word: np.ndarray, lower: bool = True) -> Words:
    data = LOWER[texts.data] if lower else texts.data
    n = len(data)
    offsets = texts.offsets
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64))
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    # A word never runs across two texts.
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(closes) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.multiply(_CODES[data], up[:n], out=total[1:])
    np.cumsum(total, out=total)
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets, side="left"))


def windows(found: Words, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; only valid where a text has that many."""
    h = found.hashes
    out = np.zeros(len(h), dtype=np.uint64)
    n = len(h) - size + 1
    if n <= 0:
        return out
    acc = np.full(n, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        acc *= np.uint64(0xD6E8FEB86659FD93)
        acc += h[k : k + n]
        acc ^= acc >> np.uint64(32)
    out[:n] = mix(acc)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    if len(values) < 2:
        return values
    keep = np.empty(len(values), dtype=bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(texts: Texts, is_word: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's distinct windows of ``size`` words, sorted; a shorter text is one window."""
    found = words(texts, is_word)
    full = windows(found, size)
    out = []
    for a, b in zip(found.ptr[:-1].tolist(), found.ptr[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(distinct(full[a : b - size + 1]))
        elif b > a:
            short = Words(found.hashes[a:b], found.starts[a:b], found.ends[a:b], found.ptr[:0])
            out.append(windows(short, b - a)[:1])
        else:
            out.append(full[:0])
    return out


def set_signature(values: np.ndarray) -> int:
    """One signed 64-bit number for a set of hashes, whatever their order."""
    total = int(np.add.reduce(mix(values ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64))
    total = (total + len(values) * 0x8EBC6AF09C88C6E3) & _MASK
    mixed = int(mix(np.array([total], dtype=np.uint64))[0])
    return mixed - (1 << 64) if mixed >> 63 else mixed
