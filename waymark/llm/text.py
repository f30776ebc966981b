"""Vectorised word splitting and hashing over Arrow text columns.

Texts are handled as one UTF-8 byte buffer with offsets, so that a whole slice
of documents is split and hashed by a few numpy passes. All word classes used
here are defined on bytes, which is exact for UTF-8: every byte of a character
beyond ASCII is 0x80 or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
_U = np.uint64
_Q = _U(0xD6E8FEB86659FD93)


def _table(separators: set[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


#: Separators of `[^\x20\x09-\x0D]+`.
SPACES = _table({0x20, *range(0x09, 0x0E)})
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_ALNUM = _table({*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})
#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes, or of a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(32)
    return h


#: Spans of more bytes are hashed one by one; shorter ones all at once, eight bytes a step.
_LONG_SPAN = 1024
_SEEDS = (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))
_MASKS = (_U(1) << (_U(8) * np.arange(8, dtype=np.uint64))) - _U(1)


def _view(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a buffer on, as one little-endian integer (zeros beyond the end)."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes wherever they stand. Two seeds give independent hashes.

    Every eight bytes are mixed into what was there before, so no algebra ties
    the hashes of related spans together, as it would with a polynomial.
    """
    size = (ends - starts).astype(np.int64)
    out = size.astype(np.uint64) * _Q ^ _SEEDS[seed]
    if not len(starts):
        return out
    view = _view(buf)
    long = np.flatnonzero(size > _LONG_SPAN)
    live = np.flatnonzero(size <= _LONG_SPAN) if len(long) else np.arange(len(starts))
    at, left, h = starts[live], size[live], out[live]
    while len(live):
        word = view[np.minimum(at, len(buf))]
        word = np.where(left >= 8, word, word & _MASKS[np.clip(left, 0, 7)])
        h = mix(h + word)
        more = left > 8
        if not more.all():
            out[live[~more]] = h[~more]
            live, at, left, h = live[more], at[more], left[more], h[more]
        at, left = at + 8, left - 8
    for k in long.tolist():
        digest = hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8, salt=bytes([seed]))
        out[k] = int.from_bytes(digest.digest(), "little")
    return out


def equal_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray, other_buf: np.ndarray | None = None) -> np.ndarray:
    """Whether each span holds the same bytes as the other span of its row."""
    size = end - start
    same = size == other_end - other
    mine = _view(buf)
    yours = mine if other_buf is None else _view(other_buf)
    live = np.flatnonzero(same & (size > 0) & ((start != other) | (other_buf is not None)))
    done = 0
    while len(live):
        left = size[live] - done
        differ = mine[start[live] + done] ^ yours[other[live] + done]
        differ = np.where(left >= 8, differ, differ & _MASKS[np.clip(left, 0, 7)])
        same[live[differ != 0]] = False
        live = live[(differ == 0) & (left > 8)]
        done += 8
    return same


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values; entry i is that of h[i : i + n]."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, factor = h, 1, _Q
    acc, covered = None, 0
    bits, m = n, len(h)
    while True:  # doubling: `out` covers `have` values, `acc` the `covered` first ones
        if bits & 1:
            if acc is None:
                acc, covered, acc_factor = out, have, factor
            else:
                size = m - covered - have + 1
                acc = acc[:size] * factor + out[covered : covered + size]
                covered += have
        bits >>= 1
        if not bits:
            return mix(acc)
        size = m - 2 * have + 1
        out = out[:size] * factor + out[have : have + size]
        factor = _U(int(factor) * int(factor) & 0xFFFFFFFFFFFFFFFF)
        have *= 2


@dataclass
class Words:
    """Words of some rows: their bytes are buf[start:end], `doc` is the row of each, `first` the number of words before each row."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hash_spans(self.buf, self.start, self.end, seed)

    def windows(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of n words within one row start, and their hashes."""
        w = rolling(h, n)
        at = np.flatnonzero(self.doc[: len(w)] == self.doc[n - 1 :][: len(w)]) if len(w) else np.zeros(0, np.int64)
        return at, w[at]


def split(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> Words:
    """The words of each row of a byte buffer."""
    offsets = offsets - offsets[0]
    inside = ~separators[buf]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(buf))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets, "left")
    return Words(buf, start, stop, doc, first)


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of `size` places lie in a window of `width` from one of the starts."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, size), -1)
    return np.cumsum(step[:-1]) > 0
