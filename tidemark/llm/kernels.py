"""Vectorised text kernels over Arrow buffers: words, hashes of stretches and windows, window minima, anchored segments.

All work on one contiguous byte buffer that holds many documents; nothing loops over bytes or words in Python.

What decides that texts are equal is a sum of random numbers, one per (eight bytes, place), or a tree of nonlinear steps over
such sums: no pair of texts collides but by chance. Polynomial hashes modulo 2**64 (Prefix) have such pairs; they
only choose anchors, where a collision costs work and changes no result.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACE_BYTES

U = np.uint64


def keep_freed_memory(up_to: int = 64 << 20) -> None:
    """Has the C allocator keep what arrays free, up to a bound, for the next ones: mapping fresh pages for every
    temporary array would take longer than the work on it. Does nothing where the allocator has no such setting."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return
    mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD: arrays below this come from the heap
    mallopt(-1, up_to)  # M_TRIM_THRESHOLD


keep_freed_memory()
#: Bytes of text worked on at once (a longer document is worked on alone).
CHUNK = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACE_BYTES)] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INV):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n + 1).bit_length())
    return _powers(size)


class Prefix:
    """Polynomial hashes of the windows of a sequence of 64-bit codes; to choose anchors, never to tell texts apart."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = powers(len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self.sums[1:])

    def sliding(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of stretches of whole documents of about `size` bytes."""
    if not len(column):
        return
    data, at = buffer_of(column)
    row, n = 0, len(at) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, stop, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the document it is in (as a row of `at`)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ((data - np.uint8(9)) > 4) & (data != 32)
    edges = [np.zeros(int(inside[0]), np.int64), np.flatnonzero(inside[1:] != inside[:-1]) + 1, np.full(int(inside[-1]), n)]
    seams = at[1:-1]
    seams = np.unique(seams[(seams > 0) & (seams < n)])
    seams = seams[inside[seams - 1] & inside[seams]]  # words that only the end of a document parts
    turn = np.concatenate(edges)
    if len(seams):
        turn = np.insert(turn, np.repeat(np.searchsorted(turn, seams), 2), np.repeat(seams, 2))
    start, end = turn[0::2], turn[1::2]
    return start, end, np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def stretch_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch [start, end) of bytes: the sum of random numbers, one per (eight bytes, place of them)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    held = np.zeros(len(data) // 8 + 2, np.uint64)
    held.view(np.uint8)[: len(data)] = data
    size = end - start
    count = (size + 7) >> 3
    stop = np.cumsum(count)
    place = np.arange(int(stop[-1])) - np.repeat(stop - count, count)
    at = np.repeat(start, count) + (place << 3)
    left = np.minimum(np.repeat(end, count) - at, 8)
    row, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    value = (held[row] >> shift) | ((held[row + 1] << U(1)) << (U(63) - shift))
    value &= _MASK[left]
    value *= U(0xD6E8FEB86659FD93)
    value ^= value >> U(32)
    value += ((place << 3) + left).astype(np.uint64) * BASE
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value), out=sums[1:])
    return mix(sums[stop] - sums[stop - count])


word_codes = stretch_codes


def run_codes(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each of the disjoint runs codes[first..last]: sums of numbers that depend on code and place."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = last - first + 1
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    value = mix(codes[np.repeat(first, size) + place] + (place + 1).astype(np.uint64) * BASE)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    ends = np.cumsum(size)
    return mix(sums[ends] - sums[ends - size] + size.astype(np.uint64))


def _paired(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    x = a * U(0xD6E8FEB86659FD93) + b * U(0xA0761D6478BD642F)
    x += U(turn)
    x ^= x >> U(32)
    x *= U(0xBF58476D1CE4E5B9)
    return x


def window_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive codes, by doubling."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    have, out = 1, codes
    while have * 2 <= width:
        out, have = _paired(out[:-have], out[have:], have), have * 2
    if have < width:
        out = _paired(out[: len(out) - (width - have)], out[width - have :], width)
    return mix(out)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def segments(unit: Prefix, doc: np.ndarray, window: int, gram: int, prefer: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Cuts a sequence into segments by content: equal windows always lie in segments of equal anchors.

    The anchor of a window of `window` units is the leftmost `gram` of least hash in it; a segment is a run of
    windows with one anchor. prefer: of each gram, up to 6 bits that come before its hash (less: preferred).
    Returns first window, last window (in units), the anchor's hash and its place. A sequence has fewer than 2**32 units.
    """
    empty = np.zeros(0, np.int64)
    if len(doc) < window:
        return empty, empty, empty.view(np.uint64), empty
    if len(doc) >> 32:
        raise ValueError("a text of 2**32 units or more")
    hashes = mix(unit.sliding(gram))
    n_win, order = len(doc) - window + 1, hashes >> U(32)
    if prefer is not None:
        order = (order >> U(6)) | (prefer.astype(np.uint64) << U(26))
    order = (order << U(32)) | np.arange(len(order), dtype=np.uint64)
    place = (window_min(order, window - gram + 1) & U((1 << 32) - 1)).astype(np.int64)
    whole = doc[:n_win] == doc[window - 1 :]
    fresh = whole.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
    final = whole.copy()
    final[:-1] &= (place[1:] != place[:-1]) | ~whole[1:]
    first, last = np.flatnonzero(fresh), np.flatnonzero(final)
    return first, last, hashes[place[first]], place[first]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of the n units that the spans cover."""
    if not len(starts):
        return np.zeros(n, bool)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:n]) > 0
