"""Numpy views of Arrow text columns, shared by the operators that scan text.

Texts are handled as UTF-8 bytes, a slice of a record batch at a time, so a
task holds a few megabytes of working arrays whatever the batch size. Words
are runs of bytes other than space and ``\\t \\n \\v \\f \\r``.

Words, lines and other spans are known by 64-bit hashes: eight bytes at a time go
through a mixing step, so strings with a regular structure collide no more often than
random ones; long spans are hashed by BLAKE2b. Polynomial prefix hashes (modulo 2**64)
serve short windows and comparisons that are verified: alone they collide on
repetitive strings of a thousand bytes and more.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

SLICE_BYTES = 1 << 20  # working arrays take up to a hundred times as much
LONG_SPAN = 1024  # bytes; longer spans are hashed one by one
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def _grow_powers(n: int) -> None:
    global _powers, _inverse_powers
    if len(_powers) <= n:
        size = max(n + 1, 1 << 20)

        def table(factor: int) -> np.ndarray:
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            return np.cumprod(steps)

        _powers, _inverse_powers = table(_BASE), table(_BASE_INV)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64-bit word (two multiply-xorshift rounds)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class TextBlock:
    """A few texts as one byte array; ``offsets[i]:offsets[i + 1]`` is text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> "TextBlock":
        """A-Z lower-cased, every other byte as it is."""
        return TextBlock(_LOWER[self.data], self.offsets, self.first)

    def text_bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, word_offsets): byte spans of all words; the words of
        text i are ``word_offsets[i]:word_offsets[i + 1]``. No word spans two texts."""
        inside = ~_SEPARATOR[self.data]
        return self.spans(inside)

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(inside)
        edge = np.zeros(n + 1, bool)  # positions where a text begins
        edge[self.offsets] = True
        before = np.concatenate(([False], inside[:-1])) if n else inside
        after = np.concatenate((inside[1:], [False])) if n else inside
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mixed 64-bit hashes of byte spans, the same wherever a span stands."""
        length = ends - starts
        out = mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        eight = np.lib.stride_tricks.sliding_window_view(
            np.concatenate((self.data, np.zeros(8, np.uint8))), 8)
        todo, at = np.flatnonzero((length > 0) & (length <= LONG_SPAN)), 0
        while len(todo):
            lane = eight[starts[todo] + at].view(np.uint64).ravel()
            lane &= _FIRST_BYTES[np.minimum(length[todo] - at, 8)]
            out[todo] = mix((out[todo] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ lane)
            at += 8
            todo = todo[length[todo] > at]
        for i in np.flatnonzero(length > LONG_SPAN):
            digest = blake2b(self.data[starts[i]:ends[i]], digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
        return out

    def prefix_hash(self) -> np.ndarray:
        """P with P[i] = sum of (byte + 1) * base**position over the first i bytes."""
        n = len(self.data)
        _grow_powers(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=out[1:])
        return out

    @staticmethod
    def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Position-independent, unmixed hashes of byte spans."""
        return (prefix[ends] - prefix[starts]) * _inverse_powers[starts]


def text_blocks(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[TextBlock]:
    """Split a string column (null: empty text) into blocks of about ``slice_bytes``.

    A text longer than that is a block of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw_offsets, raw_data = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw_data, np.uint8) if raw_data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + slice_bytes, "right")) - 1
        last = min(n, max(last, first + 1))
        lo, hi = offsets[first], offsets[last]
        yield TextBlock(data[lo:hi], offsets[first:last + 1] - lo, first)
        first = last


def word_hashes(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """(mixed hash of every word, word_offsets)."""
    starts, ends, word_offsets = block.words()
    return block.hashes(starts, ends), word_offsets


_SEQUENCE = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, 33)], np.uint64)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive items (order matters)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += hashes[k:k + n] * _SEQUENCE[k]
    return mix(out)


def shingles(hashes: np.ndarray, word_offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per text: its sorted distinct ``width``-word shingles.

    A text with fewer words gives its whole sequence as one shingle, a text
    without words an empty set.
    """
    windows = window_hashes(hashes, width)
    for lo, hi in zip(word_offsets[:-1], word_offsets[1:]):
        if hi - lo >= width:
            yield np.unique(windows[lo:hi - width + 1])
        elif hi > lo:
            yield window_hashes(hashes[lo:hi], int(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def binary_array(parts: list[np.ndarray | bytes]) -> pa.Array:
    return pa.array([p if isinstance(p, bytes) else p.tobytes() for p in parts], pa.binary())


def pack_integers(values: np.ndarray) -> bytes:
    """Sorted or small integers as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_integers(data: bytes, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)
    return np.cumsum(steps, dtype=kind)
