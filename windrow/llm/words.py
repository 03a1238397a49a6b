"""Words of whole Arrow batches as 64-bit hashes, without a Python step per word.

A word is a run of bytes other than space and tab to carriage return. Its hash is a
polynomial of its bytes, taken as the difference of two running sums over the slice and
mixed at the end, so a slice costs a few numpy passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NO_LETTER = np.ones(256, bool)  # ASCII other than letters and digits; bytes of longer characters count as letters
NO_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("_POWERS", _BASE), ("_INVERSES", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS, _INVERSES


class Words:
    """Words of some texts: ``hash`` of each, ``begin`` and ``end`` byte in ``data``, ``first`` word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, gaps: np.ndarray = SPACE):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        word = np.zeros(n + 2, bool)
        word[1:-1] = ~gaps[data]
        cuts = offsets[1:-1]
        # a text's first byte starts a word even if the byte before, of another text, is not white space
        edge = np.zeros(n + 1, bool)
        edge[cuts] = True
        starts = word[1:] & (~word[:-1] | edge)
        ends = word[:-1] & (~word[1:] | edge)
        self.begin, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.begin]) * down[self.begin] + (self.end - self.begin).astype(np.uint64))
        self.first = np.searchsorted(self.begin, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def slices(texts: pa.Array, size: int = 900_000, lower: bool = False, gaps: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    """Words of consecutive texts of about ``size`` bytes together (a longer text comes alone), with their range."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    cuts = np.flatnonzero(np.diff((offsets[1:] - offsets[0]) // size)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower, gaps)


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values, by position of its first; the last ``n - 1`` have none."""
    out = hashes[: max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out * _U(_BASE) + hashes[k : len(hashes) - n + 1 + k])
    return out
