"""Words, word hashes and shingle hashes of an Arrow batch of texts, as numpy arrays.

A batch is cut into segments of bounded bytes; each segment is one byte array
holding many texts, so that every step is a handful of vector operations and
memory follows the segment, not the table. A single text larger than the bound
makes a segment of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 20
#: For steps whose arrays are many times the segment.
SMALL_BYTES = 1 << 18

_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)
_SEEDS = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))

#: Separators of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Separators of the word rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over lower-cased text:
#: digits, a-z and every byte of a non-ASCII character stay.
NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = False
NOT_WORD[97:123] = False
NOT_WORD[128:] = False

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the xor-shift-multiply of MurmurHash3)."""
    x = x ^ (x >> _U(33))
    x *= _M1
    x ^= x >> _U(33)
    x *= _M2
    x ^= x >> _U(33)
    return x


@dataclass
class Segment:
    """Texts ``first .. first + n`` of a batch; word arrays run over all of them."""

    first: int
    n: int
    data: np.ndarray  # uint8, separators between texts included
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    doc: np.ndarray  # int64, text of each word, counted from ``first``
    words: np.ndarray  # words of each text
    begin: np.ndarray  # index of each text's first word
    borders: np.ndarray  # byte offset after each text's closing separator

    def word_hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each word: 8-byte little-endian pieces, chained and finalised."""
        length = self.end - self.start
        h = mix(length.astype(_U) + _SEEDS[seed])
        if not len(h):
            return h
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
        at, left, live = self.start.copy(), length.copy(), np.arange(len(h))
        while len(live):
            piece = np.ascontiguousarray(eights[at]).view(_U).ravel()
            keep = np.minimum(left, 8)
            piece &= _U(0xFFFFFFFFFFFFFFFF) >> ((8 - keep).astype(_U) * _U(8))
            h[live] = mix(h[live] * _SEEDS[0] + piece)
            more = left > 8
            at, left, live = at[more] + 8, left[more] - 8, live[more]
        return h


def _cut(data: np.ndarray, offsets: np.ndarray, first: int, sep: np.ndarray, lower: bool) -> Segment:
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    body = data[offsets[0] : offsets[-1]]
    if lower:
        body = LOWER[body]
    # one separator after each text, so that no word crosses a border
    out = np.full(len(body) + n, 32, np.uint8)
    borders = np.cumsum(lengths + 1)
    inside = np.ones(len(out), bool)
    inside[borders - 1] = False
    out[inside] = body
    is_word = ~sep[out]
    edge = np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(borders, start, side="right")
    words = np.bincount(doc, minlength=n)
    return Segment(first, n, out, start, end, doc, words, np.cumsum(words) - words, borders)


def segments(texts: pa.Array, sep: np.ndarray, lower: bool = False, limit: int = SEGMENT_BYTES) -> Iterator[Segment]:
    """Cuts a string column into segments; a null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), len(texts))
        yield _cut(data, offsets[i : j + 1], i, sep, lower)
        i = j


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, by doubling; the result has len(h) - k + 1 entries."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out, done, level, span = None, 0, h, 1
    left = k
    while True:
        if left & 1:
            part = level[done : done + n]
            out = part if out is None else mix(out * _SEEDS[1] + part)
            done += span
        left >>= 1
        if not left:
            return out
        level = mix(level[:-span] * _SEEDS[0] + level[span:])
        span *= 2


def gram_rows(seg: Segment, k: int) -> np.ndarray:
    """Word indexes at which a k-gram lies inside one text."""
    n = len(seg.doc) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(seg.doc[:n] == seg.doc[k - 1 :])
