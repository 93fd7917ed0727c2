"""Shingle sets of whole texts, hashed a block of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a shingle.
SHINGLE = 5
#: Bytes of texts that are cut into words together, and rows; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 1000
#: Bytes whose words are hashed together.
HASHED = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_M64 = (1 << 64) - 1
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: Base of the words' polynomials and its inverse modulo 2^64.
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers; one to one."""
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIERS[0]
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLIERS[3]
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _M64, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, HASHED), _powers(_INVERSE, HASHED)
#: A number for every byte, one for both cases of A-Z.
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIERS[1])
_LETTER[65:91] = _LETTER[97:123]


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every stretch from starts to ends, by sums of powers over HASHED bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + HASHED, "right")))
        n = int(ends[j - 1] - first)
        up, down = (_UP[:n], _DOWN[:n]) if n <= HASHED else (_powers(_BASE, n), _powers(_INVERSE, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[raw[first : first + n]] * up, out=sums[1:], dtype=np.uint64)
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _MULTIPLIERS[2]
        i = j
    return mix(out)


def _chained(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * _MULTIPLIERS[j] + words[j : j + n]
    return mix(out)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, over A-Z lower-cased words."""
    col = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, 8 * col.offset)
    if at[-1] == at[0]:
        return [np.zeros(0, np.uint64)] * len(col)
    raw = np.frombuffer(col.buffers()[2], np.uint8, int(at[-1] - at[0]), int(at[0]))
    at = at - at[0]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    word = ~_SPACE[raw]
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    words = _word_hashes(raw, first, last)
    runs = _chained(words, SHINGLE)
    cut = np.searchsorted(first, at).tolist()
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        s = runs[a : b - SHINGLE + 1] if b - a >= SHINGLE else _chained(words[a:b], b - a) if b > a else words[:0]
        s = np.sort(s)
        new = s[1:] != s[:-1]
        out.append(s if new.all() else s[np.r_[True, new]])
    return out


def sets_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Small slices of the batches with the sets of their column ``text``."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = min(start + BLOCK_ROWS, max(start + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right"))))
            part = batch.slice(start, stop - start)
            yield part, shingle_sets(part.column("text"))
            start = stop
