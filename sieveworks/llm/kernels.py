"""Array kernels over Arrow string columns, used inside tasks.

Texts are handled as one byte buffer with row offsets, so hashing every word
of a batch takes a few numpy passes and no Python loop over words. Memory per
call is bounded by the slice size (``row_slices``) and, for a longer single
text, by the block size of ``word_hashes``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
BLOCK_BYTES = 1 << 20

SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def byte_table(separators, lower: bool) -> np.ndarray:
    """uint8[256]: 0 for separators, otherwise the (folded) byte, never 0."""
    t = np.arange(256, dtype=np.int64)
    if lower:
        t[65:91] += 32
    t[0] = 1  # a NUL in a text is an ordinary character
    t[list(separators)] = 0
    return t.astype(np.uint8)


WORD = byte_table(SPACE_BYTES, lower=False)
WORD_LOWER = byte_table(SPACE_BYTES, lower=True)
#: Words of ASCII letters and digits and of all other scripts; ASCII punctuation separates.
ALNUM_LOWER = byte_table([b for b in range(128) if not chr(b).isalnum()], lower=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (xor-shift-multiply finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 7919 + 1))


BYTE_VALUES = seeded(11, 256)
BASE = 0x5851F42D4C957F2D


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(n, np.uint64(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets (len + 1) of a string column; null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.fill_null("").cast(pa.large_string())
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[a.offset:a.offset + len(a) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return raw[first:offsets[-1]], offsets - first


def row_slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows holding about ``limit`` text bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, row offsets into the words)."""
    n, hashes, firsts = len(data), [], []
    a = 0
    while a < n:
        b = min(n, a + BLOCK_BYTES)
        if b < n:  # end the block after a separator or at a row's end
            gap = np.flatnonzero(table[data[a:b]] == 0)
            row = offsets[np.searchsorted(offsets, b, side="right") - 1]
            cut = max(a + int(gap[-1]) + 1 if len(gap) else a, int(row))
            while cut <= a:  # one word fills the block: go on to its end
                more = min(n, b + BLOCK_BYTES)
                gap = np.flatnonzero(table[data[b:more]] == 0)
                row = offsets[np.searchsorted(offsets, b, side="left")]
                ends = [x for x in (b + int(gap[0]) if len(gap) else n + 1, int(row)) if x <= more]
                cut, b = (min(ends), b) if ends else (a if more < n else n, more)
            b = cut
        m = table[data[a:b]]
        word = m != 0
        new_row = np.zeros(b - a + 1, dtype=bool)
        lo, hi = np.searchsorted(offsets, (a, b))
        new_row[offsets[lo:hi] - a] = True
        new_row[-1] = True
        before = np.empty(b - a, dtype=bool)
        before[:1], before[1:] = False, word[:-1]
        after = np.empty(b - a, dtype=bool)
        after[-1:], after[:-1] = False, word[1:]
        start = np.flatnonzero(word & (~before | new_row[:-1]))
        end = np.flatnonzero(word & (~after | new_row[1:]))
        size = 1 << max(20, int(b - a - 1).bit_length())
        power, inverse = _powers(size)
        value = BYTE_VALUES[m] * power[:b - a]
        total = np.cumsum(value, dtype=np.uint64)
        hashes.append(mix64((total[end] - total[start] + value[start]) * inverse[start] + (end - start).astype(np.uint64)))
        firsts.append(start + a)
        a = b
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return h, first, np.searchsorted(first, offsets)


def grams(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of n words (len(words) - n + 1 of them)."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    c = seeded(seed, n) | np.uint64(1)
    out = words[:k] * c[0]
    for i in range(1, n):
        out = out + words[i:i + k] * c[i]
    return mix64(out)
