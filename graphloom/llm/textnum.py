"""Texts of an Arrow batch as numpy arrays: bytes, words, word shingles and their 64-bit hashes.

Everything works on slices of at most ``SLICE`` bytes (one longer text makes a slice of its own), so
the memory of a task doesn't depend on how many rows Spark puts into a batch.  All hashes depend on
the bytes alone: every executor computes the same ones.

Words are maximal runs without space, tab, LF, VT, FF and CR; A-Z count as a-z.  Two different word
sequences share a 64-bit hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_LOWER = BYTE[LOWER]
BASE = int(_rng.integers(1, 1 << 62, dtype=np.uint64)) * 4 + 3
UNBASE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 65536)
        have = np.full(size, np.uint64(base % (1 << 64)), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit; works in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows; the bytes of row ``first + i`` are
    ``bytes[offsets[i]:offsets[i + 1]]``.  A null text counts as an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield row, whole[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bounds): byte spans of the words; those of row i are bounds[i]:bounds[i + 1]."""
    solid = np.zeros(len(buf) + 2, bool)
    np.logical_not(SPACE[buf], out=solid[1:-1])
    first = solid[1:-1] & ~solid[:-2]
    last = solid[1:-1] & ~solid[2:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    first[inner] = solid[1:-1][inner]  # no word spans two rows
    last[inner - 1] = solid[1:-1][inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with ``fold``, A-Z count as a-z."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((BYTE_LOWER if fold else BYTE)[buf] * powers(BASE, len(buf)), out=total[1:])
    return mix((total[end] - total[start]) * powers(UNBASE, len(buf) + 1)[start])


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-word shingle, in order of the text.  A row of 1 to k-1 words has one
    shingle, its whole word sequence; a row without words has none."""
    count = np.diff(bounds)
    n = len(hashes)
    row_of = np.repeat(np.arange(len(count)), count)
    made = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        made += hashes[j : n - k + 1 + j] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) % (1 << 64)) if n >= k else 0
        made ^= made >> np.uint64(29)
        made *= np.uint64(0xBF58476D1CE4E5B9)
    full = row_of[: len(made)] == row_of[k - 1 :] if n >= k else np.zeros(0, bool)
    rows, out = row_of[: len(made)][full], mix(made[full])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            x = len(hashes[bounds[r] : bounds[r + 1]])
            for h in hashes[bounds[r] : bounds[r + 1]].tolist():
                x = ((x ^ h) * 0x9E3779B97F4A7C15 + 0x1656667B19E3779F) % (1 << 64)
                x ^= x >> 31
            extra[i] = x
        rows, out = np.concatenate([rows, short]), np.concatenate([out, mix(extra)])
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return rows, out


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle of each row, by row and then by hash."""
    start, end, bounds = words(buf, offs)
    rows, h = shingles(word_hashes(buf, start, end), bounds, k)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        rows, h = rows[new], h[new]
    return rows, h
