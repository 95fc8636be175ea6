"""Vectorised word hashing over Arrow text columns (runs inside tasks).

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. The helpers read the
column's UTF-8 buffer directly, so no Python string is made for a word; a text of any
length is walked in pieces cut at white space, with eight bytes kept for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def _letters(lower: bool) -> np.ndarray:
    t = seeds(256, 77)
    t[_SPACE] = 0
    if lower:
        t[65:91] = t[97:123]
    return t


_TABLES = {False: _letters(False), True: _letters(True)}


def _keys(n: int) -> np.ndarray:
    """An odd key for each place in a word. Powers of one radix would let patterned words collide
    (a Thue-Morse word and its complement cancel out modulo 2^64); unrelated keys do not."""
    return seeds(max(n, 1), 178) | np.uint64(1)


_KEYS = _keys(1 << 12)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the row offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def row_slices(offs: np.ndarray, most: int = PIECE, rows: int = 2048) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (a longer row stands alone) and ``rows`` rows."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = min(n, a + rows, max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1))
        yield a, b
        a = b


def hash_words(buf: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and for each row the index of its first word (with the end)."""
    table, hashes, starts = _TABLES[lower], [], []
    a, n = 0, len(buf)
    while a < n:
        b = min(n, a + PIECE)
        while b < n and not _SPACE[buf[b]]:
            free = np.flatnonzero(_SPACE[buf[b:b + 4096]])
            b = b + int(free[0]) if len(free) else min(n, b + 4096)
        p = buf[a:b]
        space = _SPACE[p]
        first = ~space
        first[1:] &= space[:-1]
        inner = offs[np.searchsorted(offs, a):np.searchsorted(offs, b)] - a
        first[inner] = ~space[inner]
        s = np.flatnonzero(first)
        if len(s):
            gaps = np.diff(np.append(s, len(p)))
            pos = np.arange(s[0], len(p)) - np.repeat(s, gaps)
            longest = int(gaps.max())
            keys = _KEYS if longest <= len(_KEYS) else _keys(longest)
            hashes.append(mix64(np.add.reduceat(table[p[s[0]:]] * keys[pos], s - s[0])))
            starts.append(s + a)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offs)


def window_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``k`` words from each position; the last ``k - 1`` positions are left out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, np.uint64(2 * (k + salt) + 1))
    for j in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[j:j + n]
    return mix64(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
