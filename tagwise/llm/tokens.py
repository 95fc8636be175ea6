"""Words and terms of texts as UTF-8 bytes, counted within a task.

Only A-Z are lower-cased, and every byte of a character beyond ASCII is 0x80 or more, so
both can be read from the bytes: a table of 256 bytes lower-cases them and makes every
separator a space. Counting works on the column's buffer, without a Python object a word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import PIECE, row_slices, text_buffer

#: Words end at space and 0x09-0x0D.
WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
#: Terms are runs of letters: every ASCII byte that is none separates.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split(text: bytes | None, table: bytes) -> Iterator[list[bytes]]:
    """The words of one text of any length, one list for each piece of a megabyte."""
    rest, end = b"", len(text or b"")
    for at in range(0, end, PIECE):
        piece = rest + text[at:at + PIECE].translate(table)
        words = piece.split(b" ")
        # a word at the end of a piece may go on in the next one
        rest = words.pop() if at + PIECE < end else b""
        yield [w for w in words if w]


def row_words(column: pa.Array, table: bytes) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """``(rows, words, counts)`` for stretches of the rows, one entry for each row and word."""
    buf, offs = text_buffer(column)
    bytes_of = np.frombuffer(table, np.uint8)
    for a, b in row_slices(offs):
        if offs[b] - offs[a] > 2 * PIECE:                      # one long text
            held = Counter()
            for words in split(buf[offs[a]:offs[b]].tobytes(), table):
                held.update(words)
            yield np.full(len(held), a), pa.array(list(held), pa.binary()), np.fromiter(held.values(), np.int64, len(held))
            continue
        text, edges = bytes_of[buf[offs[a]:offs[b]]], offs[a:b + 1] - offs[a]
        inside = text != 32
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        rows = edges[:-1][edges[:-1] < len(text)]
        first[rows] = inside[rows]                             # texts touch in the buffer
        at = np.flatnonzero(first)
        if len(at) == 0:
            continue
        ends = np.append((np.cumsum(inside)[at] - 1).astype(np.int32), np.int32(inside.sum()))
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(text[inside])]).dictionary_encode()
        many = len(words.dictionary)
        key, n = np.unique((np.searchsorted(edges, at, "right") - 1) * many + words.indices.to_numpy(), return_counts=True)
        yield a + key // many, words.dictionary.take(pa.array(key % many)), n


class Sums:
    """Rows summed by some of their columns. Three times ``most`` rows are held before they are
    summed; sums that are still more than ``most`` are given out."""

    def __init__(self, keys: list[str], sums: list[str], most: int):
        self.keys, self.sums, self.most, self.held, self.rows = keys, sums, most, [], 0

    def add(self, table: pa.Table) -> Iterator[pa.Table]:
        self.held.append(table)
        self.rows += len(table)
        if self.rows > 3 * self.most:
            self._combine()
            if self.rows > self.most:
                yield from self.take()

    def _combine(self) -> None:
        table = pa.concat_tables(self.held).group_by(self.keys, use_threads=False).aggregate([(s, "sum") for s in self.sums])
        table = table.select([*self.keys, *[f"{s}_sum" for s in self.sums]]).rename_columns([*self.keys, *self.sums])
        self.held, self.rows = [table], len(table)

    def take(self) -> Iterator[pa.Table]:
        if self.rows:
            self._combine()
            yield from self.held
        self.held, self.rows = [], 0
