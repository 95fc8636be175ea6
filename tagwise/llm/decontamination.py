"""Benchmark decontamination by greedy string tiling.

Karp-Rabin hashes of every ``seed_words`` consecutive words of the whole documents are
joined with those of the benchmark items. Where seeds meet, common runs of words become
tiles: again and again the longest run of words that are unmarked on both sides is
marked, so that the tiles of a passage that was cut up and reordered all count. A
document leaks an item if its tiles cover enough of the item's words.

The item side of the join is bounded: items are held in blocks of about ``block_words``
words, each block is sent to the tasks once, and each is joined with all documents. No
text is shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import hash_words, row_slices, text_buffer, window_hashes

FILTER_BITS = 22


class Items:
    """One block of benchmark items: word hashes, and a sorted table of their seeds."""

    def __init__(self, ids: list, texts: list, seed_words: int):
        self.ids, self.k = ids, seed_words
        buf, offs = text_buffer(pa.array(texts, pa.string()))
        self.words, self.first = hash_words(buf, offs, lower=True)
        w = window_hashes(self.words, seed_words)
        row = np.searchsorted(self.first, np.arange(len(w)), "right") - 1
        at = np.flatnonzero(np.arange(len(w)) + seed_words <= self.first[row + 1]) if len(w) else np.zeros(0, np.int64)
        order = np.argsort(w[at], kind="stable")
        self.at, self.seeds = at[order], w[at][order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.seeds >> np.uint64(64 - FILTER_BITS)] = True

    def leaks(self, buf: np.ndarray, offs: np.ndarray, percent: int) -> Iterator[tuple[int, int, list[int]]]:
        """``(row, item, tile lengths)`` for every leak in the rows of a text buffer."""
        h, first = hash_words(buf, offs, lower=True)
        w = window_hashes(h, self.k)
        spots = np.flatnonzero(self.filter[w >> np.uint64(64 - FILTER_BITS)]) if len(self.seeds) else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.seeds, w[spots], "left"), np.searchsorted(self.seeds, w[spots], "right")
        spots, lo, n = spots[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        row = np.searchsorted(first, spots, "right") - 1
        inside = spots + self.k <= first[row + 1]
        spots, lo, n, row = spots[inside], lo[inside], n[inside], row[inside]
        if not len(spots):
            return
        doc = np.repeat(spots, n)
        item_at = self.at[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        item = np.searchsorted(self.first, item_at, "right") - 1
        row = np.repeat(row, n)
        order = np.lexsort((doc, doc - item_at, item, row))
        doc, item_at, item, row = doc[order], item_at[order], item[order], row[order]
        cuts = np.flatnonzero((row[1:] != row[:-1]) | (item[1:] != item[:-1])) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(row)), strict=True):
            r, i = int(row[a]), int(item[a])
            length = int(self.first[i + 1] - self.first[i])
            tiles = tile(doc[a:b], item_at[a:b], self.k, 100, percent, length)
            if 100 * sum(tiles) >= percent * length:
                yield r, i, tiles


def tile(doc: np.ndarray, item: np.ndarray, k: int, whole: int, percent: int, length: int) -> list[int]:
    """Lengths of the tiles of one document and item, from their common seeds sorted by
    diagonal and place. Seeds that cannot cover ``percent`` of the item give none."""
    reach = np.zeros(length + 1, np.int64)
    base = int(item.min())
    spots = np.unique(item - base)
    spots = spots[spots < length]
    reach[spots] += 1
    np.subtract.at(reach, np.minimum(spots + k, length), 1)
    if whole * int((np.cumsum(reach)[:length] > 0).sum()) < percent * length:
        return []
    run = np.flatnonzero((np.diff(doc - item) != 0) | (np.diff(doc) != 1)) + 1
    runs = [(-(int(doc[e - 1]) - int(doc[s]) + k), int(doc[s]), int(item[s])) for s, e in zip(np.append(0, run), np.append(run, len(doc)), strict=True)]
    heapq.heapify(runs)
    doc_marks, item_marks, tiles = set(), set(), []
    while runs:
        n, d, i = heapq.heappop(runs)
        free = [(d + j not in doc_marks) and (i + j not in item_marks) for j in range(-n)]
        if all(free):
            tiles.append(-n)
            doc_marks.update(range(d, d - n))
            item_marks.update(range(i, i - n))
            continue
        start = None
        for j, ok in enumerate([*free, False]):
            if ok and start is None:
                start = j
            elif not ok and start is not None:
                if j - start >= k:
                    heapq.heappush(runs, (start - j, d + start, i + start))
                start = None
    return tiles


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, seed_words: int, block_words: int) -> Iterator[Items]:
    """The items, a bounded block at a time."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / (6 * block_words)))
    for block in range(n):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == block).collect()
        yield Items([r.id for r in got], [r.text for r in got], seed_words)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", seed_words: int = 4, percent: int = 50, block_words: int = 2_000_000) -> DataFrame:
    """``(id, item_id, item_words, covered_words, n_tiles, longest_tile)``, a row for each
    document row and item whose tiles cover at least ``percent`` of the item's words.

    Words are lower-cased (A-Z) runs between white space. Null and empty texts leak
    nothing; items of fewer than ``seed_words`` words are too short to be found. Repeated
    items and rows each count. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"`{id_col}` {kind[0]}, `{item_id}` {kind[1]}, item_words int, covered_words int, n_tiles int, longest_tile int"
    spark, out = docs.sparkSession, None
    for block in item_blocks(benchmark, item_id, item_text, seed_words, block_words):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            items = shared.value
            for batch in batches:
                buf, offs = text_buffer(batch.column(1))
                for a, b in row_slices(offs):
                    found = list(items.leaks(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a], percent))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([a + r for r, _, _ in found])), pa.array([items.ids[i] for _, i, _ in found]),
                             *(pa.array(x, pa.int32()) for x in ([int(items.first[i + 1] - items.first[i]) for _, i, _ in found],
                                                                 [sum(t) for *_, t in found], [len(t) for *_, t in found], [max(t) for *_, t in found]))],
                            names=[id_col, item_id, "item_words", "covered_words", "n_tiles", "longest_tile"])

        part = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  seed_words: int = 4, percent: int = 50, block_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that leak no item (see ``find_leaks``)."""
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, item_id, item_text, seed_words, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            for batch in batches:
                buf, offs = text_buffer(batch.column(at))
                clean = np.ones(batch.num_rows, bool)
                for a, b in row_slices(offs):
                    for r, _, _ in shared.value.leaks(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a], percent):
                        clean[a + r] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
