"""Substring deduplication by relative Lempel-Ziv factors over blocks of all documents.

Every document is both a reference and a text to parse. Its windows of ``length`` words
fall into blocks: runs of consecutive windows that have their smallest ``SEED``-word
hash at the same place, so that equal windows always lie under equal seeds, whatever
surrounds them. Parsing one document against all earlier ones then takes three steps:

1. seeds that occur once in all documents end every match; only blocks under repeated
   seeds are looked up;
2. a block whose whole word sequence has an earlier occurrence continues a factor and is
   covered as a whole;
3. at a factor's boundary (the first block of its content, under a seed that also has
   other contents) the single windows are compared.

Factors of at least ``length`` words are the union of covered windows. All comparisons
are by 64-bit hashes of the whole window, made from the words' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored
from .words import hash_words, mix64, row_slices, signed, text_buffer, window_hashes

SEED = 6
_AT = np.uint64(28)


def _blocks(h: np.ndarray, first: np.ndarray, length: int):
    """Starts, window counts and seed hashes of the blocks, with the windows' hashes."""
    seed_words = min(SEED, length)
    w, g = window_hashes(h, length), window_hashes(h, seed_words, salt=9)
    n = len(w)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g, w
    packed = (g >> _AT << _AT) | np.arange(len(g), dtype=np.uint64)
    low, reach, span = packed, 1, length - seed_words + 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[:len(low) - (span - reach)], low[span - reach:])
    at = (low[:n] & np.uint64((1 << 28) - 1)).astype(np.int64)
    inside = np.zeros(len(h) + 1, np.int64)
    ends = first[1:]
    valid = np.zeros(n, bool)
    np.add.at(inside, first[:-1], 1)
    np.add.at(inside, np.maximum(ends - length + 1, first[:-1]), -1)
    valid = np.cumsum(inside)[:n] > 0
    change = np.ones(n, bool)
    change[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    row_starts = first[:-1]
    change[row_starts[row_starts < n]] = True
    starts = np.flatnonzero(change & valid)
    stops = np.append(np.flatnonzero(change), n)
    stops = stops[np.searchsorted(stops, starts, "right")]
    # a block also ends where the document's windows end
    last = np.searchsorted(first, starts, "right")
    stops = np.minimum(stops, first[last] - length + 1)
    return starts, stops - starts, g[at[starts]], w


def _emit_blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        for a, b in row_slices(offs):
            h, first = hash_words(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a])
            starts, counts, seed, w = _blocks(h, first, length)
            row = np.searchsorted(first, starts, "right") - 1
            whole = mix64(w[starts] * np.uint64(0x9E3779B97F4A7C15) + w[starts + counts - 1] * np.uint64(3) + counts.astype(np.uint64)) if len(starts) else seed
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(x))) for x in (seed, whole)]
                                             + [pa.array(ids[a:b][row]), pa.array((starts - first[row]).astype(np.int32)), pa.array(counts.astype(np.int32))],
                                             names=["seed", "block", "id", "at", "windows"])


def _emit_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        ids, blocks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for i in range(batch.num_rows):
            h, _ = hash_words(buf[offs[i]:offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))
            w = window_hashes(h, length)
            at = np.concatenate([np.arange(x["at"], x["at"] + x["windows"]) for x in blocks[i]])
            at = at[at < len(w)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(w[at])), pa.array(np.full(len(at), ids[i])), pa.array(at.astype(np.int32))],
                                             names=["window", "id", "at"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, digest, kept_text = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = (text.as_py() or "").encode().split()
            kept = words
            if spans:
                keep = np.ones(len(words), bool)
                for x in spans:
                    keep[x["at"]:x["stop"]] = False
                kept = list(compress(words, keep))
            out = b" ".join(kept)
            total.append(len(words))
            removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(out).hexdigest())
            kept_text.append(out.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array(digest, pa.string()), pa.array(kept_text, pa.string())],
                                         names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20) -> DataFrame:
    """``(id, spans)``: the word ranges ``[at, stop)`` of each document that are covered by
    windows of ``length`` words whose sequence also starts earlier, in a smaller id or
    before in the same document. Documents without any are left out. Rows without an id
    take no part; rows that repeat an id count as one document at the same places."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    blocks = texts.mapInArrow(lambda it: _emit_blocks(it, length), "seed long, block long, id long, at int, windows int")
    # The counted keys are written before they are joined, so that Spark can split a hot seed's side of the join.
    repeated = stored(blocks.select("seed").groupBy("seed").agg(F.count("*").alias("c")).where("c > 1").select("seed"), "seeds")
    hits = stored(blocks.join(repeated, "seed"), "hits")

    firsts = stored(hits.groupBy("seed", "block").agg(F.min(F.struct("id", "at", "windows")).alias("f"), F.count("*").alias("c")), "firsts")
    whole = (hits.join(firsts.where("c > 1").select("block", "seed", "f"), ["block", "seed"])
             .where("id > f.id OR (id = f.id AND at > f.at)").select("id", "at", F.expr(f"at + windows + {length - 1}").alias("stop")))

    several = stored(firsts.groupBy("seed").agg(F.count("*").alias("k")).where("k > 1").select("seed"), "several")
    bounds = firsts.join(several, "seed").groupBy("f.id").agg(F.collect_list(F.struct("f.at", "f.windows")).alias("blocks"))
    windows = stored(texts.join(bounds, "id").select("id", "text", "blocks")
                     .mapInArrow(lambda it: _emit_windows(it, length), "window long, id long, at int"), "windows")
    earliest = stored(windows.groupBy("window").agg(F.min(F.struct("id", "at")).alias("f"), F.count("*").alias("c")).where("c > 1").select("window", "f"), "earliest")
    single = (windows.join(earliest, "window").where("id > f.id OR (id = f.id AND at > f.at)")
              .select("id", "at", F.expr(f"at + {length}").alias("stop")))
    return whole.unionByName(single).groupBy("id").agg(F.collect_list(F.struct("at", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256, kept_text)`` for every row of ``docs``: the
    words left when every duplicate span is cut, joined by one space. A null or empty text
    has no words. Other columns of ``docs`` are not read."""
    spans = duplicate_spans(docs, id_col, text_col, length)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return (texts.join(spans, "id", "left").select("id", "text", "spans")
            .mapInArrow(_cut, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
            .withColumnRenamed("id", id_col))
