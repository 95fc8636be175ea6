"""MinHash near-duplicate components with odd sketches as the candidate check.

The distinct word shingles of a text are sampled by ``SAMPLES`` hash functions. The
samples serve twice: cut into bands they name the buckets in which texts meet, and
folded into a parity bitmap they give an odd sketch, whose XOR population count
estimates a high similarity from 64 bytes. A second, wider parity bitmap folds every
shingle: its XOR count never exceeds the number of shingles in which two texts differ,
so a count beyond what the threshold allows rules a pair out for certain. What the
sketches leave is confirmed on the full shingle sets of the whole texts.

Texts with one shingle set are one class from the start. Within a bucket, no pairs are
listed: in each turn a class is held against a few pivots of its buckets, classes that
join get one label, and a bucket counts again only while it holds several labels. When
the pivots close no more, the pairs of different labels that the wide sketch cannot rule
out are confirmed too, for each two labels the closest first: the pivots save work and
drop nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components, stored
from .words import hash_words, mix64, row_slices, seeds, signed, text_buffer, window_hashes

SAMPLES, ROWS, BITS, WIDE_BITS = 128, 4, 512, 2048
#: A pair at the threshold is ruled out by its sketch if the estimate is this many deviations low.
SIGMAS = 5.0
#: Pivots that a class is held against in one turn.
PIVOTS = 8


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int, lower: bool) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a shorter text is one shingle."""
    h, first = hash_words(buf, offs, lower)
    w, out = window_hashes(h, k), []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(w[a:b - k + 1]))
        else:
            out.append(window_hashes(h[a:b], int(b - a), salt=1 << 20) if b > a else np.zeros(0, np.uint64))
    return out


def sketch_limit(threshold: float) -> int:
    """Most differing bits that a pair at the threshold reaches, up to ``SIGMAS`` deviations."""
    low = 1 - threshold + SIGMAS * math.sqrt(threshold * (1 - threshold) / SAMPLES)
    flips = 2 * SAMPLES * min(low, 1.0)
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * flips / BITS)) + SIGMAS * math.sqrt(BITS) / 4)


_FEATURES = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()),
                          T.StructField("k2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
                          T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("wide", T.ArrayType(T.LongType()))])


def _featurise(batches: Iterator[pa.RecordBatch], k: int, lower: bool) -> Iterator[pa.RecordBatch]:
    mult, fold = seeds(SAMPLES, 5) | np.uint64(1), seeds(SAMPLES, 6)
    for batch in batches:
        buf, offs = text_buffer(batch.column(1))
        ids = batch.column(0)
        for a, b in row_slices(offs):
            sets = shingle_sets(buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a], k, lower)
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            keys = np.zeros((b - a, 2), np.uint64)
            bands = np.zeros((b - a, SAMPLES // ROWS), np.uint64)
            sketch, wide = np.zeros((b - a, BITS // 64), np.uint64), np.zeros((b - a, WIDE_BITS // 64), np.uint64)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                at = np.append(0, np.cumsum(n[full])[:-1])
                keys[full, 0], keys[full, 1] = np.add.reduceat(every, at), np.add.reduceat(mix64(every), at)
                row = np.repeat(np.arange(len(full)), n[full])
                odd = np.bincount(row * WIDE_BITS + (every >> np.uint64(20)).astype(np.int64) % WIDE_BITS, minlength=len(full) * WIDE_BITS) & 1
                wide[full] = np.packbits(odd.astype(bool).reshape(len(full), -1), axis=1).view(np.uint64)
                band = np.zeros(len(full), np.uint64)
                for i in range(SAMPLES):
                    low = np.minimum.reduceat(every * mult[i], at)
                    bit = mix64(low ^ fold[i])
                    sketch[full, (bit >> np.uint64(6)) % np.uint64(BITS // 64)] ^= np.uint64(1) << (bit & np.uint64(63))
                    band = mix64(band * np.uint64(31) + (low ^ fold[i]))
                    if i % ROWS == ROWS - 1:
                        bands[full, i // ROWS] = band
                        band = np.zeros(len(full), np.uint64)
            listed = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(signed(m.reshape(-1))))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(signed(keys[:, 0].copy())),
                                              pa.array(signed(keys[:, 1].copy())), listed(bands), listed(sketch), listed(wide)], names=_FEATURES.names)


def _confirmed(batches: Iterator[pa.RecordBatch], k: int, lower: bool, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lefts, rights = text_buffer(batch.column(2)), text_buffer(batch.column(3))
        ok = []
        for i in range(batch.num_rows):
            a, b = (shingle_sets(buf[o[i]:o[i + 1]], np.array([0, o[i + 1] - o[i]]), k, lower)[0] for buf, o in (lefts, rights))
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                ok.append(i)
        yield batch.select([0, 1]).take(pa.array(ok, pa.int64()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80, lower: bool = True) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Two texts are linked if 100 * intersection >= percent * union of their shingle sets;
    ``component_id`` is the smallest id reachable over links. Texts without words have no
    shingles and no links. A null text is an empty text. Rows that share an id are one
    document: its texts' links are united. A row without an id keeps a null component
    and is linked with nothing. Other columns of ``docs`` are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    features = stored(texts.mapInArrow(lambda it: _featurise(it, shingle_words, lower), _FEATURES), "features")
    groups = stored(features.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep")), "groups")
    reps = stored(features.where("n > 0").join(groups.withColumnRenamed("rep", "id"), ["id", "k1", "k2", "n"], "left_semi")
                  .dropDuplicates(["id", "k1", "k2"]).select("id", "n", "bands", "sketch", "wide"), "classes")

    exploded = reps.select(F.explode("bands").alias("key"), "id")
    shared = exploded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key")
    members = stored(exploded.join(shared, "key").withColumn("label", F.col("id")), "members")
    labels = stored(members.select("id", F.col("id").alias("label")).distinct(), "labels")
    confirm = _Confirm(texts, labels, reps, shingle_words, lower, percent)

    turn, open_before = 0, math.inf
    # Turns go on while they close a quarter of the open labels; the steps after them are complete in any case.
    while (still_open := members.agg(F.countDistinct("label")).first()[0]) and 4 * still_open <= 3 * open_before:
        open_before = still_open
        pivots = members.groupBy("key").agg(F.min_by(F.struct("id", "label"), F.xxhash64("id", F.lit(turn))).alias("p"))
        often = members.join(pivots, "key").where("label <> p.label").groupBy(F.col("id").alias("a"), F.col("p.id").alias("b")).agg(F.count("*").alias("c"))
        # A class lies in as many buckets as there are bands, so its window is as short.
        place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))
        found = confirm(often.withColumn("place", place).where(F.col("place") <= PIVOTS).select("a", "b"))
        if not found.limit(1).count():
            break
        labels = _joined(labels, found)
        members = _open_members(members, labels)
        turn += 1
    # What is left: pairs of different labels in one bucket that the wide sketches cannot rule out.
    side = members.join(reps.select("id", "n", "wide"), "id")
    a, b = (side.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "label", "wide")]) for s in "ab")
    gap = _differing("wide_a", "wide_b", WIDE_BITS) / (F.col("n_a") + F.col("n_b"))
    left = stored(a.join(b, "key").where((F.col("id_a") < F.col("id_b")) & (F.col("label_a") != F.col("label_b")) & _not_ruled_out(percent))
                  .select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), gap.alias("gap")).distinct(), "left")
    # For each two labels the closest pair first, while such pairs are links; then all the others.
    while True:
        for s in "ab":
            left = left.join(labels.select(F.col("id").alias(s), F.col("label").alias(f"label_{s}")), s)
        left = stored(left.where("label_a <> label_b"), "left")
        two = (F.least("label_a", "label_b"), F.greatest("label_a", "label_b"))
        closest = left.groupBy(*two).agg(F.min(F.struct("gap", "a", "b")).alias("m")).select("m.a", "m.b")
        found = confirm(closest, checked=True)
        left = left.select("a", "b", "gap").join(closest, ["a", "b"], "left_anti")
        if not found.limit(1).count():
            break
        labels = _joined(labels, found)
    found = confirm(left.select("a", "b"), checked=True)
    if found.limit(1).count():
        labels = _joined(labels, found)

    linked = (groups.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
              .select("k1", "k2", "n", F.coalesce("label", "rep").alias("component_id")))
    out = features.select("id", "n", "k1", "k2").join(linked, ["k1", "k2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (id, label)`` after the labels at the ends of the links have become one."""
    for s in "ab":
        links = links.join(labels.select(F.col("id").alias(s), F.col("label").alias(f"label_{s}")), s)
    merged = components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
    return stored(labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left")
                  .select("id", F.coalesce("new", "label").alias("label")), "labels")


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several labels, with their labels."""
    named = stored(members.select("key", "id").join(labels, "id"), "named")
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return stored(named.join(mixed, "key", "left_semi"), "members")


def _differing(a: str, b: str, bits: int):
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(bits // 64)), F.lit(0))


def _possible(percent: int):
    """The sizes and odd sketches (``n_a, sketch_a, n_b, sketch_b``) do not rule the pair out."""
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return sizes & (_differing("sketch_a", "sketch_b", BITS) <= sketch_limit(percent / 100))


def _not_ruled_out(percent: int):
    """Intersection over union of ``percent`` allows (100 - percent) / (100 + percent) of the sizes' sum to differ."""
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return sizes & ((100 + percent) * _differing("wide_a", "wide_b", WIDE_BITS) <= (100 - percent) * (F.col("n_a") + F.col("n_b")))


class _Confirm:
    """Keeps the pairs ``(a, b)`` that the sketches allow and the whole texts confirm."""

    def __init__(self, texts: DataFrame, labels: DataFrame, reps: DataFrame, k: int, lower: bool, percent: int):
        # The candidates grow with the documents, so they are not to be broadcast at any size.
        self.texts = stored(texts.join(labels.select("id").hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"]), "texts")
        self.reps, self.k, self.lower, self.percent = reps, k, lower, percent

    def __call__(self, pairs: DataFrame, checked: bool = False) -> DataFrame:
        k, lower, percent = self.k, self.lower, self.percent
        if not checked:
            for s in "ab":
                pairs = pairs.join(self.reps.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"),
                                                    F.col("wide").alias(f"wide_{s}")), s)
            pairs = pairs.where(_possible(percent) & _not_ruled_out(percent)).select("a", "b").distinct()
        for s in "ab":
            pairs = pairs.join(self.texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}")), s)
        ok = pairs.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _confirmed(it, k, lower, percent), "a long, b long")
        return stored(ok, "links")
