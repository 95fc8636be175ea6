"""Exact deduplication over an extendible-hash index in the shared folder (DataFrame operations only).

A normalised text is keyed by the 64 bits of ``xxhash64``. The directory starts with one
bucket and doubles as long as a bucket holds more than ``capacity`` different texts; a
bucket that fits keeps its depth, so deep splits are paid for only where keys are
dense. Buckets are ranges of the key's leading bits. Owner tasks write their ranges of
the index; texts of one key form a chain and are told apart by their bytes. A lookup
goes from the directory to the bucket and along the chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored

#: Directory cells are counted at this depth: 2 ** 16 rows bound the directory at any input size.
MAX_DEPTH = 16
#: Order of the rows of one text in one number: most code points, then smallest id, null last.
_RANK = ("CAST(2147483647 - points AS DECIMAL(10,0)) * CAST('100000000000000000000' AS DECIMAL(21,0))"
         " + coalesce(CAST(id AS DECIMAL(20,0)), 9300000000000000000) + 10000000000000000000")
_ID = "rank % CAST('100000000000000000000' AS DECIMAL(21,0)) - 10000000000000000000"


def without_space(text: Column) -> Column:
    """Delete every character of ``[\\x20\\x09-\\x0D]``; null becomes empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _cell(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH).cast("int")


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """``(cell, depth, bucket)``: the bucket that each occupied cell of the key space points
    to. ``keys`` has one ``key`` per different text. The depth of a cell is the smallest
    at which its bucket holds at most ``capacity`` keys; at ``MAX_DEPTH`` buckets may be
    larger and rely on their chains."""
    cells = keys.groupBy(_cell(F.col("key")).alias("cell")).agg(F.count("*").alias("n"))
    # One row for each cell and depth, summed by prefix: where doubling can stop.
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth"))
    prefix = F.expr(f"shiftright(cell, {MAX_DEPTH} - depth)")
    fits = levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("n").alias("n")).where((F.col("n") <= capacity) | (F.col("depth") == MAX_DEPTH))
    depth = (levels.select("cell", "depth", prefix.alias("prefix")).join(fits.select("depth", "prefix"), ["depth", "prefix"])
             .groupBy("cell").agg(F.min("depth").alias("depth")))
    return depth.select("cell", "depth", F.expr(f"shiftleft(shiftright(cell, {MAX_DEPTH} - depth), {MAX_DEPTH} - depth)").alias("bucket"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000) -> DataFrame:
    """The index, written to the shared folder and read back: ``(bucket, depth, key, link,
    sha256, keep_id, group_size)``, one row for each different normalised text. ``link`` is
    the place in the key's chain."""
    text = F.col(text_col).cast("string")
    norm = without_space(text)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.char_length(text), F.lit(0)).alias("points"), norm.alias("norm"))
    # Grouping by the text itself compares the bytes; copies are combined before the shuffle.
    texts = rows.groupBy(F.xxhash64("norm").alias("key"), "norm").agg(F.count("*").alias("group_size"), F.min(F.expr(_RANK)).alias("rank"))
    keep = F.expr(f"CASE WHEN {_ID} <= 9223372036854775807 THEN CAST({_ID} AS BIGINT) END")
    entries = stored(texts.select("key", F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha256"), keep.alias("keep_id"), "group_size"), "texts")
    cells = stored(directory(entries, capacity), "directory")
    placed = entries.withColumn("cell", _cell(F.col("key"))).join(F.broadcast(cells), "cell").drop("cell")
    chained = placed.groupBy("bucket", "depth", "key").agg(F.sort_array(F.collect_list(F.struct("sha256", "keep_id", "group_size"))).alias("chain"))
    links = chained.select("bucket", "depth", "key", F.posexplode("chain").alias("link", "entry")).select("bucket", "depth", "key", "link", "entry.*")
    return stored(links.repartitionByRange("bucket", "key"), "index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 100_000) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Texts are equal if they are once white space is deleted; null is an empty text. Of
    equal texts the row with the most code points stays, then the smallest id (null ids
    last). A row that repeats the staying row's id stays with it. Other columns are not read.
    """
    index = build_index(docs, id_col, text_col, capacity)
    norm = without_space(F.col(text_col))
    probes = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(norm).alias("key"), F.sha2(F.encode(norm, "UTF-8"), 256).alias("sha256"))
    found = probes.join(index.select("key", "sha256", "keep_id", "group_size"), ["key", "sha256"])
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.col("sha256").alias("text_sha256"))
