"""Reproducible splits and samples from a stable per-row hash.

A row's bucket is ``md5(id || ':' || seed)`` read as a number, so a split is a
narrow projection: no shuffle, same answer for any partitioning or re-run, and
disjoint and complete by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_u32, seeded_bucket


def hash_split(df: DataFrame, cuts: list[tuple[str, int]], seed: int = 42, id_col: str = "id",
               last: str = "test") -> DataFrame:
    """Assign ``split`` by bucket (0..99): the first cut whose bound the
    bucket is below, else ``last``. E.g. [("train", 80)] is 80/20."""
    b = seeded_bucket(F.col(id_col), seed)
    expr = None
    for name, bound in cuts:
        expr = (F.when(b < bound, F.lit(name)) if expr is None else expr.when(b < bound, F.lit(name)))
    expr = expr.otherwise(F.lit(last)) if expr is not None else F.lit(last)
    return df.withColumn("split", expr)


def split_80_20(df: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    return hash_split(df, [("train", 80)], seed, id_col)


def split_60_20_20(df: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    """R2: 20% test first, then 25% of the rest as validation -> 60/20/20."""
    return hash_split(df, [("train", 60), ("val", 80)], seed, id_col)


def split_90_10(df: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    return hash_split(df, [("train", 90)], seed, id_col, last="val")


def _h(id_col: str, seed: int) -> Column:
    return md5_u32(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def stratified_split(df: DataFrame, stratum: str, test_fraction: float = 0.2, seed: int = 42,
                     id_col: str = "id") -> DataFrame:
    """Exactly ceil(test_fraction * n_s) rows of each stratum s go to 'test':
    those with the smallest (hash, id).

    No window or group spans a whole stratum (one stratum may hold most rows).
    Level 1 counts rows per (stratum, top 16 hash bits) -- at most 65,536 cells per
    stratum -- and finds the cell holding the cut. Level 2 groups only that cell's
    rows by exact hash (ids of one hash value are a handful of collisions) and finds
    the cut as a (hash, id) pair. Every row is then compared with its stratum's pair.
    """
    base = df.withColumn("_h", _h(id_col, seed))
    keys = base.select(stratum, "_h", F.col(id_col).cast("string").alias("_id"),
                       F.shiftright(F.col("_h"), 16).alias("_b"))
    cells = keys.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w_run = Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select(stratum, "_b", "_c", F.sum("_c").over(w_run).alias("_cum"),
                         F.sum("_c").over(Window.partitionBy(stratum)).alias("_n"))
    cells = cells.withColumn("_k", F.ceil(F.col("_n") * F.lit(test_fraction)).cast("bigint"))
    cut1 = (cells.where((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_c") < F.col("_k")))
                 .select(stratum, F.col("_b").alias("_cb"), (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_r")))
    in_cell = keys.join(F.broadcast(cut1), stratum).where(F.col("_b") == F.col("_cb"))
    per_hash = in_cell.groupBy(stratum, "_h", "_r").agg(
        F.count(F.lit(1)).alias("_c"), F.array_sort(F.collect_list("_id")).alias("_ids"))
    w2 = Window.partitionBy(stratum).orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    per_hash = per_hash.withColumn("_cum", F.sum("_c").over(w2))
    cut = (per_hash.where((F.col("_cum") >= F.col("_r")) & (F.col("_cum") - F.col("_c") < F.col("_r")))
                   .select(stratum, F.col("_h").alias("_ch"),
                           F.element_at("_ids", (F.col("_r") - (F.col("_cum") - F.col("_c"))).cast("int"))
                           .alias("_cid")))
    j = base.join(F.broadcast(cut), stratum, "left")                # one row per stratum
    rid = F.col(id_col).cast("string")
    is_test = (F.col("_h") < F.col("_ch")) | ((F.col("_h") == F.col("_ch")) & (rid <= F.col("_cid")))
    out = j.withColumn("split", F.when(F.coalesce(is_test, F.lit(False)), "test").otherwise("train"))
    return out.drop("_h", "_ch", "_cid")


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Exactly n rows (or all if fewer), the n smallest (hash, id). Each task
    keeps its own top n before the merge (TakeOrderedAndProject)."""
    return df.withColumn("_h", _h(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows and fraction per split (a handful of groups)."""
    g = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy())
    return g.select(F.col(split_col).alias("split"), F.col("n").cast("bigint").alias("n"),
                    F.round(F.col("n") / tot, 6).alias("fraction"))


def labels_long_form(df: DataFrame, labels: list[str], labels_col: str = "techniques",
                     keep: list[str] | None = None) -> DataFrame:
    """One row per (row, class) with the class index as a feature and its 0/1 target."""
    keep = keep or ["id"]
    arr = F.coalesce(F.col(labels_col), F.array().cast("array<string>"))
    pairs = F.array(*[F.struct(F.lit(i).alias("label_index"), F.lit(lbl).alias("label"),
                               F.array_contains(arr, lbl).cast("int").alias("y"))
                      for i, lbl in enumerate(labels)])
    return df.select(*keep, F.explode(pairs).alias("e")).select(*keep, "e.label_index", "e.label", "e.y")
