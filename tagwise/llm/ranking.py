"""Exact places of rows in an order, without one task seeing a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored

#: Copies of a group's row that a join spreads over; a group never has more than it has rows.
SALTS = 1024


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``at``, the row's place from 0 within its group, and ``n``, the group's rows.

    The rows are sorted by range over all tasks (a large group spans many of them); each task's
    count per group gives the first place there. Rows that tie in ``order`` are numbered in an
    unspecified order, and are dealt apart by the place where they were read. Nulls come first
    and form a group. Written to the shared folder, so a lost task never sees another cut."""
    by = [F.asc_nulls_first(c) for c in dict.fromkeys([group, *order])]
    rows = stored(df.withColumn("_seen", F.monotonically_increasing_id()), "unsorted")
    rows = stored(rows.repartitionByRange(*by, "_seen").sortWithinPartitions(*by, "_seen").withColumn("_id", F.monotonically_increasing_id())
                  .withColumn("_part", F.shiftright("_id", 33)).drop("_seen"), "sorted")
    runs = rows.groupBy("_part", F.col(group).alias("_group")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("_group")
    runs = runs.select("_part", "_group", "_first", (F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")).alias("_before"),
                       F.sum("_rows").over(whole).alias("n"))
    runs = runs.withColumnRenamed("_part", "_p")
    at = (F.col("_before") + F.col("_id") - F.col("_first")).alias("at")
    return rows.join(runs, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group"))).select(*df.columns, at, "n")
