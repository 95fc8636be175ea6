"""Connected components by distributed minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwise.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: the lineage is
    cut, and a lost executor costs only the task it was running."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges (a, b)``; the label is the smallest node
    reachable. Null ends are ignored. Each turn takes the smallest label among the
    neighbours (pre-aggregated, so a hub costs one row per task) and then jumps to the
    label's own label, so that a path of n nodes needs about log n turns."""
    both = stored(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
                                                             .where("a <> b")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("m")))
        hooked = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = stored(hooked.join(up, "label").select("node", "old", F.col("higher").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("old <> label").limit(1).count():
            return labels
