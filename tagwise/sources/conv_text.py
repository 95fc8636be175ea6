"""Views over ``conversations`` and ``events`` used as model-output text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables


def assistant_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns of the conversations (the model's replies)."""
    c = tables.conversations(spark, sf_dir)
    return c.where(F.col("role") == "assistant").select("conv_id", "turn", "text")


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed model-output log: event payloads (JSON text) and assistant replies (free
    text), keyed by a string id."""
    ev = tables.read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"), F.col("props").alias("payload"))
    tx = assistant_turns(spark, sf_dir).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
        .alias("event_id"), F.col("text").alias("payload"))
    return ev.unionByName(tx)
