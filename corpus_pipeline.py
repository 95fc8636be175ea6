"""A corpus from raw documents: toxicity filter, near-duplicates, decontamination, mixing, shards.

Each stage works on all that its predecessor kept; its result is written as Parquet and
reread as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwise.llm.decontamination import without_leaks
from tagwise.llm.graph import stored
from tagwise.llm.near_dedup import near_duplicates
from tagwise.llm.queries import SHARDS, language_mix
from tagwise.llm.registry import table
from tagwise.llm.sharding import place
from tagwise.llm.toxicity import fit_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; the model is fitted on the labelled ones."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.score(F.col("text")) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component at five words and 0.8; a row that
    repeats this document is dropped too."""
    kept = near_duplicates(docs, shingle_words=5, percent=80).where("kept").select("doc_id").distinct()
    once = docs.join(kept.where("doc_id IS NOT NULL"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than half of every benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the language weights ask."""
    return language_mix(docs, sf_dir).resample(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard."""
    return place(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks),
          ("mixing", mix_languages), ("sharding", assign_shards)]

#: Learned models and tiling are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
