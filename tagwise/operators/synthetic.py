"""Merging synthetic-data CSV files into the posts schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as LF
from ..functions import text as TX
from ..sources import io

SYNTHETIC = T.StructType([T.StructField("content", T.StringType()), T.StructField("techniques", T.StringType())])


def compose(spark: SparkSession, pattern: str) -> DataFrame:
    """Read every file of the glob (one job), strip outer quotes, language from
    the file name corrected by the letters of the content, labels from the quoted
    tokens, every row manipulative with no triggers and a new id (a hash of file name and content,
    so that it is the same when a task runs again). A row whose
    content is not text is set aside on its own (quirk Q20), not its whole file."""
    raw = io.read_csv_files(spark, pattern, SYNTHETIC)
    file_lang = TX.language_from_filename(F.element_at(F.split("source_file", "/"), -1))
    content = TX.strip_quotes(F.col("content"))
    # "[]" is an empty list, not a label named "[]" (quirk Q10)
    labels = F.when(F.trim(F.col("techniques")) == "[]", F.array().cast("array<string>")) \
              .otherwise(LF.labels_quoted_or_single(F.col("techniques")))
    return raw.where(F.col("content").isNotNull()).select(
        F.md5(F.concat_ws(":", F.element_at(F.split("source_file", "/"), -1), F.col("content"))).alias("id"), content.alias("content"),
        TX.repaired_language(file_lang, content).alias("lang"), F.lit(True).alias("manipulative"),
        labels.alias("techniques"), F.array().cast("array<array<int>>").alias("trigger_words"),
        F.col("source_file"))


def as_csv_rows(df: DataFrame) -> DataFrame:
    """Labels as ``[a, b]`` text for the merged CSV."""
    return df.withColumn("techniques", LF.list_text(F.col("techniques")))


def label_counts(df: DataFrame) -> DataFrame:
    """Merged synthetic label counts, counted before stringifying (quirk Q10)."""
    return df.select(F.explode("techniques").alias("label")).groupBy("label") \
             .agg(F.count(F.lit(1)).cast("bigint").alias("count")).orderBy(F.desc("count"), "label")
