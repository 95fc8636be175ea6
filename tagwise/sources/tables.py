"""Base table scans.

Each scan is a plain ``spark.read.parquet``; callers select the columns they use so
Catalyst prunes the parquet read, and filters placed after the scan are pushed into
it. No schema inference happens for the fixture tables beyond parquet's own footer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import SCAN_PARTITIONS

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {TABLES}")
    return spark.read.parquet(table_path(sf_dir, name))


TEXT_TABLES = ("documents", "conversations", "pages")


def spread(df: DataFrame) -> DataFrame:
    """Deal a text scan to the number of partitions that the session asks for, whatever the
    size of the input. The local session does, as a test table is one row group and
    its text work would run in one task; a cluster's session does not."""
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "conversations"))
