"""Inserts into the store are whole or absent, and never twice."""

import pytest
from pyspark.sql import functions as F

from tagwise.session import scratch_path
from tagwise.sources import store as ST

SCHEMA = "id string, n bigint"


def ids(spark, path, version=None):
    return sorted(r.id for r in ST.read(spark, path, SCHEMA, version).collect())


def rows(spark, *data):
    return spark.createDataFrame(data, SCHEMA + ", at int").repartition(4)


def test_insert_rerun_versions_and_order(spark):
    path = scratch_path(spark, "teststore")
    assert ST.latest(spark, path) == 0 and ids(spark, path) == []
    assert ST.insert(spark, path, rows(spark, ("a", 1, 2), ("a", 2, 1), ("b", 3, None)), SCHEMA, arrival="at") == 1
    assert ST.insert(spark, path, rows(spark, ("a", 9, 1), ("b", 9, 1), ("c", 4, 1)), SCHEMA, arrival="at") == 2
    assert ST.insert(spark, path, rows(spark, ("a", 9, 1), ("c", 9, 1)), SCHEMA, arrival="at") == 3      # nothing new
    assert {tuple(r) for r in ST.read(spark, path, SCHEMA).collect()} == {("a", 2), ("b", 3), ("c", 4)}
    assert ids(spark, path, 1) == ["a", "b"] and ids(spark, path, 0) == []


def test_failed_task_leaves_the_store_as_it_was(spark):
    path = scratch_path(spark, "teststore")
    ST.insert(spark, path, rows(spark, ("a", 1, 1)), SCHEMA, arrival="at")
    bad = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 35, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("bigint").alias("n"))
    with pytest.raises(Exception, match="lost"):
        ST.append(spark, path, bad, 1)
    assert ST.latest(spark, path) == 1 and ids(spark, path) == ["a"]
    assert ST.insert(spark, path, rows(spark, ("b", 1, 1)), SCHEMA, arrival="at") == 2 and ids(spark, path) == ["a", "b"]


def test_later_commit_of_a_version_is_refused_and_worked_out_again(spark, monkeypatch):
    path, seen = scratch_path(spark, "teststore"), []
    ST.insert(spark, path, rows(spark, ("a", 1, 1)), SCHEMA, arrival="at")
    assert ST.append(spark, path, rows(spark, ("x", 1, 1)).drop("at"), 0) is None and ids(spark, path) == ["a"]
    publish = ST._publish

    def other_first(s, p, version, parts):
        if not seen:
            seen.append(version)
            assert ST.append(s, p, rows(s, ("b", 7, 1)).drop("at"), 1) == 2                  # another job's commit
        return publish(s, p, version, parts)
    monkeypatch.setattr(ST, "_publish", other_first)
    assert ST.insert(spark, path, rows(spark, ("b", 1, 1), ("c", 1, 1)), SCHEMA, arrival="at") == 3
    assert {tuple(r) for r in ST.read(spark, path, SCHEMA).collect()} == {("a", 1), ("b", 7), ("c", 1)}
