"""A parquet store whose inserts are whole or absent.

Layout under the store's path: ``parts/<random>`` holds the files of one commit,
``manifest/<version>`` lists the parts of a version. A job writes its part, which no reader
sees, and publishes it by renaming one small manifest into place.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..session import path_exists
from . import io


def _hadoop(spark: SparkSession, path: str):
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = fs.Path(path)
    return fs, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> int:
    """The newest version, 0 for a store without commits."""
    _, p, files = _hadoop(spark, f"{path}/manifest")
    if not path_exists(spark, f"{path}/manifest"):
        return 0
    names = [f.getPath().getName() for f in files.listStatus(p)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def _parts(spark: SparkSession, path: str, version: int) -> list[str]:
    """One short line per commit."""
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest/{version:09d}", wholetext=True).collect())) if version else []


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default; of a store without commits, none."""
    parts = _parts(spark, path, latest(spark, path) if version is None else version)
    return spark.read.schema(schema).parquet(*[f"{path}/parts/{x}" for x in parts]) if parts else spark.createDataFrame([], schema)


def _publish(spark: SparkSession, path: str, version: int, parts: list[str]) -> bool:
    """Rename the manifest into place; False if the version is there already."""
    fs, to, files = _hadoop(spark, f"{path}/manifest/{version:09d}")
    draft = fs.Path(f"{path}/manifest/_{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    gateway, rename = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(to), options)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        files.delete(draft, False)
        return False


def append(spark: SparkSession, path: str, rows: DataFrame, base: int) -> int | None:
    """Commit ``rows`` on top of version ``base``. Returns the new version, or None if another
    commit took it (the store then has that commit, and nothing of ``rows``)."""
    part = uuid.uuid4().hex
    rows.write.parquet(f"{path}/parts/{part}")
    return base + 1 if _publish(spark, path, base + 1, _parts(spark, path, base) + [part]) else None


def insert(spark: SparkSession, path: str, docs: DataFrame, schema: str, arrival: str | None = None) -> int:
    """One commit of the documents whose id the store lacks, the first row of an id (by
    ``arrival``, which is not stored). Worked out again on the newer version if another commit
    came first, so no id is there twice, whoever else inserts and however often a job is rerun."""
    first = io.first_by_id(docs, arrival)
    names = spark.createDataFrame([], schema).columns
    while True:
        base = latest(spark, path)
        fresh = io.anti_join_big(first, read(spark, path, schema, base).select("id"))
        version = append(spark, path, fresh.select(*names), base)
        if version:
            return version
