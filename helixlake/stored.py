"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that open scopes have stored, the innermost scope last.
_scopes: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a session whose tasks all run in the driver's own process may do
    without: it gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-helixlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def store(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: this cuts the lineage, and what is computed once
    survives the loss of any executor. For what a plan would otherwise compute several times."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """At the end, deletes the tables that were stored within, but for those in the list that it gives. What is returned
    from within must be one of these: other results are read only when they are asked for, when their tables have gone."""
    kept: list[str] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        own = _scopes.pop()
        discard(spark, *[p for p in own if p not in kept])
        if _scopes:
            _scopes[-1].extend(p for p in own if p in kept)
