"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; local sessions that name none (tests) get one of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder all machines share.")
    if not base:
        base = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


@contextmanager
def _cleared_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries in this block leave no shuffle files; the session's setting is as before after it."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Write a table once and read it back, so that later steps neither repeat nor depend on its lineage.

    What was shuffled for it goes when it is written."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    with _cleared_shuffles(spark):
        df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def discard(table: DataFrame) -> None:
    """Delete the files of a stored table that no later step reads."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("llm-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
