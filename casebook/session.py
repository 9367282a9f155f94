"""Session helpers: settings every job needs and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on (UTC clock) and let AQE re-plan at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the session names; local sessions that name none, as in tests, get their own.

    The application's part of it is removed when its JVM ends."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if not current:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all machines share.")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="run-"))
        current = context.getCheckpointDir()
        path = spark._jvm.org.apache.hadoop.fs.Path(current)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return current


def materialise(df: DataFrame) -> DataFrame:
    """Write a relation several branches read, so no branch repeats its lineage; its partitions stay as they are."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out rows that are few but costly to work on; the fixed count keeps AQE from merging them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)
