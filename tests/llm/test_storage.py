"""Tables written between steps leave neither shuffle files nor, once read for the last time, themselves."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casebook.llm import near, prefix_free, simhash, storage
from tests.llm.samples import documents, texts


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_") and name.endswith(".data")}


def test_shuffles_of_a_stored_table_go_and_the_setting_stays(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(storage.CLEANUP)
    counts = spark.range(1000).repartition(5).groupBy((F.col("id") % 10).alias("k")).count()
    table = storage.stored(counts)
    for _ in range(20):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(storage.CLEANUP) == setting
    assert sorted(table.collect()) == sorted(counts.collect())


def _folders(tables):
    return {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}


@pytest.mark.parametrize(
    "module, job, stays",
    [
        (prefix_free, prefix_free.remove_repeats, 1),  # the marks
        (simhash, lambda docs: simhash.clustered(docs.select("doc_id", "text")), 2),  # fingerprints, roots
        (near, lambda docs: near.clustered(docs.select("doc_id", "text")), None),
    ],
)
def test_tables_no_later_step_reads_go(spark, monkeypatch, module, job, stays):
    written = []

    def store(df):
        table = storage.stored(df)
        written.append(_folders([table]))
        return table

    monkeypatch.setattr(module, "stored", store)
    result = job(documents(spark, texts()))
    left = [of for of in written if all(Path(folder.removeprefix("file:")).exists() for folder in of)]
    needed = _folders([result])
    assert len(left) < len(written) and (stays is None or len(left) == stays)
    assert needed <= set().union(*left)
    assert result.count() > 0
