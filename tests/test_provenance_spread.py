"""Writes without a source document don't meet in one task."""

import pytest
from pyspark.sql import functions as F

from casebook.operators import quality as ql


@pytest.fixture
def joined_by_sort(spark):
    """Plans as for tables too large to broadcast, decided before the run."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in old.items():
        spark.conf.set(name, value)


def test_writes_without_a_source_are_dealt_out(spark, joined_by_sort):
    changes = spark.range(4000).selectExpr(
        "id AS record_id", "id % 7 AS patient_id", "true AS is_create", "false AS has_source_type", "false AS has_source_id",
        "CAST(NULL AS STRING) AS source_type", "IF(id = 5, 1L, NULL) AS source_id", "'PATIENT_REPORTED' AS old_source_type",
        "CAST(NULL AS BIGINT) AS old_source_id", "CAST(NULL AS STRING) AS sent_verification_state")
    documents = spark.createDataFrame([(1, 5), (None, 5)], "id long, patient_id long")
    resolved = ql.resolve_provenance(changes, documents).withColumn("at", F.spark_partition_id())
    sizes = [r["count"] for r in resolved.groupBy("at").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000
    assert resolved.where("violation IS NULL").count() == 3999
