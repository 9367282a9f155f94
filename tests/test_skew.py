"""Skew-safe joins and ranks give the plain results, with one key holding most rows."""

from pyspark.sql import Window, functions as F

from casebook.functions.skew import key_counts, rank_within, salted_join
from casebook.operators import retrieve as rt
from casebook.plans.evidence_queries import _targets
from casebook.sources.bindings import Bindings
from tests.conftest import SMALL


def _skewed(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(7).alias("k"), F.col("id").alias("row_id")
    )


def test_salted_join_equals_plain_join(spark):
    big = _skewed(spark)
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    plain = big.join(small, "k").select("k", "row_id", "x")
    salted = salted_join(big, small, ["k"], "row_id", key_counts(big, ["k"]), rows_per_salt=100).select("k", "row_id", "x")
    assert sorted(plain.collect()) == sorted(salted.collect())


def test_salted_join_splits_the_hot_key(spark):
    big = _skewed(spark)
    small = spark.range(40).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if neither side were small
    try:
        joined = salted_join(big, small, ["k"], "row_id", key_counts(big, ["k"]), rows_per_salt=100)
        tasks = joined.where("k = 7").withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tasks > 4


def test_both_sides_of_a_hot_key_are_split(spark):
    big = _skewed(spark)
    small = spark.range(600).select(F.when(F.col("id") < 500, 7).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("query_id"))
    plain = big.join(small, "k").select("k", "row_id", "query_id")
    joined = salted_join(big, small, ["k"], "row_id", key_counts(big, ["k"]), rows_per_salt=10_000).select("k", "row_id", "query_id")
    assert sorted(plain.collect()) == sorted(joined.collect())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if neither side were small
    try:
        tasks = joined.where("k = 7 and row_id = 4").select(F.spark_partition_id()).distinct().count()
        assert tasks > 1  # one row meets its inquiries in several tasks
        assert joined.where("k = 7 and query_id = 4").select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rank_within_equals_window_rank(spark):
    rows = _skewed(spark).withColumn("v", F.pmod(F.xxhash64("row_id"), F.lit(500)))
    order = [F.col("v").desc(), F.col("row_id").asc()]
    keys = ["k", "row_id", "place"]
    ranked = [r for limit in (10**6, 100) for r in rank_within(rows, ["k"], order, "place", limit).select(*keys).collect()]
    plain = rows.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long")).select(
        "k", "row_id", "place"
    )
    assert sorted(ranked) == sorted(2 * plain.collect())


def test_retrieval_is_the_same_with_split_tenants(spark):
    t = Bindings(spark, SMALL)
    targets = _targets(t)
    args = (targets, t.document_chunks, t.medical_documents, t.document_extractions)
    keys = ["query_id", "ord", "chunk_id"]
    whole = rt.retrieve(*args).select(*keys).collect()
    split = rt.retrieve(*args, rows_per_salt=3).select(*keys).collect()
    assert whole and sorted(whole) == sorted(split)


def test_top_k_cuts_before_the_shuffle(spark):
    t = Bindings(spark, SMALL)
    asked = rt.document_questions(_targets(t))
    searchable = rt.searchable_chunks(t.document_chunks, t.medical_documents, t.document_extractions)
    counts = key_counts(t.document_chunks, ["patient_id"])
    plan = rt.dense_candidates(asked, searchable, rt.extremum_dates(asked, t.medical_documents), counts, 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text
