"""Inquiries at scale: no hot question, no vector where none is read, no question of a tenant without chunks."""

from pyspark.sql import functions as F

from casebook.functions import text as tx
from casebook.operators import retrieve as rt
from casebook.operators import understand as un
from casebook.operators.answer import gate
from casebook.sources.bindings import Bindings


def _asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, patient_id long, query_text string, ref_date date")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_question_many_ask_is_no_hot_key(spark):
    import datetime

    day = datetime.date(2026, 9, 24)
    rows = [(k, k % 7, "Tell me the dosage of my Metformin" if k % 3 else None if k % 2 else f"Question {k}", day if k % 5 else None) for k in range(60)]
    inquiries = _asked(spark, rows)
    got = gate(inquiries)
    plan = _plan(got)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning(_key" not in plan
    alone = un.annotate(inquiries.where("query_text IS NOT NULL")).drop("safety_triggered")
    columns = ["query_id", *un.TARGET_COLUMNS]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, alone.select(*columns).collect()))
    shuffled = un.once_each(inquiries.where("query_text IS NOT NULL"), un.annotate, listed=1)
    assert sorted(map(str, shuffled.select(*columns).collect())) == sorted(map(str, alone.select(*columns).collect()))


def _tables(spark, folder, vectors):
    spark.range(1, 4).selectExpr("id AS c_custkey").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return Bindings(spark, str(folder)).inquiries


def test_vectors_are_not_joined_where_none_is_read(spark, tmp_path):
    inquiries = _tables(spark, tmp_path, [(0, [1.0]), (1, [2.0])])
    assert "embeddings" not in _plan(inquiries.drop("query_vec"))
    assert inquiries.where("query_vec IS NOT NULL").count() == inquiries.count()


def test_a_vector_stored_twice_still_makes_two_inquiries(spark, tmp_path):
    inquiries = _tables(spark, tmp_path, [(0, [1.0]), (0, [3.0]), (1, [2.0])])
    once = inquiries.select("query_id").distinct().count()
    assert inquiries.drop("query_vec").count() == inquiries.count() > once


def test_only_tenants_that_hold_chunks_are_searched(spark):
    asked = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, None)], "query_id long, patient_id long")
    counts = spark.createDataFrame([(1, 5), (3, 1)], "patient_id long, n long")
    assert sorted(r.query_id for r in rt.of_tenants(asked, counts).collect()) == [1, 3]


def test_guarded_words_are_found_as_by_the_pattern(spark):
    words = ("dose", "how much", "x-ray", "dr's")
    texts = ["which dose", "overdose", "how much", "somehow muchness", "an x-ray", "x ray", "the dr's", "", None, "naïvedose", "dose."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(tx.mentions(F.col("t"), words).alias("a"), F.col("t").rlike(tx.word_list_pattern(words)).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and any(r.a for r in got)
