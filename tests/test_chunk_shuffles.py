"""Texts of chunks don't cross the network for a vector that nobody reads."""

from __future__ import annotations

import pytest

from casebook.operators.retrieve import searchable_chunks
from casebook.sources.bindings import Bindings


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(1, 3)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    docs = [(1, "a b " * 300, "en", "web", 1200), (2, " ", "en", "web", 1), (3, None, "en", "web", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def made(vectors):
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        return Bindings(spark, str(tmp_path))

    return made


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_alone_meet_no_vectors(tables):
    chunks = tables([(1, [1.0]), (2, None)]).document_chunks
    assert "Join" not in _plan(chunks.select("id", "chunk_text"))
    assert {(r.id, r.embedding is None) for r in chunks.collect()} == {(100000, False), (100001, True), (200000, True), (300000, True)}


def test_repeated_vectors_still_repeat_chunks(tables):
    chunks = tables([(1, [1.0]), (1, [2.0])]).document_chunks
    assert sorted(r.id for r in chunks.select("id").collect()) == [100000, 100000, 100001, 200000, 300000]


def test_search_carries_a_flag_instead_of_the_vector(tables):
    t = tables([(1, [1.0]), (2, [1.0])])
    found = searchable_chunks(t.document_chunks, t.medical_documents, t.document_extractions)
    assert {(r.chunk_id, r.retrievable) for r in found.collect()} == {(100000, True), (100001, True), (200000, False), (300000, False)}
    lines = [line for line in _plan(found.drop("embedding")).splitlines() if "_usable" in line]
    assert any("isnotnull(embedding" in line and " AS _usable" in line for line in lines)
