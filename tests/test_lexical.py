"""Entities found through the words of texts, against the plain match of every pair."""

import pytest
from pyspark.sql import functions as F

from casebook.functions.skew import key_counts
from casebook.operators import lexical as lc
from casebook.operators import retrieve as rt

ENTITIES = [
    "metformin", "covid-19", "blood pressure", "hba1c", "x", "", "  ", "!!", "-ray", "type 2 diabetes", "a b", "vitamin b12", "é", "Naïve Bayes",
    "foo_bar", "c++", "in the", "ous x", "hypertension", "end. start", "日本 語", "i̇x", "10 mg", "10 m", ". x",
]
TEXTS = [
    None, "", "Metformin 10 mg daily", "metformins", "premetformin", "COVID-19 test", "covid -19", "high blood pressures", "xblood pressure", "bloodpressure",
    "HbA1c: 6", "x-ray of é", "type 2 diabetes", "type 2  diabetes", "vitamin B12", "previtamin b123", "NAÏVE BAYESIAN", "foo_bar foo bar", "c++ and c+", "in theory",
    "various x", "end. started", "日本 語 日本語", "İX", "10 mgs", "a b", "aa bb", "!! wow !!", "word", "He has hypertension.", ". x",
]


def _tables(spark):
    chunks = [(i, i % 3, 1 + i % 2, 0, text, [1.0]) for i, text in enumerate(TEXTS * 3)]
    frame = spark.createDataFrame(chunks, "chunk_id long, patient_id long, document_id long, chunk_index int, chunk_text string, embedding array<float>")
    terms = spark.createDataFrame([(p, e) for p in range(3) for e in ENTITIES[p::1]] + [(9, "word")], "patient_id long, entity string")
    return frame, terms


@pytest.mark.parametrize(("rows_per_salt", "block"), [(1_000_000, 512), (5, 4)])
def test_named_entities_are_those_of_the_plain_match(spark, rows_per_salt, block):
    chunks, terms = _tables(spark)
    got = lc.naming_chunks(chunks, terms, key_counts(chunks, ["patient_id"]), rows_per_salt, block).select("chunk_id", "patient_id", "entity").collect()
    want = chunks.join(terms, "patient_id").where(lc.lexical_match(F.col("entity"), F.col("chunk_text"))).select("chunk_id", "patient_id", "entity").collect()
    assert len(want) > 80 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_text_is_read_once_for_many_entities(spark):
    _, terms = _tables(spark)
    assert {r["count"] for r in lc.term_blocks(terms).groupBy("patient_id").count().collect()} == {1}
    keys = {r.term: r.key for r in spark.createDataFrame([(e,) for e in ENTITIES], "term string").select("term", lc.term_key(F.lower("term")).alias("key")).collect()}
    assert keys["covid-19"] == "=covid" and keys["blood pressure"] == "<pre" and keys["type 2 diabetes"] == "=2" and keys["!!"] is None and keys["a b"] is None


def test_questions_are_embedded_once_and_fail_alone(spark):
    rows = [(1, 1, "What  does my lab report say?", ["lab_results"]), (2, 2, " What does my lab report say? ", ["lab_results"]), (3, 1, " \n ", ["lab_results"]),
            (4, 1, "broken lab report", ["lab_results"]), (5, 1, "no documents", []), (6, 1, "too short", ["lab_results"])]
    domain = next(iter(rt.lx.DOMAIN_DOCUMENT_TYPES))
    targets = spark.createDataFrame([(q, p, t, [domain] if d else []) for q, p, t, d in rows], "query_id long, patient_id long, query_text string, document_domains array<string>")

    def embedder(texts):
        if any("broken" in text for text in texts):
            raise RuntimeError("provider is down")
        return [[1.0] if "short" in text else [float(len(text)), 0.5] for text in texts]

    out = rt.embed_questions(targets, embedder, 2, batch=1)
    got = {r.query_id: (list(r.query_vec) if r.query_vec else None, r.embedding_error) for r in out.collect()}
    assert got[1] == got[2] == ([28.0, 0.5], None) and got[5] == (None, None)
    assert got[4] == (None, "provider is down") and "dimension" in got[6][1] and "empty" in got[3][1]
