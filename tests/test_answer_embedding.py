"""The whole inquiry job with questions embedded in it."""

from casebook.operators.answer import answer_inquiries
from casebook.sources.bindings import Bindings
from tests.conftest import SMALL


def test_failed_question_has_its_reason_and_no_answer(spark):
    tables = Bindings(spark, SMALL)
    inquiries = tables.inquiries.drop("query_vec").where("patient_id <= 2")
    broken = "metformin"

    def embedder(texts):
        if any(broken in text.lower() for text in texts):
            raise RuntimeError("provider is down")
        return [[1.0 + len(text) % 7] * 64 for text in texts]

    rows = answer_inquiries(inquiries, tables, embedder=embedder, dimension=64).results.collect()
    assert sorted(r.query_id for r in rows) == sorted(r.query_id for r in inquiries.select("query_id").collect())
    failed = [r for r in rows if r.error and "could not be embedded" in r.error]
    assert failed and all(r.answer is None and "provider is down" in r.error for r in failed)
    assert all(r.answer is not None or r.error for r in rows)
