"""Upload checks, extraction, chunk rules, embeddings, sinks."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from casebook.functions import text as tx
from casebook.operators import ingest as ig
from casebook.sources import files as fs
from casebook.streaming import arrivals as ar


def _chunks(spark, text, method="text/plain", **sizes):
    rows = spark.createDataFrame(
        [(1, 1, "COMPLETED", text, method)],
        "document_id long, patient_id long, extraction_status string, extracted_text string, extraction_method string",
    )
    return ig.chunk_documents(rows, **sizes).orderBy("chunk_index").collect()


def test_short_and_exact_pages_stay_whole(spark):
    assert [c.chunk_text for c in _chunks(spark, "  short note \n")] == ["short note"]
    assert len(_chunks(spark, "a" * 1000)) == 1


def test_break_priority(spark):
    paragraph = "x" * 850 + "\n\n" + "y" * 60 + "\n" + "z" * 400
    assert len(_chunks(spark, paragraph)[0].chunk_text) == 850
    line = "x" * 850 + "\n" + "y" * 60 + ". " + "z" * 400
    assert len(_chunks(spark, line)[0].chunk_text) == 850
    sentence = "x" * 850 + ". " + "y" * 60 + " " + "z" * 400
    assert _chunks(spark, sentence)[0].chunk_text.endswith(".")
    word = "x" * 850 + " " + "z" * 600
    assert len(_chunks(spark, word)[0].chunk_text) == 850
    solid = "x" * 1500
    assert [len(c.chunk_text) for c in _chunks(spark, solid)] == [1000, 650]


def test_overlap_starts_on_a_word(spark):
    words = " ".join(f"word{i:04d}" for i in range(400))
    pieces = [c.chunk_text for c in _chunks(spark, words)]
    assert all(p.startswith("word") and len(p) <= 1000 for p in pieces)
    assert all(pieces[i][-60:] in pieces[i] + pieces[i + 1] for i in range(len(pieces) - 1))
    assert set(words.split()) == {w for p in pieces for w in p.split()}


def test_pages_keep_their_numbers(spark):
    got = _chunks(spark, "one\f \fthree\f" + "four " * 300, "pypdf")
    assert [(c.chunk_index, c.page_number) for c in got] == [(0, 1), (1, 3), (2, 4), (3, 4)]
    assert _chunks(spark, "plain")[0].page_number is None
    assert _chunks(spark, "plain", "pypdf")[0].page_number == 1


@pytest.mark.parametrize("sizes", [(0, 10, 1), (10, 5, 1), (10, 20, -1), (10, 20, 10)])
def test_chunk_sizes_are_checked(sizes):
    with pytest.raises(ValueError):
        ig.check_chunk_sizes(*sizes)


def test_upload_size_limit(spark):
    row = spark.range(1).select(
        ig.upload_verdict(F.lit("application/pdf"), F.concat(F.lit("%PDF"), F.repeat(F.lit("x"), 20 * 1024 * 1024)).cast("binary")).alias("v")
    ).first()
    assert (row.v.accepted, row.v.status_code) == (False, 413)


def test_plain_text_is_normalised(spark):
    raw = bytearray(b"a\x00b\r\nc\rd \xff")
    rows = spark.createDataFrame([(raw,)], "content binary")
    e = ig.extraction(F.lit("text/plain"), F.col("content"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"))
    got = rows.select(e.alias("e")).first().e
    assert got.extraction_status == "COMPLETED" and got.extracted_text == "ab\nc\nd �"


def test_embedding_failures_mark_their_rows(spark):
    rows = spark.createDataFrame(
        [(i, 1, 1, i, "  " if i == 2 else f"text {i}") for i in range(5)],
        "id long, document_id long, patient_id long, chunk_index int, snapshot_text string",
    )
    good = {r.id: r for r in ig.embed(rows, ig.seeded_embedder(8), 8).collect()}
    assert good[2].vector is None and "blank" not in (good[2].error or "") and good[2].error
    assert all(len(good[i].vector) == 8 and good[i].error is None for i in (0, 1, 3, 4))
    short = ig.embed(rows, lambda texts: [[0.0]] * len(texts), 8).where("id = 0").first()
    assert "dimension" in short.error
    lost = ig.embed(rows, lambda texts: [], 8).where("id = 0").first()
    assert "0 vectors" in lost.error


def test_seeded_vector_is_reproducible_and_case_blind(spark):
    a, b = ig.seeded_embedder(16)(["Total  Cholesterol", "total cholesterol"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-4


def test_event_uuid_matches_the_standard(spark):
    got = spark.range(3).select(tx.event_uuid(F.lit("GOAL"), F.col("id"), F.lit("GOAL_RECORDED")).alias("u"), "id").collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, f"timeline:GOAL:{r.id}:GOAL_RECORDED")) for r in got)


def test_age_is_birthday_aware(spark):
    def age(birth, today):
        return spark.range(1).select(tx.age_years(F.lit(birth).cast("date"), F.lit(today).cast("date")).alias("a")).first().a

    assert age("2000-02-29", "2025-02-28") == 24
    assert age("2000-09-24", "2026-09-24") == 26


def test_table_round_trip_and_originals(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 7).alias("patient_id"), "id")
    fs.write_table(rows, str(tmp_path / "t"), buckets=4)
    assert fs.read_table(spark, str(tmp_path / "t")).count() == 100
    place = tmp_path / "store" / "documents" / "5" / "77"
    place.parent.mkdir(parents=True)
    place.write_bytes(b"%PDF-1.4")
    got = fs.read_originals(spark, str(tmp_path / "store")).first()
    assert (got.patient_id, got.document_id, got.length) == ("5", "77", 8)


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, ar.ARRIVAL_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _original(doc, text, day):
    return (doc, doc % 2, "text/plain", bytearray(text.encode()), None, None, datetime.datetime(2026, 1, day))


def test_arrival_stream_replaces_by_document(spark, tmp_path):
    arrivals, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        ar.ingest_stream(spark, arrivals, out, state, ig.seeded_embedder(4), 4).awaitTermination()

    _arrive(spark, arrivals, [_original(1, "first text", 1), _original(2, "w " * 900, 1)])
    run()
    assert ar.current_chunks(spark, out).where("document_id = 2").count() == 2
    _arrive(spark, arrivals, [_original(1, "second text", 2), _original(3, "third", 2), _original(2, " ", 2)])
    run()
    run()
    got = {r.document_id: r for r in ar.current_chunks(spark, out).collect()}
    assert set(got) == {1, 3}
    assert got[1].chunk_text == "second text" and len(got[1].embedding) == 4
    assert ar.current_extractions(spark, out).where("document_id = 2").first().extraction_status == "FAILED"


def test_backfill_stream_embeds_once(spark, tmp_path):
    chunks, out, state = (str(tmp_path / n) for n in ("chunks", "out", "state"))
    rows = [("1-0", 1, 1, 0, None, "a b", None), ("1-1", 1, 1, 1, None, "c d", [0.5, 0.5])]
    spark.createDataFrame(rows, ar.CHUNK_SCHEMA).write.parquet(chunks)
    for _ in range(2):
        ar.backfill_stream(spark, chunks, out, state, ig.seeded_embedder(2), 2).awaitTermination()
    made = spark.read.parquet(f"{out}/vectors").collect()
    assert [r.id for r in made] == ["1-0"]
