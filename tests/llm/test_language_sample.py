"""The training sample of a language of many copies, and of many languages."""

from casebook.llm import language


def _text(lang: int, k: int) -> str:
    return " ".join(f"{chr(0x4E00 + lang)}{chr(0x4E00 + (lang * 7 + k * j) % 900)}" for j in range(1, 12))


def test_copies_do_not_thin_the_sample(spark):
    rows = [(k, "aa", _text(1, k)) for k in range(100)] + [(1_000 + k, "bb", _text(2, k % 20)) for k in range(60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.train(docs)
    assert model.languages == ["aa", "bb"]
    got = language.identify(docs, model)
    assert got.join(docs.select("doc_id", "lang"), "doc_id").where("lang <> lang_pred").count() == 0


def test_the_sample_takes_every_distinct_text_it_has_room_for(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language.Model, "fit", classmethod(lambda cls, texts, labels, *_: seen.extend(zip(labels, texts, strict=True))))
    rows = [(k, "bb", _text(2, k % 50)) for k in range(60_000)]
    language.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert sorted(seen) == sorted({(lang, text) for _, lang, text in rows})


def test_no_language_is_left_out(spark):
    rows = [(3 * k + i, f"l{k:03}", _text(k, i)) for k in range(270) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    learnt = docs.where(~language.held_out(docs.doc_id)).select("lang").distinct()
    assert language.train(docs, landmarks=2).languages == sorted(r.lang for r in learnt.collect())
