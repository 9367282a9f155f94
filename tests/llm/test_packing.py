"""Packing against the library's ids and against plain best fit."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casebook.llm import packing
from tests.llm.samples import documents, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        gap = min(fits) if fits else capacity
        if fits:
            gaps.remove(gap)
        gaps.append(gap - length)
    return len(gaps)


def check(rows, capacity):
    """Every sequence is gapless from 0 and holds at most its capacity."""
    held = {}
    for row in rows:
        held.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_every_piece_is_packed_once(spark, capacity):
    library = Tokenizer.from_file(PATH)
    packed = packing.pack_documents(documents(spark), PATH, capacity)
    rows = packed.collect()
    want = []
    for doc_id, text in texts():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes()), part.tobytes()))
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
    assert sorted((tuple(r[n] for n in names) for r in rows), key=str) == sorted(want, key=str)
    assert check(rows, capacity) <= plain_best_fit([w[3] for w in want], capacity) * 1.05 + 1
    joined = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for row in rows:
        assert bytes(joined[row.sequence_id].ids)[4 * row.offset :].startswith(bytes(row.ids))


@pytest.mark.parametrize("draw", ["even", "small", "ones", "third", "halves"])
def test_sequences_are_nearly_as_few_as_best_fit(spark, draw):
    rng = np.random.default_rng(7)
    lengths = {
        "even": rng.integers(1, 2049, 3000),
        "small": rng.integers(1, 120, 6000),
        "ones": np.ones(5000, int),
        "third": np.where(rng.random(3000) < 0.34, 700, rng.integers(1, 2049, 3000)),
        "halves": np.full(500, 1024),
    }[draw].tolist()
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long").withColumn("n", F.lit("clash"))
    rows = packing.best_fit(items.select("item", "length")).collect()
    assert sorted((r.item, r.length) for r in rows) == list(enumerate(lengths))
    held = {}
    for row in rows:
        held[row.sequence_id] = held.get(row.sequence_id, 0) + row.length
    assert max(held.values()) <= 2048
    assert len(held) <= plain_best_fit(lengths, 2048) * 1.01 + 1


def test_no_documents(spark):
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0
