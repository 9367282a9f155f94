"""Tokenising operators against their libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casebook.llm import bpe, token_counts, token_store
from casebook.llm.storage import shared_folder
from casebook.llm.units import Memo, units
from tests.llm.samples import documents, texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sorted(rows):
    return sorted(rows, key=str)


def test_ids_and_digests_match_the_library(spark, reference):
    got = bpe.encode_documents(documents(spark), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text in texts():
        ids = reference.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert _sorted(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in got) == _sorted(want)


def test_decoding_gives_the_texts_back(spark):
    encoded = bpe.encode_documents(documents(spark), RANKS, public_tokenizers.PATTERN)
    got = bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert _sorted((r.doc_id, r.text) for r in got) == _sorted((i, t or "") for i, t in texts())


@pytest.mark.parametrize("piece", [b"a" * 4000, b"ab" * 2000, bytes(range(256)) * 3, "日本語".encode() * 500, b""])
def test_long_pieces_merge_like_the_library(reference, piece):
    ranks = bpe.load_ranks(RANKS)
    assert bpe.merge(piece, ranks) == (reference._encode_single_piece(piece) if piece else [])


def test_counts_match_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.count_tokens(documents(spark), path, limit=100).collect()
    want = [(i, len((t or "").encode()), n, n > 100) for i, t in texts() for n in [len(library.encode(t or "", add_special_tokens=False).ids)]]
    assert _sorted(map(tuple, got)) == _sorted(want)


def test_token_files_hold_all_ids_in_order(spark):
    path, folder = public_tokenizers.path("word_bpe_49k.json"), shared_folder(spark)
    library = Tokenizer.from_file(path)
    token_store.write_tokens(documents(spark), folder, path, block_ids=500)
    got = token_store.token_checks(token_store.read_tokens(spark, folder)).collect()
    at, want = 0, []
    for doc_id, text in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_tables(spark):
    none = documents(spark, []).where(F.lit(False))
    assert bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    folder = shared_folder(spark)
    token_store.write_tokens(none, folder, public_tokenizers.path("word_bpe_49k.json"))
    assert token_store.read_tokens(spark, folder).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packed_ids_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 2**63, 20_000, dtype=np.uint64) >> rng.integers(0, 63, 20_000).astype(np.uint64)
    ids[::97] = 2**64 - 1
    packed = token_store.pack(ids)
    assert (token_store.unpack(packed) == ids).all()
    assert (token_store.unpack(packed, slice(1, 2)) == ids[token_store.FRAME : 2 * token_store.FRAME]).all()


def test_small_ids_take_few_bytes():
    assert len(token_store.pack(np.ones(6000, np.uint32))) < 1000


def test_units_cut_only_after_ink():
    assert units("a b  c \nd") == ["a", "b", " c", "\nd"]


def test_memo_answers_whatever_it_forgets():
    memo = Memo(lambda wanted: [len(w) for w in wanted], entries=4)
    for k in range(20):
        wanted = {"x" * k, "y" * (k % 3), "z" * 100}
        assert memo.ready(wanted) == {w: len(w) for w in wanted}
