"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from casebook.llm.units import LETTERS, NUMERALS, PLAIN, Memo, byte_slices, gather, has_runs, joined, units, words_of

#: White space as the pattern's engine has it (Unicode White_Space), whatever the local one takes for it.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Pieces of a plain word after a space under the pattern of the GPT-2 family.
_CUTS = f"('s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMERALS}]+| ?[^\\s{LETTERS}{NUMERALS}]+)"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the pair of lowest rank, leftmost first, until none is left.

    Tokens form a linked list over start positions. Positions wait in one bucket per merge rank under a two-level
    bitmap of non-empty buckets: the lowest set bit of `upper` names a word of 256 ranks, whose lowest set bit names
    the next rank. Entries whose pair has changed since are left in and skipped. Each merge touches its two
    neighbours only, so n bytes take O(n log n) however long the piece is. The queue is kept in local variables, as
    most pieces are a few bytes long. Raises KeyError if the ranks lack a byte of the piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    pair = [-1] * (n + 1)  # rank of the token that starts here merged with the next one
    upper, lower, buckets = 0, {}, {}
    rank_of = ranks.get
    fresh = [(rank, i) for i in range(n - 1) if (rank := rank_of(piece[i : i + 2])) is not None]
    for rank, i in fresh:
        pair[i] = rank
    while fresh or upper:
        for rank, i in fresh:
            bucket = buckets.get(rank)
            if bucket:
                heappush(bucket, i)
            else:
                buckets[rank] = [i]
                lower[rank >> 8] = lower.get(rank >> 8, 0) | 1 << (rank & 255)
                upper |= 1 << (rank >> 8)
        word = (upper & -upper).bit_length() - 1
        bits = lower[word]
        low = bits & -bits
        rank = word << 8 | low.bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            lower[word] = bits = bits ^ low
            if not bits:
                upper ^= 1 << word
        fresh = []
        if pair[i] != rank:
            continue
        gone = after[i]
        end = after[i] = after[gone]
        pair[gone] = pair[i] = -1
        if end < n:
            before[end] = i
            rank = rank_of(piece[i : after[end]])
            if rank is not None:
                pair[i] = rank
                fresh.append((rank, i))
        left = before[i]
        if left >= 0:
            rank = rank_of(piece[left:end])
            if rank is None:
                pair[left] = -1
            elif rank != pair[left]:
                pair[left] = rank
                fresh.append((rank, left))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encodes whole texts to little-endian unsigned 32-bit ids and decodes them."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
        self.names = np.array(self.tokens, object)
        self.lengths = np.array([len(token) for token in self.tokens], np.int64)
        self.pieces = Memo(self._pieces, 500_000)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        return [np.array(merge(piece.encode(), self.ranks), "<u4").tobytes() for piece in pieces]

    def _units(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(text) for text in texts]
        known = self.pieces.ready({piece for pieces in cut for piece in pieces})
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def _later(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, each after a space, in one row and the number of each."""
        plain = pc.match_substring_regex(words, PLAIN)
        spaced = pc.binary_join_element_wise(pa.scalar(""), pc.if_else(plain, words, ""), " ")
        codes, ends, pieces = words_of(pc.replace_substring_regex(spaced, _CUTS, "\\1\0"), "\0")
        pieces = pieces.to_pylist()
        known = self.pieces.ready({piece for piece in pieces if piece.strip(" ")})
        values = [known[piece] if piece.strip(" ") else b"" for piece in pieces]
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if len(other):  # each was cut into one piece without ids
            codes[ends[other] - 1] = len(values) + np.arange(len(other))
            values += self._units([" " + word for word in words.take(pa.array(other)).to_pylist()])
        flat, stops = gather(*joined(values), codes, ends)
        return flat, np.diff(stops, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) in one row and where each text's end. Each distinct word is cut once a call."""
        runs = has_runs(texts)
        codes, ends, words = words_of(pc.if_else(pa.array(runs), "", texts) if runs.any() else texts)
        flat, sizes = self._later(words)
        starts = np.concatenate([[0], ends])[:-1]
        names = words.take(pa.array(codes[starts])).to_pylist()  # the first word of a text follows no space
        for at in np.flatnonzero(runs).tolist():
            names[at] = texts[at].as_py()
        firsts, place = np.unique(np.array(names, object), return_inverse=True) if names else ([], starts)
        codes[starts] = len(sizes) + place
        more, counts = joined([b"".join(self._units(units(text)[:1]) + self._units([" " + u for u in units(text)[1:]])) for text in firsts])
        return gather(np.concatenate([flat, more]), np.concatenate([sizes, counts]), codes, ends)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text, whose ids end there."""
        raw = b"".join(self.names[ids].tolist())
        stops = np.concatenate([[0], np.cumsum(self.lengths[ids])])[np.concatenate([[0], ends])].tolist()
        return [raw[a:b] for a, b in zip(stops, stops[1:], strict=False)]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, if `ids`), ids_sha256, decoded_sha256 for every row of `docs`.

    Null and empty texts have no ids (both digests are those of no bytes). Repeated rows give repeated rows; a null
    doc_id stays null; other columns are not read. `path` names the rank file on every executor."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            done = 0
            for texts in byte_slices(batch.column(1)):
                flat, ends = own.encode(texts)
                counts = np.diff(ends, prepend=0)
                rows = np.split(flat, ends[:-1])
                columns = [
                    batch.column(0).slice(done, len(texts)),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(row).hexdigest() for row in rows], pa.string()),
                    pa.array([hashlib.sha256(row).hexdigest() for row in own.decode(flat, ends)], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat.astype("<i4"))))
                    names.append("ids")
                done += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(encoded, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of every row of `encoded` (doc_id, ids); no ids or null ids give the empty text.

    Bytes that are no UTF-8 (ids cut inside a character) become U+FFFD."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [b"".join(map(own.tokens.__getitem__, row or [])).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")
