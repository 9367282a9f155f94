"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from casebook.llm.units import Memo, by_bytes, units

#: Pieces of ASCII text under the vocabulary's own pattern; a piece alone is encoded as inside its text.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")


class Counter:
    """Counts tokens of whole texts with one tokenizers file of the byte-level kind.

    Special strings inside a text are what the library takes them for; units that hold one go to it uncut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Memo(self._lengths, 1_000_000)
        self.first = Memo(self._units)
        self.later = Memo(lambda later: self._units([" " + unit for unit in later]))

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, texts: list[str]) -> list[int]:
        """Plain ASCII units are counted by their pieces, which repeat more often than they do."""
        cut = [
            _PIECES.findall(text) if text.isascii() and not any(s in text for s in self.special) and text.isprintable() else [text]
            for text in texts
        ]
        known = self.pieces.ready({piece for pieces in cut for piece in pieces})
        return [sum(map(known.__getitem__, pieces)) for pieces in cut]

    def count(self, texts: list[str]) -> list[int]:
        cut = [units(text) for text in texts]
        first = self.first.ready({c[0] for c in cut})
        later = self.later.ready({unit for c in cut for unit in c[1:]})
        return [first[c[0]] + sum(map(later.__getitem__, c[1:])) for c in cut]


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    """One per Python worker: loading a vocabulary costs more than many small tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) for every row of `docs`.

    Null and empty texts have zero bytes and tokens. Repeated rows give repeated rows; a null doc_id stays null.
    Columns other than doc_id and text are not read. `path` names the vocabulary on every executor."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [n for part in by_bytes(texts) for n in counter.count(part)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
