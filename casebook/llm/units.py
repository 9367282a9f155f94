"""Cut texts into units that a byte-level or word BPE encodes independently, and remember what each encodes to."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space after any white space stands inside a run that the pre-tokenizers may take as one piece.
_ASCII_RUNS = ("  ", "\n ", "\t ", "\r ", "\v ", "\f ", "\x1c ", "\x1d ", "\x1e ", "\x1f ")
_OTHER_RUNS = re.compile("[\x85\xa0  -     　] ")
_AFTER_INK = re.compile(r"(?<=\S) ")
#: Letters and numerals below U+0250, whose classes are settled in every version of Unicode, and words of nothing else.
LETTERS = r"a-zA-Z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
NUMERALS = r"0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}"
PLAIN = r"^[!-~\x{a1}-\x{ac}\x{ae}-\x{24f}]+$"


def units(text: str) -> list[str]:
    """Split before each space that follows ink; every unit but the first lost that one leading space.

    No piece of the GPT-2 family of patterns spans such a place, so tokens of the units, joined, are the text's."""
    if any(run in text for run in _ASCII_RUNS) or (not text.isascii() and _OTHER_RUNS.search(text)):
        return _AFTER_INK.split(text)
    return text.split(" ")


def by_bytes(texts: Iterable[str | None], most: int = 4 << 20) -> Iterator[list[str]]:
    """Batches of whole texts balanced by length; a null counts as empty."""
    batch, size = [], 0
    for text in texts:
        batch.append(text or "")
        size += len(batch[-1])
        if size >= most:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def has_runs(texts: pa.Array) -> np.ndarray:
    """Texts that `units` does not simply cut at every space."""
    found = pc.match_substring_regex(texts, _OTHER_RUNS.pattern)
    for run in _ASCII_RUNS:
        found = pc.or_(found, pc.match_substring(texts, run))
    return found.to_numpy(zero_copy_only=False)


def byte_slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """The same texts in order, cut between rows so that few bytes become Python objects at a time; nulls are empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield pc.fill_null(texts.slice(at, stop - at), "")
        at = stop


def words_of(texts: pa.Array, mark: str = " ") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts without nulls cut at every mark: the code of each word, the end of each text, the distinct words."""
    lists = pc.split_pattern(texts, mark)
    found = lists.flatten().dictionary_encode()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, found.dictionary


def joined(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit ids of all values in one row, and the number of each."""
    return np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that each code stands for, in one row, and where those of each text end."""
    starts = np.cumsum(sizes) - sizes
    counts = sizes[codes]
    stops = np.cumsum(counts)
    places = np.repeat(starts[codes] - (stops - counts), counts)
    places += np.arange(len(places))
    return flat[places], np.concatenate([[0], stops])[ends]


class Memo:
    """What each unit encodes to: two generations bounded in entries, the older one dropped as the younger fills.

    Units of over `longest` characters are never kept."""

    def __init__(self, encode: Callable[[list[str]], list], entries: int = 400_000, longest: int = 64):
        self.encode, self.half, self.longest = encode, entries // 2, longest
        self.young: dict = {}
        self.old: dict = {}

    def ready(self, wanted: set[str]) -> dict:
        """A mapping of every wanted unit."""
        order = list(wanted)
        answer = dict(zip(order, map(self.young.get, order), strict=True))
        rest = [unit for unit, value in answer.items() if value is None]
        again = dict(zip(rest, map(self.old.get, rest), strict=True))
        missing = [unit for unit, value in again.items() if value is None]
        if missing:
            again.update(zip(missing, self.encode(missing), strict=True))
        answer.update(again)
        self.young.update((unit, value) for unit, value in again.items() if len(unit) <= self.longest)
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        return answer
