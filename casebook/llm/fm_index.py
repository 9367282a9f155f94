"""Benchmark decontamination with one FM-index per shard of training documents.

The benchmark is the query set: phrases (windows of consecutive item words) are compiled in bounded blocks that every
task searches for. A shard is a few megabytes of whole documents inside one task; its words are numbered by the
phrase vocabulary and runs of words that could hold a phrase are indexed, so the index shrinks with the phrases but
no occurrence is lost. Nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.llm.storage import stored

#: Bytes of text to those of its words: A-Z lower-cased, all that is no word byte made a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
#: The struct column that marks the words of a row which stand inside a phrase.
LEAKS = "__leaks"
_LEAKS = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"
_KIND = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; symbols are non-negative integers."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    span = 1
    while n:
        after = np.zeros(n, np.int64)
        after[:-span or n] = rank[span:] + 1 if span < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        changed = np.empty(n, np.int64)
        changed[0] = 0
        np.cumsum(key[order][1:] != key[order][:-1], out=changed[1:])
        rank[order] = changed
        if changed[-1] == n - 1:
            return order
        span *= 2
    return np.zeros(0, np.int64)


class Bits:
    """A bit vector with rank by word counts and population count."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """Backward search over runs of symbols, each run closed by one 0, through the ranks of a wavelet tree.

    Every `step`-th position of a run, its first included, keeps its suffix position, so locating walks back inside
    the run only."""

    def __init__(self, text: np.ndarray, step: int = 8):
        n = len(text)
        closes = np.flatnonzero(text == 0)
        unique = text + len(closes)
        unique[closes] = np.arange(len(closes))
        order = suffix_array(unique)
        bwt = text[order - 1]
        self.n, top = n, int(text.max(initial=0))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.levels: list[tuple[int, Bits, int]] = []
        current = bwt
        for level in reversed(range(max(1, top.bit_length()))):
            bits = (current >> level) & 1 == 1
            self.levels.append((level, Bits(bits), int(len(bits) - bits.sum())))
            current = np.concatenate([current[~bits], current[bits]])
        start = np.zeros(n, np.int64)
        start[1:][text[:-1] == 0] = np.flatnonzero(text[:-1] == 0) + 1
        kept = (np.arange(n) - np.maximum.accumulate(start)) % step == 0
        self.sampled, self.positions = Bits(kept[order]), order[kept[order]]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first i symbols of the transform."""
        low = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one = (symbol >> level) & 1 == 1
            low_ones, ones = bits.rank(low), bits.rank(i)
            low = np.where(one, zeros + low_ones, low - low_ones)
            i = np.where(one, zeros + ones, i - ones)
        return i - low

    def symbol(self, row: np.ndarray) -> np.ndarray:
        found = np.zeros_like(row)
        for level, bits, zeros in self.levels:
            one, ones = bits.get(row), bits.rank(row)
            found |= one.astype(np.int64) << level
            row = np.where(one, zeros + ones, row - ones)
        return found

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns (rows of equal length) that occur, and their ranges of suffix rows."""
        alive = np.flatnonzero((patterns < len(self.first) - 1).all(axis=1))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n)
        for column in reversed(range(patterns.shape[1])):
            c = patterns[alive, column]
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            left = low < high
            alive, low, high = alive[left], low[left], high[left]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        found = np.zeros(len(rows), np.int64)
        open_, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            at = self.sampled.get(row)
            found[open_[at]] = self.positions[self.sampled.rank(row[at])] + steps
            open_, row = open_[~at], row[~at]
            c = self.symbol(row)
            row = self.first[c] + self.rank(c, row)
            steps += 1
        return found


@dataclass
class Phrases:
    """One block of the benchmark: the vocabulary, the distinct phrases by length, and the items each belongs to."""

    vocabulary: dict[bytes, int]
    by_length: list[tuple[np.ndarray, list[tuple[str, ...]]]]

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, item in items:
            ids = [vocabulary.setdefault(word, len(vocabulary) + 1) for word in item]
            for i in range(max(1, len(ids) - window + 1)):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(name)
        lengths: dict[int, list[tuple[int, ...]]] = {}
        for phrase in owners:
            lengths.setdefault(len(phrase), []).append(phrase)
        return cls(vocabulary, [(np.array(p, np.int64), [tuple(owners[x]) for x in p]) for _, p in sorted(lengths.items())])

    def find(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """Per text of a shard: the positions of its words inside a phrase, and the items found."""
        sizes = np.array([len(text) for text in texts])
        ends = np.cumsum(sizes)
        ids = np.fromiter((i for text in texts for i in map(self.vocabulary.get, text, repeat(0))), np.int64, int(ends[-1]))
        found: list[tuple[np.ndarray, set[str]]] = [(np.zeros(0, np.int64), set()) for _ in texts]
        text, origin = self._runs(ids, ends - sizes)
        if not len(text):
            return found
        index = FMIndex(text)
        hit = np.zeros(len(ids) + 1, np.int64)
        for patterns, owners in self.by_length:
            which, low, high = index.search(patterns)
            if not len(which):
                continue
            many = high - low
            rows = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            at = origin[index.locate(rows)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + patterns.shape[1], -1)
            pairs = np.unique(np.searchsorted(ends, at, "right") * len(patterns) + np.repeat(which, many))
            for pair in pairs.tolist():
                found[pair // len(patterns)][1].update(owners[pair % len(patterns)])
        words_hit = np.flatnonzero(np.cumsum(hit[:-1]))
        for part in np.split(words_hit, np.flatnonzero(np.diff(np.searchsorted(ends, words_hit, "right"))) + 1):
            if len(part):
                doc = int(np.searchsorted(ends, part[0], "right"))
                found[doc] = (part - (ends[doc] - sizes[doc]), found[doc][1])
        return found

    def _runs(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of phrase words at least as long as the shortest phrase, each closed by 0; and where symbols come from."""
        shortest = self.by_length[0][0].shape[1]
        known = ids != 0
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        begins[starts[(starts < len(ids))]] = known[starts[(starts < len(ids))]]
        begin = np.flatnonzero(begins)
        stops = known.copy()
        stops[:-1] &= ~known[1:] | begins[1:]
        stop = np.flatnonzero(stops) + 1
        long = stop - begin >= shortest
        begin, size = begin[long], (stop - begin)[long] + 1
        origin = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        text = np.append(ids, 0)[origin]
        text[np.cumsum(size) - 1] = 0
        return text, origin


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of a bounded number of phrases, read one partition at a time."""
    items, windows = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        item = words(row[1])
        if item:
            items.append((row[0] or "", item))
            windows += max(1, len(item) - window + 1)
        if windows >= block_windows:
            yield items
            items, windows = [], 0
    if items:
        yield items


def _marks(texts: list[list[bytes]], phrases: Phrases | None, before) -> list[dict]:
    """One mark per text of a shard, joined with the marks of earlier phrase blocks."""
    found = phrases.find(texts) if phrases else [(np.zeros(0, np.int64), set())] * len(texts)
    rows = []
    for text, (hit, items), old in zip(texts, found, before, strict=False):
        if old:
            spans = zip(old["starts"], old["ends"], strict=True)
            hit = np.union1d(hit, np.array([i for a, b in spans for i in range(a, b)], np.int64))
            items = items | set(old["items"])
        first = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
        last = np.append(first[1:], len(hit))[: len(first)] - 1
        rows.append({"n_words": len(text), "starts": hit[first].tolist(), "ends": (hit[last] + 1).tolist(), "items": sorted(items)})
    return rows


def mark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    window: int = 10,
    block_windows: int = 200_000,
    shard_bytes: int = 8 << 20,
    *,
    then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """The columns `keep` of `docs` and the struct LEAKS: n_words, runs [starts, ends) of word positions inside any
    occurrence of a benchmark phrase, and the ids of the items that occur.

    A phrase is `window` consecutive item words; an item of fewer words, but not none, is one phrase. Null and empty
    texts have no words; null or wordless items and an empty benchmark hit nothing; an item without id is listed as ''.
    Repeated rows and items give the same marks again. At most `block_windows` phrases and one item more are searched
    for, and broadcast, at a time; a larger benchmark takes more passes. `then` turns each marked batch into one of
    `schema` in the same Python worker."""
    spark, names = docs.sparkSession, docs.columns
    places, text_at = [names.index(c) for c in keep], names.index("text")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def pass_over(frame: DataFrame, phrases: Phrases | None, last: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(phrases)
        marked = len(frame.columns) > len(names)
        at = places if last else list(range(len(names)))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, done = batch.column(text_at).to_pylist(), 0
                while done < len(texts):
                    size, end = 0, done
                    while end < len(texts) and size < shard_bytes:
                        size += len(texts[end] or "")
                        end += 1
                    shard = batch.slice(done, end - done)
                    before = shard.column(len(names)).to_pylist() if marked else repeat(None)
                    rows = _marks([words(text) for text in texts[done:end]], sent.value, before)
                    found = pa.RecordBatch.from_arrays([shard.column(i) for i in at] + [pa.array(rows, _KIND)], [names[i] for i in at] + [LEAKS])
                    yield then(found) if last and then else found
                    done = end

        return frame.mapInArrow(search, schema if last and then else ", ".join([*(kinds[i] for i in at), f"`{LEAKS}` {_LEAKS}"]))

    frame, pending = docs, None
    for items in _blocks(benchmark, window, block_windows):
        if pending is not None:
            frame = stored(pass_over(frame, pending, False))
        pending = Phrases.of(items, window)
    return pass_over(frame, pending, True)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items for every row of `docs`."""
    leak = F.col(LEAKS)
    hit = F.aggregate(F.arrays_zip(leak["starts"], leak["ends"]), F.lit(0).cast("long"), lambda n, r: n + r["ends"] - r["starts"])
    return mark_leaks(docs.select("doc_id", "text"), benchmark, ["doc_id"], window).select(
        "doc_id",
        leak["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.size(leak["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leak["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        leak["items"].alias("items"),
    )


def remove_spans(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without its words starts[k] to ends[k], and without what separates words inside one such run."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data.translate(_WORD_BYTES))]
    kept, last = [], 0
    for a, b in zip(starts, ends, strict=True):
        kept.append(data[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*kept, data[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """`docs` without the spans that occur in the benchmark; same columns, n_chars (if there) set anew.

    A document that held words and is left with none goes; every other row stays, clean ones as they are."""
    names, at = docs.columns, docs.columns.index("text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaks = batch.column(len(names)).to_pylist()
        whole = [sum(k["ends"]) - sum(k["starts"]) < k["n_words"] or not k["n_words"] for k in leaks]
        texts = [remove_spans(t, k["starts"], k["ends"]) if k["starts"] else t for t, k in zip(batch.column(at).to_pylist(), leaks, strict=True)]
        columns = [batch.column(i) for i in range(len(names))]
        columns[at] = pa.array(texts, pa.string())
        if "n_chars" in names:
            i = names.index("n_chars")
            old = columns[i].to_pylist()
            columns[i] = pa.array([len(t) if k["starts"] else o for t, k, o in zip(texts, leaks, old, strict=True)], columns[i].type)
        return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(whole, pa.bool_()))

    return mark_leaks(docs, benchmark, names, window, then=cut, schema=docs.schema)
