"""Repeated byte strings removed from a corpus by prefix-free parsing and suffix arrays.

Parsing. The trigger of a window of 100 bytes is the rolling hash of the 24-byte string in it that is smallest; windows
in a row with one trigger form a phrase. Phrases are read off the content, so equal windows always stand in phrases of
equal trigger. The dictionary holds each distinct phrase once, the parse is where phrases occur.

Order. A phrase that occurs before (smaller doc_id, or earlier in the same document) is removed as a whole; of each
distinct phrase the first occurrence is left. Its windows can recur only inside other phrases of the same trigger, so
the dictionary is sorted by trigger and suffix arrays of those phrases, to the depth of a window, find equal windows;
the parse says which stands first in the corpus.

Scale. One row per phrase (about 35 bytes of text) crosses the network once; repeats inside a task's chunk are settled
before. Triggers that many texts share are split by phrase, and their windows compared by digest instead."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.hashing import Ranges, mix
from casebook.llm.storage import discard, stored

LENGTH, WIDTH = 100, 24
#: Bytes parsed at once; a longer text is cut with an overlap that keeps every window whole.
CHUNK = 2 << 20
#: Bits of a place (start << 10 | flags | windows): settled as a repeat already; of a trigger that is split.
KNOWN, SPLIT, MANY = 1 << 9, 1 << 8, 255
#: A trigger with more phrases than HOT in a chunk counts as hot, and the HOTTEST of them are split into PARTS.
HOT, HOTTEST, PARTS = 48, 10_000, 64
#: Triggers of more distinct phrases have their windows compared by digest.
DENSE = 20_000
#: Rows without an id are one document, which stands before all others; each text of it has a key below this one, so
#: that their phrases meet their own text only.
NO_ID = -(2**62)

_PHRASES = "key long, hash long, doc long, place long"


def _document(key: np.ndarray) -> np.ndarray:
    """The document a key stands for in the order of the corpus."""
    return np.maximum(key, NO_ID)


def phrases(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, ranges: Ranges) -> tuple[np.ndarray, ...]:
    """Trigger, hash, first window and number of windows of the phrases of texts [start, stop) of a buffer."""
    ranges.load(data)
    grams = ranges.every(WIDTH)
    if not len(grams):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    least = grams & np.uint64(0xFFFFFFFFF0000000) | np.arange(len(grams), dtype=np.uint64)
    span, reach = LENGTH - WIDTH + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    trigger = (least & np.uint64(0x0FFFFFFF)).astype(np.int64)
    n = len(trigger)
    inside = np.zeros(len(data) + 1, np.int32)
    long = stops - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, stops[long] - LENGTH + 1, -1)
    window = np.cumsum(inside)[:n] > 0
    head = np.zeros(len(data) + 1, bool)
    head[starts] = True
    opens = window.copy()
    opens[1:] &= (trigger[1:] != trigger[:-1]) | head[1:n] | ~window[:-1]
    closes = window.copy()
    closes[:-1] &= opens[1:] | ~window[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    return grams[trigger[first]], ranges.hash(first, last + LENGTH), first, last - first + 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of text with, for each piece, its document, place in the buffer and place in its document."""
    for batch in batches:
        docs, held, size = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode() if text else b""
            for at in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):
                piece = raw[at : at + CHUNK + LENGTH - 1]
                docs.append((doc, at))
                held.append(piece)
                size += len(piece)
                if size >= CHUNK:
                    yield _buffer(docs, held)
                    docs, held, size = [], [], 0
        if held:
            yield _buffer(docs, held)


def _buffer(docs: list[tuple[int, int]], held: list[bytes]):
    stops = np.cumsum([len(piece) for piece in held])
    doc, offset = np.array(docs, np.int64).T
    return np.frombuffer(b"".join(held), np.uint8), doc, stops - [len(piece) for piece in held], stops, offset


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk: trigger, hash, document, place, and whether the same phrase stands before it in the chunk."""
    ranges = Ranges()
    for data, doc, starts, stops, offset in _chunks(batches):
        trigger, hashed, first, many = phrases(data, starts, stops, ranges)
        piece = np.searchsorted(stops, first, "right")
        place = first - starts[piece] + offset[piece] << 10 | many
        order = np.lexsort((doc[piece], place, _document(doc[piece]), hashed, trigger))
        trigger, hashed, at, place = trigger[order], hashed[order], doc[piece][order], place[order]
        of = _document(at)
        again = np.zeros(len(order), bool)
        again[1:] = (trigger[1:] == trigger[:-1]) & (hashed[1:] == hashed[:-1])
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
        again &= (of != of[lead]) | (place != place[lead])
        yield trigger, hashed, at, place, again


def _hot_triggers(docs: DataFrame) -> np.ndarray:
    """The triggers with the most phrases, a bounded number; they are split, all others stay whole."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trigger, _, _, _, again in _parse(batches):
            key, n = np.unique(trigger[~again], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key[n > HOT].view(np.int64)), pa.array(n[n > HOT])], ["key", "n"])

    counts = docs.mapInArrow(frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(HOTTEST).collect()], np.int64))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, hash, document, place, doc): repeats (kind 0), and first occurrences whose trigger has other
    phrases too (kind 1). A first occurrence waits until the next one shows whether it shares its trigger. Texts without
    an id may have their first occurrence at one place; each keeps its own."""
    names = ["kind", "key", "hash", "doc", "place"]
    waiting = [np.zeros(0, np.int64)] * 4
    shared = np.zeros(0, bool)
    previous: tuple | None = None

    def rows(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], names)

    for batch in batches:
        key, hashed, doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        known = place & KNOWN != 0
        if known.any():
            yield rows(0, [key[known], hashed[known], doc[known], place[known]])
            key, hashed, doc, place = key[~known], hashed[~known], doc[~known], place[~known]
        if not len(key):
            continue
        before = previous or (None,) * 5
        same_key = np.append(before[0] == key[0] if previous else False, key[1:] == key[:-1])
        new = ~same_key | np.append(not previous or before[1] != hashed[0], hashed[1:] != hashed[:-1])
        # a repeated row stands at the very place of the first occurrence: it is that occurrence
        lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        of = _document(doc)
        first_of = np.where(lead >= 0, of[lead], before[2] if previous else 0)
        first_place = np.where(lead >= 0, place[lead], before[3] if previous else 0)
        again = ~new & ((of != first_of) | (place != first_place))
        yield rows(0, [key[again], hashed[again], doc[again], place[again]])
        new |= ~again & np.append(not previous or before[4] != doc[0], doc[1:] != doc[:-1])
        previous = (key[-1], hashed[-1], int(first_of[-1]), int(first_place[-1]), int(doc[-1]))
        firsts = [np.concatenate([w, c[new]]) for w, c in zip(waiting, (key, hashed, doc, place), strict=True)]
        shared = np.concatenate([shared, np.zeros(int(new.sum()), bool)])
        touching = firsts[0][1:] == firsts[0][:-1]
        shared[1:] |= touching
        shared[:-1] |= touching
        done = shared | (firsts[3] & SPLIT != 0)
        done[-1:] = False
        yield rows(1, [c[done] for c in firsts])
        waiting, shared = [c[-1:] for c in firsts], shared[-1:]
    done = shared | (waiting[3] & SPLIT != 0)
    yield rows(1, [c[done] for c in waiting])


def equal_windows(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank of the suffixes at places of a buffer among them, to the depth of a window, by prefix doubling.

    Equal ranks are equal windows; the order of the ranks is that of the suffix array."""
    padded = np.concatenate([buffer, np.zeros(LENGTH, np.uint8)])
    n = len(buffer)
    rank = np.zeros(n, np.uint64)
    for k in range(8):
        rank = rank << np.uint64(8) | padded[k : k + n]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        pair = rank.copy() * (n + 1)
        pair[: n - step] += rank[step:] + 1
        if depth + step == LENGTH:
            return np.unique(pair[at], return_inverse=True)[1]
        rank = np.unique(pair, return_inverse=True)[1]
        depth += step
    return rank[at]


class _Windows:
    """The windows of phrases (doc, place, bytes): where they stand in the corpus and in a buffer, and which of them
    stand earlier in another of these phrases. The same place of a repeated row is not earlier."""

    def __init__(self, doc: list[int], place: list[int], content: list[bytes]):
        self.buffer = np.frombuffer(b"".join(content), np.uint8)
        size = np.array([len(c) for c in content], np.int64)
        many = size - LENGTH + 1
        self.phrase = np.repeat(np.arange(len(content)), many)
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.here = (np.cumsum(size) - size)[self.phrase] + inner
        self.doc = np.array(doc, np.int64)[self.phrase]
        self.start = (np.array(place, np.int64) >> 10)[self.phrase] + inner
        rank = equal_windows(self.buffer, self.here)
        order = np.lexsort((self.start, _document(self.doc), rank))
        rank, doc_of, start_of = rank[order], _document(self.doc)[order], self.start[order]
        opens = np.flatnonzero(np.diff(rank, prepend=-1))
        first = np.repeat(opens, np.diff(opens, append=len(order)))
        self.again = np.zeros(len(order), bool)
        self.again[order] = (doc_of != doc_of[first]) | (start_of != start_of[first])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc, place and hash of the runs of windows that stand earlier."""
        joined = self.again[1:] & self.again[:-1] & (self.phrase[1:] == self.phrase[:-1])
        first = np.flatnonzero(self.again & ~np.append(False, joined))
        last = np.flatnonzero(self.again & ~np.append(joined, False))
        here = self.here[first]
        hashed = Ranges().load(self.buffer).hash(here, here + last - first + LENGTH)
        return self.doc[first], self.start[first] << 10 | last - first + 1, hashed.view(np.int64)


def _sort_dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases ordered by trigger; suffix arrays are built over whole triggers, some megabytes at a time."""


    def marks(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, _Windows(*zip(*rows, strict=True)).runs())], ["doc", "place", "hash"])

    held, size, current = [], 0, None
    for batch in batches:
        for key, doc, place, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != current and size > CHUNK:
                yield marks(held)
                held, size = [], 0
            current = key
            held.append((doc, place, content))
            size += len(content)
    if held:
        yield marks(held)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of dictionary phrases from rows (doc, text, phrases); a phrase not of this very text is left alone."""
    for batch in batches:
        rows = []
        for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = text.encode()
            ranges = Ranges().load(np.frombuffer(raw, np.uint8))
            for p in wanted:
                start, stop = p["place"] >> 10, (p["place"] >> 10) + (p["place"] & MANY) + LENGTH - 1
                if stop <= len(raw) and ranges.hash(np.array([start]), np.array([stop])).view(np.int64)[0] == p["hash"]:
                    rows.append((p["key"], doc, p["place"], raw[start:stop]))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "doc", "place", "content"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit digest of each distinct window of phrases (key, doc, place, content), at its first place in a part of
    the phrases; what stands earlier in the part is settled (low is null)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 10_000):
            part = batch.slice(at, 10_000)
            windows = _Windows(*(part.column(i).to_pylist() for i in (1, 2, 3)))
            doc, place, hashed = windows.runs()
            here = windows.here[~windows.again]
            low = Ranges().load(windows.buffer).hash(here, here + LENGTH).view(np.int64)
            high = Ranges().load(windows.buffer ^ np.uint8(0x5A)).hash(here, here + LENGTH).view(np.int64)
            nothing = pa.nulls(len(doc), pa.int64())
            columns = [
                pa.chunked_array([nothing, pa.array(low)]).combine_chunks(),
                pa.chunked_array([nothing, pa.array(high)]).combine_chunks(),
                pa.array(np.concatenate([doc, windows.doc[~windows.again]])),
                pa.array(np.concatenate([place, windows.start[~windows.again] << 10 | 1])),
                pa.array(np.concatenate([hashed, low])),  # the hash of one window is its low digest
            ]
            yield pa.RecordBatch.from_arrays(columns, ["low", "high", "doc", "place", "hash"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc, place, hash: runs of windows of rows (doc, text) that stand earlier in the corpus, hash being their bytes'."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(_hot_triggers(docs))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trigger, hashed, doc, place, again in _parse(batches):
            key = trigger.view(np.int64)
            split = np.isin(key, hot.value)
            part = hashed % np.uint64(PARTS) + np.uint64(1)
            key = np.where(split, mix(trigger + part).view(np.int64), key)
            # what is settled needs no company: it is spread by its place
            key = np.where(again, mix(hashed + place.astype(np.uint64)).view(np.int64), key)
            place = place | np.where(again, KNOWN, 0) | np.where(split, SPLIT, 0)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(hashed.view(np.int64)), pa.array(doc), pa.array(place)], ["key", "hash", "doc", "place"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parsed = docs.mapInArrow(parse, _PHRASES).repartition(parts, "key").sortWithinPartitions(
        "key", "hash", F.greatest("doc", F.lit(NO_ID)), "place", "doc"
    )
    settled = stored(parsed.mapInArrow(_settle, "kind int, " + _PHRASES))
    whole = settled.where("kind = 0").select("doc", "place", "hash")
    dictionary = settled.where("kind = 1").drop("kind")
    dense = dictionary.where(F.col("place").bitwiseAND(SPLIT) == 0).groupBy("key").count().where(F.col("count") > DENSE).select("key")
    split = dictionary.where(F.col("place").bitwiseAND(SPLIT) != 0)
    plain = dictionary.where(F.col("place").bitwiseAND(SPLIT) == 0)
    by_digest = split.unionByName(plain.join(dense, "key", "left_semi")).withColumn("kind", F.lit(1))
    by_suffix = plain.join(dense, "key", "left_anti").withColumn("kind", F.lit(0))
    wanted = (
        by_digest.unionByName(by_suffix)
        .groupBy("doc")
        .agg(F.collect_list(F.struct(F.when(F.col("kind") == 0, F.col("key")).alias("key"), "place", "hash")).alias("wanted"))
    )
    found = stored(docs.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_cut_out, "key long, doc long, place long, content binary"))
    ordered = found.where("key is not null").repartition(parts, "key").sortWithinPartitions("key")
    sorted_out = ordered.mapInArrow(_sort_dictionary, "doc long, place long, hash long")
    digests = stored(found.where("key is null").mapInArrow(_digests, "low long, high long, doc long, place long, hash long"))
    windows = digests.where("low is not null")
    stands = F.struct(F.greatest("doc", F.lit(NO_ID)).alias("doc"), "place")
    firsts = windows.groupBy("low", "high").agg(F.min(stands).alias("first"), F.count("*").alias("n")).where("n > 1")
    digested = windows.join(firsts, ["low", "high"]).where(stands != F.col("first")).unionByName(
        digests.where("low is null"), allowMissingColumns=True
    )
    marks = stored(whole.unionByName(sorted_out).unionByName(digested.select("doc", "place", "hash")))
    for table in (settled, found, digests):
        discard(table)
    return marks


def _removed(raw: bytes, marks: list[dict] | None, ranges: Ranges) -> np.ndarray:
    """Start and stop of the maximal removed runs; marks of another text under the same id don't count."""
    if not marks or len(raw) < LENGTH:
        return np.zeros((0, 2), np.int64)
    place = np.array([m["place"] for m in marks], np.int64)
    start = place >> 10
    stop = start + (place & MANY) + LENGTH - 1
    fits = stop <= len(raw)
    hashed = np.array([m["hash"] for m in marks], np.int64)
    ranges.load(np.frombuffer(raw, np.uint8))
    own = fits.copy()
    own[fits] = ranges.hash(start[fits], stop[fits]).view(np.int64) == hashed[fits]
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, start[own], 1)
    np.add.at(edge, stop[own], -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.flatnonzero(np.diff(covered, prepend=False, append=False)).reshape(-1, 2)


def _keyed(docs: DataFrame) -> DataFrame:
    """A key for order and join: rows without an id come before all others, as if of one document; each of their texts
    has a key of its own, so many such rows are no hot key."""
    own = F.xxhash64("text").bitwiseAND(2**62 - 1) + F.lit(-(2**63)).cast("long")
    return docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), own))


def _with_marks(docs: DataFrame) -> DataFrame:
    keyed = _keyed(docs)
    marks = repeats(keyed.select(F.col("__doc").alias("doc"), "text"))
    by_doc = marks.groupBy("doc").agg(F.collect_list(F.struct("place", "hash")).alias("__marks"))
    return keyed.join(by_doc.withColumnRenamed("doc", "__doc"), "__doc", "left").drop("__doc")


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`.

    Null texts are empty; texts under 100 bytes lose nothing. Rows of one doc_id count as one document: they are ordered by
    start alone, and equal bytes at one place of both stand in neither before the other, so a repeated row gets the
    same answer as the row. Rows without an id come before all others, as one document (ids below -2^62 count as none). Other
    columns are not read."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            rows = []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode() if text else b""
                runs = _removed(raw, marks, ranges)
                kept = hashlib.sha256()
                at = 0
                for start, stop in runs.tolist():
                    kept.update(raw[at:start])
                    at = stop
                kept.update(raw[at:])
                rows.append((len(raw), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    rows = _with_marks(docs.select("doc_id", "text")).select("doc_id", "text", "__marks")
    return rows.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` without bytes that repeat an earlier string of 100 bytes; same columns, n_chars (if there) set anew.

    Only whole characters go. A document that is left with nothing but white space goes with its text; others stay."""
    names, at = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            texts, stays, changed = [], [], []
            for text, marks in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                raw = text.encode() if text else b""
                runs = _removed(raw, marks, ranges).tolist()
                kept, last = [], 0
                for start, stop in runs:
                    while start < stop and raw[start] & 0xC0 == 0x80:
                        start += 1
                    while stop > start and stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                        stop -= 1
                    kept.append(raw[last:start])
                    last = stop
                changed.append(bool(runs))
                texts.append(b"".join([*kept, raw[last:]]).decode() if runs else text)
                stays.append(not runs or bool(texts[-1].strip()))
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                old = columns[i].to_pylist()
                columns[i] = pa.array([len(t) if c else o for t, c, o in zip(texts, changed, old, strict=True)], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(stays, pa.bool_()))

    return _with_marks(docs).select(*names, "__marks").mapInArrow(cut, docs.schema)
