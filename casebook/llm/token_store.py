"""Token ids on disk: Simple-8b words in blocks with offsets, written and read back by Spark."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.llm.units import Memo, byte_slices, gather, joined, words_of

#: Ids per word and bits per id by selector; selector 0 is the escape: the next word is one id of up to 64 bits.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
#: Ids per frame; a payload starts with the number of ids, of frames, and each frame's first word.
FRAME = 16_384


def _frame(values: np.ndarray) -> np.ndarray:
    """The words of one run of uint64 values, each word packing as many as fit."""
    n = len(values)
    width, rest = np.ones(n, np.uint8), values
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        width += np.where(high != 0, step, 0).astype(np.uint8)
        rest = np.where(high != 0, high, rest)
    padded = np.concatenate([width, np.zeros(64, np.uint8)])
    selector = np.zeros(n, np.int64)
    widest, reach = padded.copy(), 1
    for s in range(14, 0, -1):  # ascending counts: the last selector that fits packs most
        while reach < COUNTS[s]:
            step = min(reach, int(COUNTS[s]) - reach)
            widest[:-step] = np.maximum(widest[:-step], widest[step:])
            reach += step
        selector[widest[:n] <= WIDTHS[s]] = s
    steps, starts, at = COUNTS[selector].tolist(), [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    start = np.array(starts, np.int64)
    chosen = selector[start]
    place = np.arange(len(start)) + np.cumsum(chosen == 0) - (chosen == 0)
    words = np.zeros(len(start) + int((chosen == 0).sum()), np.uint64)
    ids = np.concatenate([values, np.zeros(64, np.uint64)])
    for s in np.unique(chosen).tolist():
        mine = chosen == s
        if s == 0:
            words[place[mine] + 1] = values[start[mine]]
            continue
        word = np.full(int(mine.sum()), s, np.uint64) << np.uint64(60)
        for k in range(COUNTS[s]):
            word |= ids[start[mine] + k] << np.uint64(k * WIDTHS[s])
        words[place[mine]] = word
    return words


def pack(ids: np.ndarray) -> bytes:
    frames = [_frame(ids[i : i + FRAME].astype(np.uint64)) for i in range(0, len(ids), FRAME)]
    offsets = np.cumsum([0, *map(len, frames)])
    head = np.array([len(ids), len(frames), *offsets], "<u8")
    return head.tobytes() + b"".join(f.astype("<u8").tobytes() for f in frames)


def _unframe(words: np.ndarray, n: int) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # a raw word follows each escape; its own top bits are no selector, so escapes are found from the left
    escapes = np.flatnonzero(selector == 0)
    last = -2
    for at in escapes.tolist():
        if at != last + 1:
            raw[at + 1], last = True, at
    counts = np.where(raw, 0, COUNTS[selector])
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector[~raw]).tolist():
        mine = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[first[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[first[mine] + k] = words[mine] >> np.uint64(k * WIDTHS[s]) & mask
    return out[:n]


def unpack(payload: bytes, frames: slice = slice(None)) -> np.ndarray:
    """The ids of a payload, or of some of its frames only."""
    n, count = (int(x) for x in np.frombuffer(payload, "<u8", 2))
    offsets = np.frombuffer(payload, "<u8", count + 1, 16).astype(np.int64)
    words = np.frombuffer(payload, "<u8", offset=16 + 8 * (count + 1)).astype(np.uint64)
    parts = [_unframe(words[offsets[i] : offsets[i + 1]], min(FRAME, n - i * FRAME)) for i in range(count)[frames]]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


#: Letters and other numerals below U+0250 (but dotted I), whose classes and lower case are settled in every version of Unicode.
_LETTERS = r"a-zA-Z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
_NUMERALS = r"0-9\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}"
#: What the vocabulary's pattern makes of lower-cased words in that range.
_PIECES = f"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMERALS}]|[^\\s{_LETTERS}{_NUMERALS}]+)"
_PLAIN = r"^[!-~\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{24f}]*$"


class WordEncoder:
    """Ids of whole texts under a tokenizers file that drops white space and marks the last token of each piece.

    Any space is a safe boundary. Distinct words are cut into pieces by Arrow's own expressions; unknown pieces go to the
    library many at a time, parted by spaces, and come back apart by the tokens that end a piece. Words of other scripts
    and texts that hold a special string go to it as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
        self.pieces = Memo(self._pieces, 700_000)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        found = []
        for at in range(0, len(pieces), 4000):
            part = pieces[at : at + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(part):  # the library cut a piece further: one by one then
                found += self._whole(part)
                continue
            raw, last = ids.tobytes(), 0
            for stop in stops.tolist():
                found.append(raw[last:stop])
                last = stop
        return found

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in one row and the number of each."""
        plain = pc.match_substring_regex(words, _PLAIN)
        cut = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(plain, words, "")), _PIECES, r"\1 ")
        codes, ends, pieces = words_of(cut)
        pieces = pieces.to_pylist()
        known = self.pieces.ready({piece for piece in pieces if piece})
        values = [known[piece] if piece else b"" for piece in pieces]
        whole = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if len(whole):  # each was cut into one empty piece
            codes[ends[whole] - 1] = len(values) + np.arange(len(whole))
            values += self._whole(words.take(pa.array(whole)).to_pylist())
        flat, stops = gather(*joined(values), codes, ends)
        return flat, np.diff(stops, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) in one row and where each text's end.

        Each distinct word is cut once a call. Texts that hold a special string go to the library whole."""
        held = np.zeros(len(texts), bool)
        for special in self.special:
            held |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(held), "", texts) if held.any() else texts
        codes, ends, words = words_of(pc.replace_substring(plain, "\n", " "))
        flat, sizes = self._words(words)
        if held.any():  # each was cut into one empty word
            codes[ends[held] - 1] = len(sizes) + np.arange(held.sum())
            more, counts = joined(self._whole(texts.filter(pa.array(held)).to_pylist()))
            flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, counts])
        return gather(flat, sizes, codes, ends)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


BLOCKS = "bucket int, block int, offset long, doc_ids array<long>, counts array<long>, payload binary"


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, block_ids: int = 1 << 18) -> None:
    """Encode every row of `docs` (doc_id, text) and write blocks of whole documents in ascending doc_id order.

    Files hold ranges of doc_id; rows of one doc_id are ordered by text, rows without an id come first, null texts
    are empty and hold the end id only. A block is closed at `block_ids` ids; a longer document is a block."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, encoder = TaskContext.get().partitionId(), word_encoder(path)
        number = offset = size = 0
        names, held = [], []
        end = np.array([end_id], "<u4").tobytes()

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = {"bucket": bucket, "block": number, "offset": offset, "doc_ids": names, "counts": [len(h) // 4 for h in held], "payload": pack(ids)}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for texts in byte_slices(batch.column(1), 8 << 20):
                found, stops = encoder.encode(texts)
                for row in np.split(found, stops[:-1]):
                    names.append(next(ids))
                    held.append(row.tobytes() + end)
                    size += len(row) + 1
                    if size >= block_ids:
                        yield close()
                        number, offset, size, names, held = number + 1, offset + size, 0, [], []
        if held:
            yield close()

    ranged = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(blocks, BLOCKS).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit bytes) of every document in the files.

    start counts the ids of all documents before; it adds up the files' totals, one row per file."""
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    files = blocks.groupBy("bucket").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(bases), "bucket").select((F.col("base") + F.col("offset")).alias("start"), "doc_ids", "counts", "payload")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, names, counts, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = unpack(payload).astype("<u4")
                stops = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array(start + stops - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([ids[b - n : b].tobytes() for b, n in zip(stops.tolist(), counts, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def token_checks(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids' bytes."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
