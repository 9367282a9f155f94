"""Document fingerprints: bottom-k sketches of word-shingle hashes, mergeable across parts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.hashing import FACTOR, Ranges, mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Shingler:
    """64-bit hashes of the `width`-word shingles of many texts at once.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words is one shingle; one without
    words has none."""

    def __init__(self, width: int = 5):
        self.width = width
        self.ranges = Ranges()

    def hashes(self, texts: list[bytes]) -> list[np.ndarray]:
        data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        ink = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(ink, prepend=False, append=False))
        start, stop = edge[::2], edge[1::2]
        word = self.ranges.load(data).hash(start, stop)
        sizes = np.array([len(text) + 1 for text in texts])
        bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
        windows = np.zeros(max(0, len(word) - self.width + 1), np.uint64)
        for k in range(self.width):
            windows = windows * FACTOR + word[k : k + len(windows)]
        windows = mix(windows)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= self.width:
                out.append(windows[a : b - self.width + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for k in range(a, b):
                    whole = whole * FACTOR + word[k : k + 1]
                out.append(mix(whole))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def sketch(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct hashes, ascending; all of them if there are fewer."""
    if len(hashes) > 16 * k:
        near = np.partition(hashes, 4 * k)[: 4 * k + 1]
        low = np.unique(near)
        if len(low) > k:
            return low[:k]
    return np.unique(hashes)[:k]


def merge_sketches(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def distinct(s: np.ndarray, k: int) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) / (float(s[-1]) + 1.0) * 2.0**64


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated Jaccard similarity: how many of the union's k smallest are in both. Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge_sketches(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of a's shingles that b has too; nothing is contained in everything."""
    if not len(a):
        return 1.0
    size = distinct(merge_sketches(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * size / max(distinct(a, k), 1.0))


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(np.uint64)


def with_buckets(docs: DataFrame, buckets: int) -> tuple[DataFrame, list[float]]:
    """Rows in ranges of descending doc_id of about equal count (column bucket, from 0; null ids come last)."""
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.1 / buckets)), reverse=True) if buckets > 1 else []
    number = F.col("doc_id").cast("double")
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts)))
    if cuts:
        place = place.otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut > number)))
    return docs.withColumn("bucket", place.otherwise(F.lit(0)) if not cuts else place), cuts


def fingerprint_edits(docs: DataFrame, k: int = 128, width: int = 5, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of `docs`.

    The edited text lends from the row that follows in descending order of (doc_id, text), the first following the
    last; a lone row follows itself. Null texts are empty; rows without an id come last; repeated rows follow one
    another. Texts without words have an empty sketch, alike to one another only.

    Texts move once, into ranges of ids; the head row of each range, one per range, is also sent to the range before
    it, whose last row needs it."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, cuts = with_buckets(docs.select("doc_id", "text"), buckets)
    slim = rows.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head"))
    present = [(r["bucket"], r["head"]) for r in slim.orderBy("bucket").collect()]  # one row per range
    if not present:
        present = [(0, None)]
    heads = spark.createDataFrame(
        [(bucket, head, present[i - 1][0]) for i, (bucket, head) in enumerate(present)], "bucket int, head long, target int"
    )
    first = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
    lent = (
        rows.join(F.broadcast(heads), "bucket")
        .where(F.col("doc_id").eqNullSafe(F.col("head")))
        .withColumn("at", F.row_number().over(first))
        .where("at = 1")
        .select("doc_id", "text", F.col("target").alias("bucket"), F.lit(True).alias("lent"))
    )
    ranged = rows.withColumn("lent", F.lit(False)).unionByName(lent)
    ordered = ranged.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions(
        "bucket", "lent", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text")
    )

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)

        def answer(rows: list[tuple]) -> pa.RecordBatch:
            """Rows (doc_id, bytes, characters) in order; the last one only lends."""
            own, edited, sizes = [], [], []
            for (_, text), (_, following) in zip(rows, rows[1:], strict=False):
                cut = len(text) // 3
                own.append(text.encode())
                edited.append((text[: len(text) - cut] + following[:cut]).encode())
                sizes.append(len(text))
            prints = [sketch(h, k) for h in shingler.hashes([*own, rows[-1][1].encode()])]
            changed = [sketch(h, k) for h in shingler.hashes(edited)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows[:-1]], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([hashlib.sha256(text).hexdigest() for text in edited], pa.string()),
                    pa.array(map(to_text, prints[:-1]), pa.string()),
                    pa.array(map(to_text, changed), pa.string()),
                    pa.array([resemblance(a, b, k) for a, b in zip(prints, changed, strict=False)], pa.float64()),
                    pa.array([resemblance(a, b, k) for a, b in zip(prints, prints[1:], strict=False)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        waiting, size = [], 0
        for batch in batches:
            ids, texts, lent = (batch.column(i).to_pylist() for i in range(3))
            for doc_id, text, only_lent in zip(ids, texts, lent, strict=True):
                waiting.append((doc_id, text or ""))
                size += len(waiting[-1][1])
                if only_lent or size > 4 << 20:
                    if len(waiting) > 1:
                        yield answer(waiting)
                    waiting, size = [] if only_lent else waiting[-1:], 0

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("doc_id", "text", "lent").mapInArrow(fingerprints, schema)
